"""BPE coding against the library; packing; sharding."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnwell.llm.queries import tokenizer_file
from tests.llm.cases import hard_documents, no_documents


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.no_padding()
    t.no_truncation()
    return t


def test_coding_equals_the_library(spark, sf_dir):
    from tarnwell.llm.bpe import encode_decode

    t = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(hard_documents(spark).where("doc_id < 12").select("doc_id", "text"))
    want = sorted((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in encode_decode(docs, tokenizer_file("word_bpe_49k.json")).collect())
    assert [g[:2] for g in got] == want
    assert all(d == t.decode(ids, skip_special_tokens=False) for _, ids, d in got)
    assert encode_decode(no_documents(spark), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_no_token_spans_a_forced_boundary():
    from tarnwell.llm.bpe import ForcedBoundaryEncoder

    e = ForcedBoundaryEncoder(tokenizer_file("word_bpe_49k.json"))
    of = {c: b for b, c in enumerate(e.chars)}
    for token in list(e.vocab)[:5000]:
        raw = bytes(of[c] for c in token.removesuffix("</w>") if c in of)
        assert token in e.special or len(e.fragments(raw)) == 1 or not raw
    assert len(e.fragments("日本語x日本語".encode())) > 1


def check_packing(pieces, docs, t, size):
    want = defaultdict(list)
    for r in docs:
        want[r.doc_id].append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        parts[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert parts.keys() == want.keys()
    for doc, wanted in want.items():
        n = len(wanted)
        assert len(set(wanted)) == 1, "the cases repeat whole rows only"
        by = defaultdict(list)
        for p in parts[doc]:
            assert p.doc_tokens == len(wanted[0]) // 4
            by[p.start].append(p)
        assert all(len(v) == n for v in by.values())
        assert b"".join(by[s][0].ids for s in sorted(by)) == wanted[0]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return sum(n for s in sequences.values() for _, n in s), len(sequences)


def test_packing(spark, sf_dir):
    from tarnwell.llm.packing import pack

    t, path = library("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.json")
    hard = hard_documents(spark)
    check_packing(pack(hard, path).collect(), hard.collect(), t, 2048)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for lot in (20_000, 3_000_000):
        tokens, n = check_packing(pack(docs, path, lot_tokens=lot).collect(), docs.collect(), t, 2048)
        assert tokens > 0.97 * 2048 * n
    assert pack(no_documents(spark), path).count() == 0


def test_best_fit_is_the_tightest():
    from tarnwell.llm.packing import best_fit_decreasing

    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 400)
    window, offset, n = best_fit_decreasing(lengths, 64)
    room, at = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fit = [r for r in room if r >= lengths[i]]
        if not fit:
            room.append(64)
            fit = [64]
        r = min(fit)
        assert 64 - r == offset[i]
        room[room.index(r)] -= lengths[i]
    assert n == len(room)


def check_shards(rows, docs, shards):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    assert want == sorted((r.doc_id, r.size, r.text_crc32) for r in rows)
    return sizes


def test_sharding(spark):
    from tarnwell.llm.sharding import shard

    hard = hard_documents(spark)
    check_shards(shard(hard, 4).collect(), hard.collect(), 4)
    assert shard(no_documents(spark), 4).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard(docs, 24).collect()
    sizes = check_shards(rows, docs.collect(), 24)
    assert len(sizes) == 24 and max(sizes.values()) < 1.02 * min(sizes.values())
    text = {r.doc_id: r.text for r in docs.collect()}
    groups = defaultdict(set)
    for r in rows:
        groups[text[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_a_group_over_half_a_shard_is_split(spark):
    from tarnwell.llm.sharding import shard

    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " + "y" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    sizes = check_shards(shard(docs, 24).collect(), docs.collect(), 24)
    assert len(sizes) == 24 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_queries_give_the_contract(spark, sf_dir):
    from tarnwell.llm.queries import QUERIES

    t = library("word_bpe_49k.json")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_bpe"](spark, sf_dir).collect():
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    q = QUERIES["op6_packing"](spark, sf_dir)
    assert [c for c, _ in q.dtypes] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert dict(QUERIES["op7_sharding"](spark, sf_dir).dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


@pytest.mark.parametrize("name", ["op6_packing", "op7_sharding", "op9_bpe"])
def test_reads_whole_table(spark, sf_dir, name):
    from tarnwell.llm.queries import QUERIES

    got = QUERIES[name](spark, sf_dir).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
