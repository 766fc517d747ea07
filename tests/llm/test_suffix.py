"""Repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tarnwell.llm import suffix as S
from tests.llm.cases import hard_documents, no_documents


def plain(texts, least):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + least] for b in bodies for i in range(len(b) - least + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.fixture(autouse=True)
def short_grams(monkeypatch):
    """Grams that fit into the short strings of most tests."""
    monkeypatch.setattr(S, "GRAM", 16)


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -(2**62), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept) if r.kept is not None else None) for r in df.collect())


def check(docs, least):
    rows = docs.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -(2**62), *p) for r, p in zip(rows, plain([r.text for r in rows], least), strict=True))
    got = result(S.remove_repeats(docs, least))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == w[4] if g[2] else g[4] is None for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_shorter_passages_are_counted(spark, monkeypatch, block):
    """n_passage is what would go at the shorter length; the rest is as without it."""
    monkeypatch.setattr(S, "BLOCK", block)
    docs = hard_documents(spark)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    for n in (20, 45, 55, 90):
        passage = " ".join(word() for _ in range(n))
        more = [(100 + 10 * n + c, " ".join([word(), word(), passage, word()]), "en", "a", 9, 1, "x") for c in range(3)]
        docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    both, plainly = S.remove_repeats(docs, 200, passage=60), S.remove_repeats(docs, 200)
    assert result(both) == result(plainly)
    short = sorted((r.doc_id, r.n_removed) for r in S.remove_repeats(docs, 60).collect())
    assert sorted((r.doc_id, r.n_passage) for r in both.collect()) == short
    assert S.remove_repeats(no_documents(spark), 200, passage=60).count() == 0


def test_transform_and_expansion():
    rng = np.random.default_rng(4)
    for least in (5, 20, 33):
        parts = [bytes(rng.integers(97, 99 + least // 8, rng.integers(1, 400)).astype(np.uint8)) for _ in range(12)]
        parts += [parts[0][:60] + b"q" + parts[1][-60:], parts[2], b"z" * 90]
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 1
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        text[ends] = 0
        at, of = S.repeated(text, ends, least)
        count = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
        begin = [0, *(ends[:-1] + 1).tolist()]
        want = {b + i: p[i : i + least] for b, p in zip(begin, parts, strict=True) for i in range(len(p) - least + 1) if count[p[i : i + least]] > 1}
        assert set(at.tolist()) == set(want)
        by = {}
        for x, g in zip(at.tolist(), of.tolist(), strict=True):
            assert by.setdefault(g, want[x]) == want[x]


def test_equal_strings_have_equal_keys():
    rng = np.random.default_rng(6)
    s = rng.integers(97, 110, 60).astype(np.uint8)
    seen = set()
    for _ in range(30):
        a = np.concatenate([rng.integers(97, 110, rng.integers(0, 90)).astype(np.uint8), s, rng.integers(97, 110, rng.integers(0, 90)).astype(np.uint8)])
        key, first, n, _ = S.runs(a, 60, 16)
        assert n.sum() == len(a) - 59
        i = bytes(a).find(bytes(s))
        seen.add(int(key[np.searchsorted(first, i, "right") - 1]))
    assert len(seen) == 1


def small_texts(rng, n):
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(vocabulary, k=25)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)))
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, len(p))
            t = t + p[cut:] + t[: rng.randint(0, 30)]
        out.append(t)
    return out + out[:3] + ["ab" * 300, "x" * 500, None, "", "ab" * 200]


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_small_texts(spark, monkeypatch, block):
    """With blocks that hold all, and with keys dealt over many parts."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    texts = small_texts(rng, 40)
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows + rows[5:7], "doc_id long, text string"), 40)


def test_documents(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000")
    monkeypatch.setattr(S, "GRAM", 96)
    check(docs, 400)


def test_hard_cases(spark):
    docs = hard_documents(spark).where("doc_id <> 8")
    check(docs, 400)
    assert len(result(S.remove_repeats(hard_documents(spark)))) == 13
    assert S.remove_repeats(no_documents(spark)).count() == 0
