"""Properties on generated inputs, without Spark."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import bpe, lm, packing, sharding, simhash, suffix
from tarnwell.llm.common import local_forest
from tarnwell.llm.queries import tokenizer_file
from tests.llm.test_coding import library

WORDS = library("word_bpe_49k.json")
CODER = bpe.ForcedBoundaryEncoder(tokenizer_file("word_bpe_49k.json"))
BYTES = library("byte_bpe_50k.json")
TOKENS = packing.ByteTokenizer(tokenizer_file("byte_bpe_50k.json"))
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sStTéß中🙂.<|endoftext|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_and_text_are_the_library_s(text):
    ids = WORDS.encode(text, add_special_tokens=False).ids
    got, decoded = CODER.encode(text.encode())
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert decoded == WORDS.decode(ids, skip_special_tokens=False)
    assert TOKENS(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=8), st.integers(2, 12))
def test_repeated_strings_are_found(texts, least):
    parts = [t.encode() for t in texts]
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text[ends] = 0
    at, _ = suffix.repeated(text, ends, least)
    count = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
    begin = np.r_[0, ends[:-1] + 1]
    want = {int(b) + i for b, p in zip(begin, parts, strict=True) for i in range(len(p) - least + 1) if count[p[i : i + least]] > 1}
    assert set(at.tolist()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_windows_hold_all_and_no_more(lengths):
    window, offset, n = packing.best_fit_decreasing(np.array(lengths), 64)
    for w in range(n):
        mine = sorted((int(o), k) for o, k, x in zip(offset, lengths, window, strict=True) if x == w)
        assert mine and all(o == sum(k for _, k in mine[:i]) for i, (o, _) in enumerate(mine))
        assert sum(k for _, k in mine) <= 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_forest_spans_the_components(edges):
    u, v = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
    root = list(range(31))
    for _ in range(31):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    x, y = local_forest(u, v)
    assert len(x) < 31 and {int(a): int(b) for a, b in zip(x, y, strict=True)} == {i: r for i, r in enumerate(root) if i != r}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=600))
def test_bits_are_counted(hashes):
    got = simhash.bit_counts(np.array(hashes, np.uint64))
    assert got.tolist() == [sum(h >> b & 1 for h in hashes) for b in range(64)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=48, max_size=300))
def test_shards_are_level(sizes):
    items = np.array([[s, s // 2 + 1, 1] for s in sizes], float)
    items /= items.sum(axis=0)
    of = sharding.level(items, sharding.place(items, 4), 4)
    load = np.bincount(of, items[:, 0], 4)
    assert load.max() - load.min() <= items[:, 0].max() + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).filter(lambda b: not {254, 255} & set(b)), max_size=6), st.binary(min_size=3, max_size=3).filter(lambda b: not {254, 255} & set(b)))
def test_probabilities_add_up(texts, context):
    keys, _ = lm.gram_keys(texts, 3) if texts else (np.zeros(0, np.uint64), None)
    grams = []
    for k in range(4):
        u, n = np.unique(keys & lm._mask(k + 1), return_counts=True)
        grams.append((u, n.astype(float)))
    m = lm.PPM(grams)
    all_ = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256) if c != lm.BEGIN], np.uint64)
    assert abs((10 ** m.logs(all_)).sum() - 1) < 1e-9
