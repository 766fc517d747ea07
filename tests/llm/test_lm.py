"""Language-model scores against plain models."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarnwell.llm import lm
from tests.llm.cases import hard_documents, no_documents


class Plain:
    """Prediction by partial matching, symbol by symbol with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            s = [lm.BEGIN] * order + [*t, lm.END]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.next[tuple(s[i - k : i])][s[i]] += 1

    def symbol(self, ctx, c):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.next.get(tuple(ctx[len(ctx) - k :]))
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            if not left:
                continue
            total = sum(left.values())
            if c in left:
                return p * (left[c] - 0.5) / total
            p *= len(left) / 2 / total
            excluded |= set(left)
        return p / (lm.SYMBOLS - len(excluded))

    def score(self, t):
        s = [lm.BEGIN] * self.order + [*t, lm.END]
        return sum(math.log10(self.symbol(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


@pytest.mark.parametrize("order", [1, 3, 5])
def test_ppm_is_the_plain_one(spark, order):
    train = ["the cat sat on the mat".encode(), "the hat of the cat".encode(), b"", "é là".encode()]
    texts = [b"the cat", b"", b"zebra the", "où é".encode(), bytes(range(254)), b"the hat sat on the cat of the mat"]
    grams = lm.gram_counts(spark.createDataFrame([(t,) for t in train], "text binary"), order)
    m = lm.model_of(grams, 0, 1 << (8 * order), order)
    p = Plain(train, order)
    assert np.allclose(m.scores(texts), [p.score(t) for t in texts], atol=1e-9)
    # ranges of the trie add up to the same
    cuts = lm.ranges(grams, order, 30)
    assert len(cuts) > 1 and [lo for lo, _ in cuts] == [0, *[hi for _, hi in cuts[:-1]]] and cuts[-1][1] == 1 << (8 * order)
    got = sum(lm.model_of(grams, lo, hi, order).scores(texts, lo, hi) for lo, hi in cuts)
    assert np.allclose(got, [p.score(t) for t in texts], atol=1e-9)
    # the probabilities of all that can follow add up to one
    for ctx in ([lm.BEGIN] * order, [*b"the c"[:order]], [200] * order):
        keys = np.array([sum(s << (8 * (len(ctx) - i)) for i, s in enumerate([*ctx, c])) for c in range(256) if c != lm.BEGIN], np.uint64)
        assert abs((10 ** m.logs(keys)).sum() - 1) < 1e-9


def _ranges(spark, texts, order, nodes):
    grams = lm.gram_counts(spark.createDataFrame([(t,) for t in texts], "text binary"), order)
    return grams, [(lo, hi, lm.model_of(grams, lo, hi, order)) for lo, hi in lm.ranges(grams, order, nodes)]


def _sum_over_symbols(models, ctx, order):
    """The probabilities of all that can follow ctx, each from the range that it belongs to."""
    keys = np.array([lm.gram_keys([ctx + bytes([c])], order)[0][len(ctx)] for c in range(256) if c not in (lm.END, lm.BEGIN)] + [lm.gram_keys([ctx], order)[0][-1]], np.uint64)
    at = lm.places(keys, order)
    assert len(set(at.tolist())) == 1  # one context, so one range
    (m,) = [m for lo, hi, m in models if lo <= at[0] < hi]
    return (10 ** m.logs(keys)).sum()


def test_each_range_makes_a_distribution(spark):
    train = [b"abracadabra abracadabra", b"banana bandana abba"] * 3 + [b"xyz"]
    _, models = _ranges(spark, train, 4, 60)
    for ctx in (b"", b"abra", b"xyzw", b"bana"):
        assert abs(_sum_over_symbols(models, ctx, 4) - 1) < 1e-9
    assert lm.PPM([(np.zeros(0, np.uint64), np.zeros(0))] * 3).scores([b"ab"])[0] == pytest.approx(-3 * math.log10(255))


@pytest.mark.parametrize("nodes", [5, 30])
def test_nodes_are_a_true_bound(spark, nodes):
    """No range begins more grams than asked for, whatever their counts (here over 100,000),
    but for those of one place; none is left out; what a range holds is a distribution."""
    rng = random.Random(2)
    text = "".join(rng.choices("abcd", k=1_000_000)).encode()
    grams, models = _ranges(spark, [text], 3, nodes)
    begun = [grams.where((grams.place >= lo) & (grams.place < hi)).count() for lo, hi, _ in models]
    one = max(r["count"] for r in grams.groupBy("place").count().collect())
    assert sum(begun) == grams.count() and max(begun) <= max(nodes, one)
    for (lo, hi, m), n in zip(models, begun, strict=True):
        assert sum(len(g.keys) for g in m.grams) <= n + 4 * 6  # and the followers of order + 1 contexts
    for ctx in (b"", b"a", b"abc", b"zz"):
        assert abs(_sum_over_symbols(models, ctx, 3) - 1) < 1e-6


def test_scores_do_not_depend_on_ranges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rows = docs.collect()
    docs = spark.createDataFrame(rows + rows[:3], docs.schema)
    train = spark.createDataFrame(rows[:40], docs.schema)
    few, one = (sorted(map(tuple, lm.score(docs, train, nodes=n).collect())) for n in (9_000, 10_000_000))
    assert len(few) == len(rows) + 3
    p = Plain([(r.text or "").encode() for r in rows[:40]], lm.ORDER)
    plain = {r.doc_id: p.score((r.text or "").encode()) for r in rows}
    for x, y in zip(few, one, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9) == pytest.approx(plain[x[0]], rel=1e-9)
    again = {}
    for x in few:  # repeated rows get the same score to the last bit
        assert again.setdefault(x[0], x) == x


def test_slices_without_a_place_in_a_range(spark):
    """A slice of one short text after that of a long one: most ranges have no place of it."""
    rows = [(1, "abcd" * 150_000), (2, ""), (3, None), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in lm.score(docs, docs, nodes=5).collect()}
    grams = lm.gram_counts(docs.selectExpr("cast(coalesce(text, '') as binary) as text"))
    cuts = lm.ranges(grams, nodes=5)
    parts = [lm.model_of(grams, lo, hi).scores([b""], lo, hi) for lo, hi in cuts]
    assert len(cuts) > 1 and {p.dtype for p in parts} == {np.dtype(float)} and sum(p[0] != 0 for p in parts) == 1
    whole = lm.model_of(grams, 0, 1 << (8 * lm.ORDER)).scores([(t or "").encode() for _, t in rows])
    assert [got[i] for i, _ in rows] == pytest.approx(whole.tolist(), rel=1e-9)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z", "z"), (1, "a b", "z", "z")], "doc_id long, text string, score string, n_tokens string")
    got = lm.score(docs, docs, keep=["doc_id", "score", "n_tokens"])
    assert got.columns == ["doc_id", *lm.SCORES] and len({tuple(r) for r in got.collect()}) == 1


def plain_base(train, texts):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()) + len(train), len(count) + (1 if train else 0)
    out = []
    for t in texts:
        cs = [count[w] for w in words(t)] + [len(train)]
        out.append((len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs)))
    return out


@pytest.mark.parametrize("words", [150_000, 50])
def test_base_scores(spark, sf_dir, monkeypatch, words):
    monkeypatch.setattr(lm, "WORDS", words)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(hard_documents(spark).where("doc_id in (1, 2, 3, 9)").selectExpr("doc_id + 10000000 as doc_id", "text"))
    rows = docs.collect()
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    from tarnwell.llm.common import crc_fold

    got = {r.doc_id: r for r in lm.score(docs, docs.where(crc_fold(docs.doc_id, 5) != 1)).collect()}
    assert len(got) == len(rows)
    for r, (n, known, total, base) in zip(rows, plain_base(train, [r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score < 0


def test_hard_cases(spark):
    docs = hard_documents(spark)
    got = lm.score(docs, docs, keep=["doc_id", "h", "id"]).collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score and by[1].n_tokens == 1 and by[3].n_tokens == 1
    assert lm.score(no_documents(spark), docs).count() == 0
    none = lm.score(docs, no_documents(spark)).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}
