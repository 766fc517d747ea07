"""Near copies by shingle similarity against brute force."""

import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline as P
from tarnwell.llm import similar as S
from tarnwell.llm.common import local_forest
from tests.llm.cases import hard_documents, no_documents


def plain_shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_roots(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if min(len(sets[a]), len(sets[b])) < 0.8 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def copies(seed=3):
    """Texts and copies of them with some words changed, some of one base many times."""
    rng = random.Random(seed)
    rows = []
    for base in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 300))]
        for _ in range(40 if base == 0 else 4):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 30))):
                v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(v)))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    assert got == plain_roots(rows)


def test_against_brute_force(spark):
    check(spark, copies())


def test_keys_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 500)
    check(spark, copies(4))


def test_fingerprints_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_ROWS", 16)
    monkeypatch.setattr(S, "SHARE", 10**9)
    check(spark, copies(5))


def test_fingerprint_is_plain():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 254, 255, 256, 1000):
        found = rng.integers(0, 2**63, n).astype(np.uint64)
        for k, (word, mult) in enumerate(zip(S.fingerprint(found), S._MULT.tolist(), strict=True)):
            h = [(x ^ x >> 31) * mult % 2**64 for x in found.tolist()]
            h = [x ^ x >> 32 for x in h]
            assert int(word) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n), (n, k)


def test_similar_sets_are_within_the_radius():
    """Pairs of similarity 0.8 and a little more, of few hashes and of many."""
    rng = np.random.default_rng(2)
    half, whole = S.radius(128, 0.8), S.radius(256, 0.8)
    for n in [5, 9, 10, 18, 45, 90, 180, 450] * 40:
        apart = n // 5 if n % 9 else n // 9  # all of them in one set, or as many in each
        found = rng.integers(0, 2**63, n + apart).astype(np.uint64)
        a, b = (found[:n], found[apart:n]) if n % 9 else (found[:n], found[apart:])
        bits = np.bitwise_count(S.fingerprint(a) ^ S.fingerprint(b))
        assert bits[:2].sum() <= half and bits.sum() <= whole


def test_range_join_of_fingerprints_against_brute_force(spark, monkeypatch):
    """Components of fingerprints within the radius and sizes in range, over many tiles and bands."""
    from tarnwell.llm.common import components

    monkeypatch.setattr(S, "LEAST_ROWS", 16)
    monkeypatch.setattr(S, "SHARE", 10**9)
    rng = random.Random(6)
    rows, x = [], 0
    for i in range(500):
        for b in rng.sample(range(256), rng.randint(20, 110)):
            x ^= 1 << b
        if rng.random() < 0.2:
            x = rng.getrandbits(256)
        words = np.frombuffer(x.to_bytes(32, "little"), np.int64).tolist()
        rows.append((1000 - i, rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 60, 75, 90, 94, 110]), *words))
    own = spark.createDataFrame(rows, "id long, size long, f0 long, f1 long, f2 long, f3 long").repartition(5)
    got = {r.node: r.root for r in components(S._joined(own, 0.8)).collect()}
    prints = np.array([r[2:] for r in rows], np.int64).view(np.uint64)
    root = {r[0]: r[0] for r in rows}
    linked = 0
    for a in range(len(rows)):
        bits = np.bitwise_count(prints[a] ^ prints[:a])
        for b in np.flatnonzero((bits.sum(axis=1) <= S.radius(256, 0.8)) & (bits[:, :2].sum(axis=1) <= S.radius(128, 0.8))).tolist():
            if 10 * min(rows[a][1], rows[b][1]) >= 8 * max(rows[a][1], rows[b][1]):
                linked += 1
                low, high = sorted((root[rows[a][0]], root[rows[b][0]]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert linked > 50 and {i: got.get(i, i) for i in root} == root


@pytest.mark.parametrize("sides", [True, False])
def test_comparison_in_bounded_memory(sides):
    """Two bands, the least size of one with nothing in its range in the other: no block of all with all."""
    rng = np.random.default_rng(8)
    n = 3000
    size = np.concatenate([rng.integers(87, 109, n), rng.integers(109, 136, n)])
    prints = rng.integers(0, 2**63, (2 * n, S.WORDS), np.uint64)
    prints[n : n + 400] = prints[:400]
    side = np.arange(2 * n) >= n
    tracemalloc.start()
    x, y = S.close(np.arange(2 * n), size, prints, side if sides else None, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32e6
    u, v = [], []
    for i in range(n if sides else 2 * n):
        bits = np.bitwise_count(prints[i] ^ prints)
        ok = (bits.sum(axis=1) <= S.radius(256, 0.8)) & (bits[:, :2].sum(axis=1) <= S.radius(128, 0.8))
        ok &= 10 * np.minimum(size[i], size) >= 8 * np.maximum(size[i], size)
        j = np.flatnonzero(ok & side if sides else ok)
        u.append(np.full(len(j), i))
        v.append(j)
    node, root = local_forest(np.concatenate(u), np.concatenate(v))
    assert 100 < len(node) < 400
    # close names a component by its smallest row or another of it
    assert len(x) == len(node) and dict(zip(*map(np.ndarray.tolist, local_forest(x, y)), strict=True)) == dict(zip(node.tolist(), root.tolist(), strict=True))


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_hard_cases(spark):
    docs = hard_documents(spark)
    by = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == by[7] == 5 and by[8] == 8
    assert S.near_copies(no_documents(spark)).count() == 0


def test_stage_drops_copies_of_similarity_over_0_8(spark, sf_dir):
    """Copies with every 60th word changed, most of them over 4 bits of SimHash away."""
    rng = random.Random(9)
    rows = []
    for k in range(20):
        w = [f"w{rng.randrange(3000)}" for _ in range(180)]
        v = [f"n{k}" if i % 60 == 30 else x for i, x in enumerate(w)]
        rows += [(2 * k, " ".join(w), "en", "a", 9), (2 * k + 1, " ".join(v), "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_copies(spark, docs, sf_dir).collect()) == list(range(0, 40, 2))
