"""Near-duplicates and top-k of embeddings against brute force."""

import math

import duckdb
import numpy as np
import pytest

from tarnwell.llm import neardup, topk
from tarnwell.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id long, body string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def hard_vectors(rng, n=60, d=6):
    rows = [(int(i), [float(x) for x in rng.normal(size=d).astype(np.float32)]) for i in rng.permutation(n)]
    rows += [(100 + i, [x * (1 + i) for x in rows[i][1]]) for i in range(8)]
    rows += [(200 + i, [x + 0.02 for x in rows[i][1]]) for i in range(20)]
    rows += [rows[3], rows[3], (300, rows[4][1])]
    rows += [(400, None), (401, []), (402, [0.0] * d), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [math.nan] * d), (405, [math.inf] * d), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [-0.0] * d)]
    return rows


def usable(v, zero):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def plain_links(rows, t):
    ok = [i for i, (_, v) in enumerate(rows) if usable(v, False)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= t:
                links[a].add(b)
    out = []
    for i, (vid, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((vid, len(links[i]), c, vid == c))
    return sorted(out)


@pytest.mark.parametrize("tile", [8192, 16])
def test_links(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "BOX", 8)
    rows = hard_vectors(np.random.default_rng(tile))
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows), 0.9).collect())
    assert got == plain_links(rows, 0.9)


def test_pruned_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 40)) * np.linspace(3, 0.2, 40)
    x[::7] = x[1::7][: len(x[::7])] + 0.3 * rng.normal(size=(100, 40))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = neardup.Axes(u, 8)
    at = u @ axes.turn
    i, j = (np.concatenate(p) for p in zip(*neardup.pairs_of(at, at, x, x, 0.9, axes.first, True), strict=True))
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    assert len(np.unique(axes.box(at))) > 4


def test_a_tile_of_copies_and_a_wide_tie(monkeypatch):
    """Memory stays that of counts and of k scores a query where everything links or ties."""
    n = 3000
    rec = np.zeros(n, [("id", "<i8"), ("n", "<i8"), ("v", "<f8", 4)])
    rec["id"], rec["n"], rec["v"] = np.arange(n)[::-1], 2, [1.0, 2.0, 3.0, 4.0]
    u = rec["v"] / np.linalg.norm(rec["v"], axis=1, keepdims=True)
    m = neardup.Meeting(rec, None)
    for i, j in neardup.pairs_of(u, u, rec["v"], rec["v"], 0.9, 2, True):
        m.add(i, j)
    x, y = m.forest()
    assert len(x) == n - 1 and set(y.tolist()) == {0} and (m.more_a + m.more_b == 2 * (n - 1)).all()
    monkeypatch.setattr(topk, "HELD", 500)
    best = topk.Best(4, 5)
    topk.search_shard(best, np.ones((4, 4)), np.arange(4), np.ones((n, 4)), np.arange(n)[::-1], 64)
    for q in range(4):
        assert best.id[best.query == q].tolist() == [i for i in range(6) if i != q][:5]


def test_empty(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, []), "vec_id % 2 = 0").count() == 0
    only = frame(spark, [(1, None), (2, [0.0])])
    assert [tuple(r) for r in neardup.near_duplicates(only).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def plain_top(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if usable(v, True)]
    out = set()
    for i, v in ok:
        if i % 3 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))
            out |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("size", [(16_384, 128, 4096), (20, 4, 5)])
def test_top_k(spark, monkeypatch, size):
    for name, n in zip(("SHARD", "BLOCK", "CHUNK"), size, strict=True):
        monkeypatch.setattr(topk, name, n)
    rows = hard_vectors(np.random.default_rng(size[1])) + [(500, [1e15] * 6), (501, [-3e4] * 6)]
    rows = [(i, v) for i, v in rows if i != rows[3][0]] + [rows[3]]
    rows.append((300, rows[4][1]))
    got = {tuple(r) for r in topk.top_k(frame(spark, [r for r in rows if r[0] != 500]), "vec_id % 3 = 0", k=7).collect()}
    assert got == plain_top([r for r in rows if r[0] != 500], 7)


def test_pruning_skips_blocks():
    rng = np.random.default_rng(2)
    x = np.floor(64 * (rng.normal(size=(16, 12))[rng.integers(0, 16, 4096)] + 0.1 * rng.normal(size=(4096, 12))))
    best = topk.Best(8, 5)
    scored = topk.search_shard(best, x[:8], np.arange(8), x, np.arange(4096), 64)
    s = (x[:8] @ x.T).astype(int)
    for i in range(8):
        want = sorted((-v, j) for j, v in enumerate(s[i].tolist()) if j != i)[:5]
        mine = [(-v, j) for q, v, j in zip(best.query, best.score, best.id, strict=True) if q == i]
        assert mine == want
    assert scored < 0.5 * 8 * 64


@pytest.mark.parametrize("name", ["op1_neardup", "op8_topk"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())
