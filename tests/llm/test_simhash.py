"""SimHash fingerprints and components against plain brute force."""

import random

import numpy as np
import xxhash

from tarnwell.llm import simhash as S
from tests.llm.cases import hard_documents, no_documents


def plain_print(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, near=4):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p = np.array(prints, np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(p[a] ^ p[a + 1 :]) <= near) + a + 1:
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_thermometer_is_manhattan():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 500)).astype(np.uint64)
    plain = np.abs(S.places(a) - S.places(b)).sum(axis=1)
    assert (np.bitwise_count(S.thermometer(a) ^ S.thermometer(b)) == plain).all()
    assert (plain <= np.bitwise_count(a ^ b)).all()


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    prints = [plain_print(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (p, want[r.doc_id]) for r, p in zip(rows, prints, strict=True)}


def test_hard_cases(spark):
    docs = hard_documents(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    assert all(r.fp % 2**64 == want[r.doc_id] for r in got)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5
    assert S.near_duplicates(no_documents(spark)).count() == 0


def test_every_link_counts_in_large_cells(spark, monkeypatch):
    """Chains of fingerprints a few bits apart, in cells cut into many tiles."""
    monkeypatch.setattr(S, "TILE", 16)
    rng = random.Random(2)
    prints, x = [], 0x0123456789ABCDEF
    for _ in range(500):
        prints.append(x)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        if rng.random() < 0.05:
            x = 0x0123456789ABCDEF ^ (1 << rng.randrange(64))
    prints = list(dict.fromkeys(prints)) + [rng.getrandbits(64) for _ in range(300)]
    ids = list(range(10, 10 + len(prints)))
    classes = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in zip(ids, prints, strict=True)], "id long, fp long")
    from tarnwell.llm.common import components

    got = {r.node: r.root for r in components(S.links(classes)).collect()}
    assert {i: got.get(i, i) for i in ids} == plain_components(ids, prints)


def test_components_of_a_long_path_and_a_star(spark):
    from tarnwell.llm.common import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(None, 4), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_clear_tables(spark):
    from tarnwell.llm import common

    df = common.written(spark.range(5))
    path = common._tables[-1]
    assert df.count() == 5
    common.clear_tables(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not common._tables and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
