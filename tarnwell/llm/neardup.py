"""Near-duplicate embeddings: all pairs of cosine at or over a threshold.

Vectors are rotated to their principal axes, which keeps cosines and puts what varies
first. Tiles of vectors meet pairwise. A product is accumulated over leading axes; what the
rest can add is bounded by the product of the norms that remain, and where that cannot
reach the threshold the pair is left. Tiles that are boxes of leading axes too far apart
do not meet at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tarnwell.llm.common import bounded_batches, components, written
from tarnwell.llm.vectors import packed, units

#: Vectors of a tile, and bytes of one as double; a group of tiles and one partner are what a
#: task holds.
TILE, TILE_BYTES = 8192, 8 << 20
#: Tiles of a group at most: a group meets a group in one task, so that a tile is shipped once
#: for as many meetings.
GROUP = 8
#: The axes and the boxes are fitted on at most so many numbers of vectors of least hash.
SAMPLE = 2_000_000
#: Leading axes that boxes are cut along, and vectors of the sample in a box at least.
AXES, BOX = 8, 64
#: Rounding of products; pairs this near the threshold are computed from the vectors as given.
NEAR = 1e-9


class Axes:
    """Principal axes of unit vectors, and boxes along the first of them."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
        at = sample @ self.turn
        variance = (at**2).mean(axis=0)
        rest = 1 - np.cumsum(variance)
        self.first = int(np.searchsorted(-rest, -0.75) + 1)  # axes after which about a quarter is done
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; negative: box -n-1
        self.boxes = 0

        def cut(rows, want):
            if want <= 1 or len(rows) < 2 * BOX:
                self.boxes += 1
                return -self.boxes
            axis = int(np.argmax(at[rows, :AXES].var(axis=0)))
            value = float(np.median(at[rows, axis]))
            left = at[rows, axis] <= value
            if left.all():
                self.boxes += 1
                return -self.boxes
            me = len(self.splits)
            self.splits.append((axis, value, 0, 0))
            a, b = cut(rows[left], want // 2), cut(rows[~left], want - want // 2)
            self.splits[me] = (axis, value, a, b)
            return me

        self.root = cut(np.arange(len(at)), boxes)

    def box(self, at: np.ndarray) -> np.ndarray:
        """The box of each turned vector."""
        node = np.full(len(at), self.root)
        while (node >= 0).any():
            for i in np.unique(node[node >= 0]):
                axis, value, a, b = self.splits[i]
                rows = np.flatnonzero(node == i)
                node[rows] = np.where(at[rows, axis] <= value, a, b)
        return -node - 1


def pairs_of(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float, first: int, same: bool):
    """Index pairs (i, j) of cosine >= threshold between unit rows a, b in axis order, a stretch
    of rows at a time; with ``same`` only i < j. ua, ub: the vectors as given, for pairs at the
    threshold."""
    d = a.shape[1]
    cuts = [0, *range(min(first, d), d, 16), d]
    rest_a = [np.sqrt(np.maximum((a[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    rest_b = [np.sqrt(np.maximum((b[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    least = threshold - NEAR
    for lo in range(0, len(a), 512):
        for to in range(lo // 2048 * 2048 if same else 0, len(b), 2048):
            x, y = a[lo : lo + 512, : cuts[1]], b[to : to + 2048, : cuts[1]]
            dot = x @ y.T
            i, j = np.nonzero(dot + np.outer(rest_a[1][lo : lo + 512], rest_b[1][to : to + 2048]) >= least)
            acc = dot[i, j]
            i, j = i + lo, j + to
            if same:
                ok = i < j
                i, j, acc = i[ok], j[ok], acc[ok]
            for k in range(1, len(cuts) - 1):
                if not len(i):
                    break
                acc = acc + np.einsum("nd,nd->n", a[i, cuts[k] : cuts[k + 1]], b[j, cuts[k] : cuts[k + 1]])
                ok = acc + rest_a[k + 1][i] * rest_b[k + 1][j] >= least
                i, j, acc = i[ok], j[ok], acc[ok]
            if len(i):
                edge = np.flatnonzero(acc < threshold + NEAR)
                if len(edge):
                    p, q = ua[i[edge]].astype(np.float64), ub[j[edge]].astype(np.float64)
                    acc[edge] = np.einsum("nd,nd->n", p, q) / np.sqrt(np.einsum("nd,nd->n", p, p) * np.einsum("nd,nd->n", q, q))
                ok = acc >= threshold
                if ok.any():
                    yield i[ok], j[ok]


class Meeting:
    """What two tiles, or one with itself, link: counts and components, but not pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None):
        self.a, self.b = a, a if b is None else b
        ids = a["id"] if b is None else np.concatenate([a["id"], b["id"]])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.node = np.empty(len(ids), np.int64)  # nodes in order of id
        self.node[order] = np.arange(len(ids))
        self.shift = 0 if b is None else len(a)
        self.root = np.arange(len(ids))
        self.more_a, self.more_b = np.zeros(len(self.a)), np.zeros(len(self.b))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.more_a += np.bincount(i, self.b["n"][j], len(self.a))
        self.more_b += np.bincount(j, self.a["n"][i], len(self.b))
        u, v = self.node[i], self.node[j + self.shift]
        while True:
            ru, rv = self.root[u], self.root[v]
            live = ru != rv
            if not live.any():
                return
            u, v, ru, rv = u[live], v[live], ru[live], rv[live]
            np.minimum.at(self.root, np.maximum(ru, rv), np.minimum(ru, rv))
            while not (self.root == (up := self.root[self.root])).all():
                self.root = up

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.ids[at], self.ids[self.root[at]]


_ROW = [("id", "<i8"), ("n", "<i8"), ("tid", "V16")]


def _links_of(classes: DataFrame, dim: int, count: int, threshold: float, single: bool = False) -> DataFrame:
    """u, v, tid, links: edges (a forest of each meeting of tiles) and parts of link counts
    of the classes(id, n, tid, body) of one dimension. ``single``: all components are floats of
    single precision and are shipped as such."""
    tile = max(1, min(TILE, TILE_BYTES // (8 * dim)))
    sample = classes.orderBy("tid").limit(max(1000, SAMPLE // dim)).select("body").collect()
    x = np.frombuffer(b"".join(bytes(r["body"]) for r in sample)).reshape(-1, dim)
    axes = Axes(x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True), -(-count // tile))
    record = np.dtype([*_ROW, ("v", "<f4" if single else "<f8", dim)])

    def unit(v):
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def to_boxes(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = np.frombuffer(b"".join(b.column("body").to_pylist())).reshape(-1, dim)
            at = unit(v) @ axes.turn
            rest = np.sqrt(np.maximum(1 - (at[:, :AXES] ** 2).sum(axis=1), 0))
            lead = np.column_stack([at[:, :AXES], rest])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("id", "n", "tid", "body")] + [pa.array(axes.box(at).astype(np.int32)), pa.array(lead.tolist(), pa.list_(pa.float64()))],
                ["id", "n", "tid", "body", "box", "lead"],
            )

    boxed = written(classes.select("id", "n", "tid", "body").mapInArrow(to_boxes, "id long, n long, tid binary, body binary, box int, lead array<double>"))
    m = min(AXES, dim) + 1
    bounds = boxed.groupBy("box").agg(F.count("*").alias("rows"), *[f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(m) for name, f in (("low", F.min), ("high", F.max))]).orderBy("box").collect()
    low = np.array([[r[f"low{k}"] for k in range(m)] for r in bounds])
    high = np.array([[r[f"high{k}"] for k in range(m)] for r in bounds])
    parts = [int(-(-r["rows"] // tile)) for r in bounds]
    first = np.cumsum([0, *parts]).tolist()  # tiles are numbered box by box
    far = 2 - 2 * threshold + NEAR
    meet = []
    for i in range(len(bounds)):
        gap = np.maximum(np.maximum(low[i:] - high[i], low[i] - high[i:]), 0)
        for j in np.flatnonzero((gap**2).sum(axis=1) <= far) + i:
            meet.append((int(bounds[i]["box"]), int(bounds[j]["box"]), first[i], first[i + 1] - 1, first[j], first[j + 1] - 1))
    meets = frozenset((m[0], m[1]) for m in meet)
    group = min(GROUP, max(1, first[-1] // 3))
    spark = classes.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(int(r["box"]), p, f) for r, p, f in zip(bounds, parts, first, strict=False)], "box int, parts int, first long"))  # a row per box

    def to_tiles(batches):
        for rows in units(batches, 2):
            out = np.empty(len(rows), record)
            out["id"], out["n"] = [r[2] for r in rows], [r[3] for r in rows]
            out["tid"] = np.frombuffer(b"".join(r[4] for r in rows), "V16")
            out["v"] = np.frombuffer(b"".join(r[5] for r in rows)).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([rows[0][1]], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["box", "tile", "blob"])

    tiles = written(
        boxed.join(sizes, "box")
        .select("box", (F.col("first") + F.pmod(F.xxhash64("tid"), F.col("parts"))).alias("tile"), "id", "n", "tid", "body")
        .repartition("box", "tile")
        .sortWithinPartitions("box", "tile")
        .mapInArrow(to_tiles, "box int, tile long, blob binary")
    )
    pairs = spark.createDataFrame(meet, "a int, b int, a0 long, a1 long, b0 long, b1 long")
    pairs = pairs.withColumn("i", F.explode(F.sequence("a0", "a1"))).withColumn("j", F.explode(F.sequence("b0", "b1"))).where("i <= j")
    pairs = pairs.select(F.expr(f"i div {group}").alias("g"), F.expr(f"j div {group}").alias("h"), "i", "j")
    # a group with itself is one side
    side = F.when(F.col("g") == F.col("h"), 0).otherwise(1)
    wanted = pairs.select("g", "h", F.lit(0).alias("side"), F.col("i").alias("tile")).unionByName(pairs.select("g", "h", side.alias("side"), F.col("j").alias("tile"))).distinct()

    def to_links(batches):
        shape = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("tid", pa.binary()), ("links", pa.int64())])

        def edges(u, v):
            for lo in range(0, len(u), 100_000):
                n = len(u[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + n]), pa.array(v[lo : lo + n]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=shape)

        def counts(x, more):
            at = np.flatnonzero(more)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array([t.tobytes() for t in x["tid"][at]], pa.binary()), pa.array(more[at].astype(np.int64))], schema=shape)

        def meeting(x, rx, y, ry, same):
            m = Meeting(x, None if same else y)
            for i, j in pairs_of(rx, ry, x["v"], y["v"], threshold, axes.first, same):
                m.add(i, j)
            yield from edges(*m.forest())
            if same:
                yield from counts(x, m.more_a + m.more_b)
            else:
                yield from counts(x, m.more_a)
                yield from counts(y, m.more_b)

        held, now = [], None
        for b in batches:
            for g, h, side, _, box, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, h) != now:
                    held, now = [], (g, h)
                x = np.frombuffer(blob, record)
                rx = unit(x["v"].astype(np.float64)) @ axes.turn
                for was, y, ry in held if side or g == h else ():
                    if (was, box) in meets:
                        yield from meeting(y, ry, x, rx, False)
                if not side:
                    held.append((box, x, rx))
                    if g == h:
                        yield from meeting(x, rx, x, rx, True)

    return (
        wanted.join(tiles, "tile")
        .select("g", "h", "side", "tile", "box", "blob")
        .repartition("g", "h")
        .sortWithinPartitions("g", "h", "side", "tile")
        .mapInArrow(to_links, "u long, v long, tid binary, links long")
    )


def near_duplicates(rows: DataFrame, threshold: float = 0.9, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows.

    n_links counts the other rows whose vectors have a cosine of at least ``threshold`` with
    this one's; component_id is the smallest vec_id that such links reach, itself included;
    kept says that it is its own. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing; so do vectors of different lengths with each
    other. Equal vectors, repeated rows among them, are one class that is compared once and
    counts as often as it comes. An empty table gives no rows. No limit on links: a meeting
    of two tiles gives counts and a forest, never its pairs.
    """
    bounded_batches(rows.sparkSession)
    base = written(packed(rows, vector, keep_zero=False))
    classes = base.where("dim > 0").groupBy("dim", "tid").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.max("body").alias("body"))
    classes = written(classes)
    single = isinstance(rows.schema[vector].dataType.elementType, FloatType)
    links = None
    for r in classes.groupBy("dim").count().orderBy("dim").collect():
        got = _links_of(classes.where(F.col("dim") == r["dim"]), r["dim"], r["count"], threshold, single)
        links = got if links is None else links.unionByName(got)
    if links is None:
        outcome = classes.select("tid", F.col("id").alias("root"), F.lit(0).cast("long").alias("links"), "n")
    else:
        links = written(links)
        counts = links.where("tid is not null").groupBy("tid").agg(F.sum("links").alias("links"))
        roots = components(links.where("tid is null").select("u", "v")).select(F.col("node").alias("id"), "root")
        outcome = classes.select("tid", "id", "n").join(counts, "tid", "left").join(roots, "id", "left").select("tid", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "n")
    return base.select("vec_id", "tid").join(outcome, "tid", "left").select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("root", "vec_id")).alias("kept"),
    )
