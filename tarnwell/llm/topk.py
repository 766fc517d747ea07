"""Exact top-k search by inner product, with block-at-a-time pruning.

Rows are dealt into shards; within a shard they are ordered so that neighbours are alike,
and cut into blocks. A block keeps the largest and smallest value of each term, and its
rows (the forward index). A query orders a shard's blocks by the sum of what each term
can add at most, scores blocks in that order, and stops where that sum is below the k-th
best score so far. A task takes a chunk of queries through several shards, so that later
shards meet a bound from earlier ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell.llm.common import bounded_batches, written
from tarnwell.llm.vectors import halves, packed, units

#: Rows of a shard, of a block, and of a chunk of queries; shards that a task takes in turn.
SHARD, BLOCK, CHUNK, TURN = 16_384, 128, 4096, 2

#: Scores that a task holds before it cuts them to the k best of each query.
HELD = 1_000_000


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integral rows, as int64; by doubles where these are exact."""
    if not len(q) or not len(x) or np.abs(q).sum(axis=1).max() * np.abs(x).max() < 2**53:
        return (q @ x.T).astype(np.int64)
    wide = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q]
    return np.array(wide, np.int64)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(queries, np.iinfo(np.int64).min)
        self.kth_id = np.full(queries, np.iinfo(np.int64).max)

    def add(self, query, score, id_) -> None:
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[q[last]] = s[last]
        self.kth_id[q[last]] = i[last]
        self.query, self.score, self.id = q[keep], s[keep], i[keep]


def search_shard(best: Best, q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, block: int) -> int:
    """best, after the rows x in their order, cut into blocks. Returns the blocks scored."""
    order = halves(x, block)
    x, x_id = x[order], x_id[order]
    starts = np.arange(0, len(x), block)
    high = np.maximum.reduceat(x, starts, axis=0)
    low = np.minimum.reduceat(x, starts, axis=0)
    most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # of each query in each block
    slack = 0.0 if np.abs(most).max() < 2**53 else np.abs(most).max() * 1e-12
    turn = np.argsort(-most, axis=1, kind="stable")
    done, take, scored = 0, 1, 0
    while done < len(starts):
        ahead = turn[:, done : done + take]
        live = np.take_along_axis(most, ahead, axis=1) + slack >= best.kth[:, None].astype(float)
        if not live.any():
            break  # bounds only fall along a query's order
        who, col = np.nonzero(live)
        which = ahead[who, col]
        by = np.argsort(which, kind="stable")
        who, which = who[by], which[by]
        got, held = [], 0
        for lo in np.flatnonzero(np.r_[True, which[1:] != which[:-1]]):
            hi = np.searchsorted(which, which[lo], "right")
            at = slice(starts[which[lo]], starts[which[lo]] + block)
            rows = who[lo:hi]
            s = exact_scores(q[rows], x[at])
            kth, own = best.kth[rows][:, None], x_id[at][None, :]
            ok = ((s > kth) | ((s == kth) & (own < best.kth_id[rows][:, None]))) & (q_id[rows][:, None] != own)
            r, c = np.nonzero(ok)
            got.append((rows[r], s[r, c], x_id[at][c]))
            held += len(r)
            scored += hi - lo
            if held > HELD:  # many equal scores: take stock before going on
                best.add(*(np.concatenate(g) for g in zip(*got, strict=True)))
                got, held = [], 0
        if got:
            best.add(*(np.concatenate(g) for g in zip(*got, strict=True)))
        done, take = done + take, take * 2
    return scored


def _floor64(x: np.ndarray) -> np.ndarray:
    return np.floor(64.0 * x)


def _small(v: np.ndarray) -> bytes:
    """Integral values in the smallest of four types, named by the first byte."""
    top = np.abs(v).max() if v.size else 0
    for code, kind, limit in ((b"1", "<i1", 127), (b"2", "<i2", 32767), (b"4", "<i4", 2**31 - 1)):
        if top <= limit:
            return code + v.astype(kind).tobytes()
    return b"8" + v.astype("<f8").tobytes()


def _wide(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {b"1": "<i1", b"2": "<i2", b"4": "<i4", b"8": "<f8"}[raw[:1]], offset=1).reshape(-1, dim).astype(float)


def top_k(rows: DataFrame, is_query, k: int = 20, change=_floor64, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the column ``is_query`` holds,
    the ``k`` rows of highest inner product among all others (all, if there are fewer),
    equal scores by smaller vec_id.

    Components are changed to integers by ``change`` first; scores are exact. Vectors that are
    null, empty or hold null or non-finite components take no part, nor do rows without
    vec_id; vectors of different lengths do not meet. A candidate with the query's vec_id is
    its own row. A query row that is repeated is one query; other repeated rows are as many
    candidates. An empty table gives no rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    flagged = rows.where("vec_id is not null")
    base = written(packed(flagged, vector, change).where("dim > 0"))
    ids = flagged.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    queries = base.join(ids, "vec_id", "left_semi").dropDuplicates(["vec_id", "dim", "tid"])
    sizes = base.groupBy("dim").agg(F.count("*").alias("n")).collect()
    counts = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    plan = [(r["dim"], -(-r["n"] // SHARD), -(-counts[r["dim"]] // CHUNK)) for r in sizes if r["dim"] in counts]
    shape = F.broadcast(spark.createDataFrame(plan, "dim int, shards int, chunks int"))  # a row per vector length

    def blobs(df, parts):
        def run(batches):
            for part in units(batches, 2):
                v = np.frombuffer(b"".join(r[4] for r in part)).reshape(-1, part[0][0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[0][0]], pa.int32()), pa.array([part[0][1]], pa.int32()), pa.array([np.array([r[2] for r in part], "<i8").tobytes()], pa.binary()), pa.array([b"".join(r[3] for r in part)], pa.binary()), pa.array([_small(v)], pa.binary())],
                    ["dim", "part", "ids", "tids", "body"],
                )

        return (
            df.join(shape, "dim")
            .select("dim", F.pmod(F.xxhash64("vec_id", "tid"), F.col(parts)).cast("int").alias("part"), "vec_id", "tid", "body")
            .repartition("dim", "part")
            .sortWithinPartitions("dim", "part", "vec_id", "tid")
            .mapInArrow(run, "dim int, part int, ids binary, tids binary, body binary")
        )

    turns = F.ceil(F.col("shards") / TURN).cast("int")
    # every chunk with every run of shards: the stated queries against all rows, in blocks
    asked = blobs(queries, "chunks").join(shape, "dim").select("dim", F.col("part").alias("chunk"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), F.lit(0).alias("side"), F.lit(0).alias("part"), "ids", "tids", "body")
    held = blobs(base, "shards").join(shape, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), (F.col("part") % turns).cast("int").alias("turn"), F.lit(1).alias("side"), "part", "ids", "tids", "body")

    def run(batches):
        best = q = q_id = tids = None
        now = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(q_id[best.query]), pa.array([tids[i] for i in best.query.tolist()], pa.binary()), pa.array(best.id), pa.array(best.score)], ["query_id", "tid", "vec_id", "score"])

        for b in batches:
            for dim, chunk, turn, side, _, ids, tid, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (dim, chunk, turn) != now:
                    if best is not None:
                        yield out()
                    now, best = (dim, chunk, turn), None
                if side == 0:
                    q, q_id = _wide(body, dim), np.frombuffer(ids, "<i8")
                    tids = [tid[i : i + 16] for i in range(0, len(tid), 16)]
                    best = Best(len(q), k)
                elif best is not None:
                    search_shard(best, q, q_id, _wide(body, dim), np.frombuffer(ids, "<i8"), BLOCK)
        if best is not None:
            yield out()

    found = (
        asked.unionByName(held)
        .repartition("dim", "chunk", "turn")
        .sortWithinPartitions("dim", "chunk", "turn", "side", "part")
        .mapInArrow(run, "query_id long, tid binary, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "tid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
