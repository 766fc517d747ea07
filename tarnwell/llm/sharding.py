"""Dealing documents into shards of near equal bytes by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell.llm.common import written

DIMENSIONS = ("size", "tokens", "one")
#: Buckets of doc_id within a shard; slots are numbered bucket by bucket.
SLOT_BUCKETS = 512


def piece_of(pieces):
    """The piece of a split group that a row belongs to."""
    return F.pmod(F.xxhash64(F.lit(7), "doc_id"), pieces).cast("int")


def place(items: np.ndarray, shards: int, weights=(1.0, 1.0, 1.0)) -> np.ndarray:
    """A shard for each item (rows of bytes, tokens, rows as shares of all): largest item
    first, each where the dot product with the residual capacity is highest; ties go to
    the smaller shard."""
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    w = np.asarray(weights)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.sum(axis=1))):
        s = int(np.argmax(left @ (items[i] * w)))
        out[i] = s
        left[s] -= items[i]
    return out


def level(items: np.ndarray, of: np.ndarray, shards: int, close: float = 0.002, moves: int = 2000) -> np.ndarray:
    """of, after single items have moved from the fullest shard to the emptiest in bytes,
    as long as these differ by over ``close`` of a shard and a move brings them nearer."""
    of, size = of.copy(), items[:, 0]
    load = np.bincount(of, size, shards)
    for _ in range(moves):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        at = np.flatnonzero((of == high) & (size > 0) & (size < gap))
        if gap <= close / shards or not len(at):
            break
        i = at[np.argmin(np.abs(size[at] - gap / 2))]
        of[i] = low
        load[high] -= size[i]
        load[low] += size[i]
    return of


def shard(docs: DataFrame, shards: int = 24, items_per_shard: int = 1024, whole: float = 0.5, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Rows of equal text are a group, placed as a whole. What is placed, on the driver, is
    a bounded number of items, at most 4 * shards * items_per_shard (and the pieces of
    split groups): a group that holds over 1/(shards * items_per_shard) of all bytes,
    tokens or rows is an item; the smaller ones are gathered by hash into as many cells,
    each an item. Only a group over ``whole`` of a shard is split, by doc_id, into equal
    pieces, since no shard could take it and stay level.

    A null text has size 8, checksum 0 and is a group of its own; an empty text likewise.
    Repeated rows are placed together, each with its own slot. An empty table gives no
    rows. Law ``bytes``: sizes of shards are near equal; grown_shard is null.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    narrow = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.size(F.split(F.trim(t), "[ \t\n\r]+")), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(t.isNull(), t).alias("group"),
            F.lit(1).cast("long").alias("one"),
        )
    )
    total = narrow.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    if not total["one"]:
        return narrow.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    cells = shards * items_per_shard
    share = {d: F.col(d) / F.lit(float(total[d] or 1)) for d in DIMENSIONS}
    groups = narrow.groupBy("group").agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
    largest = F.greatest(*share.values())
    items = (
        groups.withColumn("large", largest > 1.0 / cells)
        .withColumn("item", F.when(F.col("large"), F.col("group")).otherwise(F.pmod("group", F.lit(cells))))
        .groupBy("large", "item")
        .agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
        .orderBy("large", "item")
        .toPandas()
    )
    whole_of = np.array([float(total[d] or 1) for d in DIMENSIONS])
    vectors = items[list(DIMENSIONS)].to_numpy(float) / whole_of
    pieces = np.where(items["large"], np.ceil(vectors.max(axis=1) * shards / whole), 1).astype(int).clip(1)
    vectors = np.repeat(vectors / pieces[:, None], pieces, axis=0)
    if (pieces > 1).any():  # the pieces as doc_id deals them
        split = {int(g): int(n) for g, n in zip(items["item"], pieces, strict=True) if n > 1}
        parts = F.broadcast(spark.createDataFrame(list(split.items()), "group long, pieces int"))
        got = narrow.join(parts, "group").withColumn("piece", piece_of(F.col("pieces"))).groupBy("group", "piece").agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
        first = {g: int(a) for g, a, big in zip(items["item"], np.cumsum(pieces) - pieces, items["large"], strict=True) if big}
        for g in split:
            vectors[first[g] : first[g] + split[g]] = 0
        for r in got.collect():
            vectors[first[r["group"]] + r["piece"]] = np.array([r[d] for d in DIMENSIONS]) / whole_of
    of = level(vectors, place(vectors, shards), shards)
    first = np.cumsum(pieces) - pieces
    placed = [(bool(g), int(i), [int(s) for s in of[a : a + n]]) for g, i, a, n in zip(items["large"], items["item"], first, pieces, strict=True)]
    rows = spark.createDataFrame(placed, "large boolean, item long, shards array<int>")
    # both sides are bounded by the number of items, whatever the input
    large = F.broadcast(rows.where("large").select(F.col("item").alias("group"), F.col("shards").alias("of_group")))
    small = F.broadcast(rows.where("not large").select(F.col("item").alias("cell"), F.col("shards").alias("of_cell")))
    at = F.coalesce("of_group", "of_cell")
    dealt = (
        narrow.withColumn("cell", F.pmod("group", F.lit(cells)))
        .join(large, "group", "left")
        .join(small, "cell", "left")
        .withColumn("shard", F.element_at(at, piece_of(F.size(at)) + 1))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "bucket")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "bucket"])  # shards * SLOT_BUCKETS rows at most
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
