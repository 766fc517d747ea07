"""Placement: token rings, successor lookup, replica groups, what a change moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell import functions as fn

VNODES = 128
#: Bits of a token that name a bucket of the successor join.
_BUCKET = 2**56
_TOP = 2**64 - 1


def shard_ring(spark: SparkSession, shards: int) -> DataFrame:
    """SRT-03: (token, owner, vnode) of every shard; shards * 128 rows."""
    p = spark.range(shards * VNODES).select(F.floor(F.col("id") / VNODES).cast("int").alias("owner"), (F.col("id") % VNODES).cast("int").alias("vnode"))
    return p.select(fn.shard_token(F.col("owner"), F.col("vnode")).alias("token"), "owner", "vnode")


def node_ring(spark: SparkSession, nodes: list[str]) -> DataFrame:
    p = spark.createDataFrame([(n,) for n in sorted(nodes)], "owner string").withColumn("vnode", F.explode(F.sequence(F.lit(0), F.lit(VNODES - 1))))
    return p.select(fn.node_token(F.col("owner"), F.col("vnode")).alias("token"), "owner", "vnode")


def arcs(ring: DataFrame) -> DataFrame:
    """Arcs (low, high] of each point: the tokens it is the successor of. The first point
    also takes what lies past the last, as an arc of its own. A ring is small, so one task
    orders it."""
    w = Window.orderBy("token", "owner", "vnode")
    ordered = ring.withColumn("low", F.lag("token").over(w)).withColumn("n", F.row_number().over(w))
    last = F.max("token").over(Window.partitionBy())
    ordered = ordered.withColumn("last", last)
    plain = ordered.select("owner", F.coalesce("low", F.lit(-1).cast("decimal(20,0)")).alias("low"), F.col("token").alias("high"))
    wrap = ordered.where("n = 1").select("owner", F.col("last").alias("low"), F.lit(str(_TOP)).cast("decimal(20,0)").alias("high"))
    return plain.unionByName(wrap).where("low < high")


def successor(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """JOI-01: keys(token, ...) with the owner of the first point at or past their token.

    Arcs are listed under each value of the top byte that they span, which makes an equi-join
    with a range test of it: no nested loop, and one match per key. The ring side has a row
    per point and bucket, shards * 128 + 256 at most, so it may be broadcast."""
    low, high = F.expr(f"greatest(low + 1, 0) div {_BUCKET}"), F.expr(f"high div {_BUCKET}")
    listed = arcs(ring).withColumn("bucket", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    k = keys.withColumn("bucket", F.expr(f"token div {_BUCKET}").cast("int"))
    met = k.join(F.broadcast(listed), "bucket").where("token > low and token <= high")
    return met.drop("bucket", "low", "high")


def route(keys: DataFrame, key: str, shards: int) -> DataFrame:
    """Keys with their shard."""
    with_token = keys.withColumn("token", fn.token_of(F.col(key).cast("binary")))
    return successor(with_token, shard_ring(keys.sparkSession, shards)).withColumnRenamed("owner", "shard")


def replica_groups(spark: SparkSession, shards: int, nodes: list[str], rf: int) -> DataFrame:
    """JOI-02: (shard, replicas): clockwise from its anchor, the first rf different nodes.

    The distance of a node is that of its nearest point clockwise; the rf smallest distances
    are the group, in that order. shards * nodes * 128 distances, each a subtraction."""
    anchors = spark.range(shards).select(F.col("id").cast("int").alias("shard")).withColumn("anchor", fn.anchor_token(F.col("shard")))
    points = F.broadcast(node_ring(spark, nodes).groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("token", "owner")).alias("points")))
    each = anchors.withColumn("one", F.lit(1)).join(points, "one").select("shard", "anchor", F.explode("points").alias("p")).select("shard", "anchor", "p.token", "p.owner")
    wide = F.col("token").cast("decimal(21,0)") - F.col("anchor")
    gap = F.when(wide < 0, wide + F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(wide)
    near = each.groupBy("shard", "owner").agg(F.min(gap).alias("gap"))
    return near.groupBy("shard").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("gap", "owner"))), lambda x: x["owner"]), 1, rf).alias("replicas"))


def redistribution(spark: SparkSession, shards: int, before: list[str], after: list[str]) -> DataFrame:
    """JOI-10: how many shards get another primary when nodes change, and how many would if
    shards were dealt by remainder."""
    a = replica_groups(spark, shards, before, 1).select("shard", F.col("replicas")[0].alias("a"))
    b = replica_groups(spark, shards, after, 1).select("shard", F.col("replicas")[0].alias("b"))
    return a.join(b, "shard").agg(
        F.count_if(F.col("a") != F.col("b")).alias("moved"),
        F.count_if(F.col("shard") % len(before) != F.col("shard") % len(after)).alias("moved_by_modulo"),
        F.count("*").alias("shards"),
    )


def ownership(ring: DataFrame) -> DataFrame:
    """AGG-30: the share of the token space of each owner."""
    span = F.sum((F.col("high").cast("decimal(21,0)") - F.greatest(F.col("low"), F.lit(-1).cast("decimal(20,0)"))).cast("decimal(38,0)"))
    return arcs(ring).groupBy("owner").agg(F.round(span.cast("double") / float(2**64), 9).alias("share"))


def group_faults(groups: DataFrame, rf: int) -> DataFrame:
    """SET-07: replica groups that are empty, repeat a node or have the wrong size."""
    r = F.col("replicas")
    fault = F.when(F.size(r) == 0, "empty").when(F.size(F.array_distinct(r)) < F.size(r), "repeated").when(F.size(r) != rf, "size")
    return groups.withColumn("fault", fault).where("fault is not null").select("shard", "fault")
