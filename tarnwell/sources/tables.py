"""The driver's tables as tables of the store's planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """versions(key, seq, kind, value): an event is a version of its user; an error is a tombstone (0)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("kind"),
        "value",
    )


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """versions(key, seq, kind, value, file): an order is a version of its customer; a finished
    one is a tombstone; files hold runs of 500 sequence numbers, as flushes make them."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("kind"),
        F.col("o_totalprice").alias("value"),
        F.floor(F.col("o_orderkey") / 500).alias("file"),
    )


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_log(event_id, run, client, op, class, intended_ns, done_ns, ns): an event is an operation
    of its user, a day is a run, and the value is the latency in milliseconds."""
    return op_log_of(table(spark, sf_dir, "events"))


def op_log_of(e: DataFrame) -> DataFrame:
    """The same of any table, or stream, of events."""
    kind, user = F.col("event_type"), F.col("user_id")
    op = F.when(kind.isin("view", "click"), "get").when(kind == "purchase", "put").when(kind == "signup", "delete").otherwise("put")
    ended = (
        F.when(kind == "error", "unknown")
        .when((kind == "click") & (user % 3 == 0), "not_found")
        .when((kind == "signup") & (user % 4 == 0), "refused")
        .otherwise("ok")
    )
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.date_trunc("day", F.col("ts")).cast("timestamp"))) * 1000
    ns = F.floor(F.col("value") * 1_000_000)
    return e.select("event_id", F.to_date("ts").alias("run"), user.alias("client"), op.alias("op"), ended.alias("class"), since.alias("intended_ns"), (since + ns).alias("done_ns"), ns.alias("ns"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of operations on registers: an event is an operation of one of four clients on its
    user's key. Reads return what the writes before them left, but for some planted wrong ones,
    so that the other keys' histories are linearizable."""
    e, i, u, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id"), F.col("event_type")
    op = F.when(kind.isin("purchase", "signup"), "put").when(kind == "error", "delete").otherwise("get")
    h = e.select(
        F.lit("h").alias("history"), i.alias("id"), F.concat(F.lit("c"), u % 4).alias("client"), op.alias("kind"), F.concat(F.lit("k"), u).alias("key"),
        F.when(op == "put", F.concat(F.lit("v"), i)).alias("value"), (i * 16 + 2).alias("invoke"), (i * 16 + (u % 3) * 18 + 7).alias("ended"),
    )
    refused = F.col("id") % 37 == 0
    left = F.when(~refused & (F.col("kind") == "put"), F.col("value")).when(~refused & (F.col("kind") == "delete"), "")
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("prior", F.nullif(F.last(left, ignorenulls=True).over(w), F.lit("")))
    outcome = F.when(F.col("kind") != "get", F.when(refused, "rejected").when(F.col("id") % 29 == 0, "incomplete").otherwise("ok")).when(F.col("prior").isNull(), "notfound").otherwise("ok")
    h = h.withColumn("outcome", outcome)
    output = F.when((F.col("kind") == "get") & (F.col("outcome") == "ok"), F.when(F.col("id") % 211 == 0, "wrong").otherwise(F.col("prior")))
    none = F.lit(0).cast("long")
    return h.select("history", "id", "client", "kind", "key", "value", "invoke", F.when(F.col("outcome") == "incomplete", 0).otherwise(F.col("ended")).alias("complete"), "outcome", output.alias("output"), none.alias("client_id"), none.alias("request_id"), F.lit(None).cast("string").alias("node"), none.alias("term"), none.alias("index"))
