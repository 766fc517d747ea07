"""Measurement: exact latencies, outcomes, timelines, outages, run summaries, metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUCCESS = ("ok", "not_found")


def percentile(p: float, of: str) -> Column:
    """The exact nearest-rank percentile. p / 100 is the quotient of doubles, so ranks round
    as ceil(p / 100 * n) does in doubles."""
    return F.expr(f"percentile_disc({p}D / 100D) within group (order by {of})")


def latency_stats(samples: DataFrame, by: list[str], of: str = "ns") -> DataFrame:
    """AGG-09: count and exact statistics of nanoseconds, in microseconds."""
    ranks = {"p50": 50, "p90": 90, "p95": 95, "p99": 99, "p999": 99.9}
    return samples.groupBy(*by).agg(
        F.count(of).alias("n"),
        (F.min(of) / 1e3).alias("min_us"),
        F.round(F.sum(F.col(of).cast("decimal(38,0)")).cast("double") / F.count(of) / 1e3, 6).alias("mean_us"),
        *[(percentile(p, of) / 1e3).alias(f"{name}_us") for name, p in ranks.items()],
        (F.max(of) / 1e3).alias("max_us"),
    )


def outcome_class(known: Column, err: Column, status: Column) -> Column:
    """PRJ-03: how an operation ended for its client."""
    return (
        F.when(~known, "unknown")
        .when((F.coalesce(err, F.lit("")) == "") & (status == "OK"), "ok")
        .when(status == "NOT_FOUND", "not_found")
        .otherwise("refused")
    )


def outcome_counts(ops: DataFrame, classes: list[str]) -> DataFrame:
    """AGG-12: operations by op, a column per class, and how many latencies leave out."""
    cols = [F.count_if(F.col("class") == c).alias(c) for c in classes]
    return ops.groupBy("op").agg(F.count("*").alias("total"), *cols, F.count_if(~F.col("class").isin(*SUCCESS)).alias("excluded"))


def throughput(ops: DataFrame, start: int, end: int) -> DataFrame:
    """AGG-13, FLT-09, STR-05: per run, successes that complete in [start, end) per second, and
    operations due in the window that end after it, which count as late and keep their latency."""
    done = F.col("class").isin(*SUCCESS) & (F.col("done_ns") >= start) & (F.col("done_ns") < end)
    late = (F.col("intended_ns") >= start) & (F.col("done_ns") >= end)
    return ops.groupBy("run").agg(
        F.count_if(done).alias("in_window"),
        F.count_if(late).alias("late"),
        F.count_if(F.col("intended_ns") < start).alias("warm_up"),
        F.round(F.count_if(done) / F.lit((end - start) / 1e9), 6).alias("per_second"),
    )


def timeline(ops: DataFrame, bucket: int, buckets: int) -> DataFrame:
    """WIN-01: per run and bucket of completion, successes and failures; empty buckets too."""
    ok = F.col("class").isin(*SUCCESS)
    counts = ops.groupBy("run", F.floor(F.col("done_ns") / bucket).cast("int").alias("b")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    spine = ops.select("run").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    zero = F.lit(0).cast("long")
    return spine.join(counts, ["run", "b"], "left").select("run", "b", F.coalesce("ok", zero).alias("ok"), F.coalesce("failed", zero).alias("failed"))


def longest_outage(points: DataFrame, bucket: int, start: int, end: int) -> DataFrame:
    """WIN-02: per run, the longest stretch of whole buckets in [start, end) without success.
    A running count of buckets with one names the stretches; no buckets give 0."""
    inside = (F.col("b") * bucket >= start) & ((F.col("b") + 1) * bucket <= end)
    w = Window.partitionBy("run").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    stretch = points.where(inside).withColumn("island", F.sum((F.col("ok") > 0).cast("long")).over(w))
    runs = stretch.where("ok = 0").groupBy("run", "island").agg((F.count("*") * bucket).alias("ns")).groupBy("run").agg(F.max("ns").alias("ns"))
    return points.select("run").distinct().join(runs, "run", "left").select("run", F.coalesce("ns", F.lit(0)).cast("long").alias("outage_ns"))


def run_summary(values: DataFrame, by: list[str]) -> DataFrame:
    """AGG-14: median (mean of the middle two), extremes, spread over the median, and p95 from
    ten runs on."""
    spread = F.when(F.median("value") != 0, (F.max("value") - F.min("value")) / F.median("value")).otherwise(0.0)
    return values.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.round(F.median("value"), 9).alias("median"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.round(spread, 9).alias("spread"),
        F.when(F.count("value") >= 10, percentile(95, "value")).alias("p95"),
    )


def counter_deltas(before: DataFrame, after: DataFrame, restarted: Column) -> DataFrame:
    """AGG-17, JOI-09 of scrapes(node, name, value): what counters gained; from zero where the
    node restarted, but a durable index is always a difference."""
    joined = after.select("node", "name", F.col("value").alias("b")).join(before.select("node", "name", F.col("value").alias("a")), ["node", "name"], "full_outer")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return joined.select("node", "name", F.when(restarted & ~F.col("name").endswith("_index"), b).otherwise(b - a).alias("delta"))


def unknown_cause(err: Column, attempts: Column) -> Column:
    """PRJ-05: why an operation ended unknown. The last attempt left in doubt decides, and
    whether all after it were definite refusals."""

    def broken(x):
        return F.coalesce(x["err"], F.lit("")) != ""

    def unsent(x):
        return x["err"].contains("node unavailable")

    def in_doubt(x):
        return F.when(broken(x), ~unsent(x)).otherwise(F.coalesce(x["status"] == "UNKNOWN_OUTCOME", F.lit(False)))

    def refused(x):
        return F.when(broken(x), unsent(x)).otherwise(F.coalesce(x["status"].isin("UNAVAILABLE", "NOT_LEADER", "LOST", "SESSION_LIMIT"), F.lit(False)))

    n = F.size(attempts)
    last = F.coalesce(F.array_max(F.transform(attempts, lambda x, i: F.when(in_doubt(x), i).otherwise(-1))), F.lit(-1))
    rest = F.slice(attempts, last + 2, F.greatest(n - last - 1, F.lit(0)))
    cancelled = F.coalesce(err.contains("context canceled") | err.contains("context deadline exceeded"), F.lit(False))
    return (
        F.when(cancelled, "cancelled")
        .when(last < 0, "other")
        .when(last == n - 1, "unanswered at give-up")
        .when(F.forall(rest, refused), "refused until give-up")
        .otherwise("other")
    )


def bucket_of(value: Column, uppers: list[float]) -> Column:
    """AGG-19: the first upper bound not below a value, +Infinity beyond; null for NaN."""
    out = F.lit(float("inf"))
    for u in reversed(uppers):
        out = F.when(value <= u, F.lit(u)).otherwise(out)
    return F.when(~F.isnan(value), out)


def histogram(samples: DataFrame, by: str, value: str, uppers: list[float]) -> DataFrame:
    """AGG-19, AGG-20: counts of values at or below each bound, empty buckets too."""
    counts = samples.withColumn("le", bucket_of(F.col(value), uppers)).where("le is not null").groupBy(by, "le").agg(F.count("*").alias("n"))
    bounds = F.array(*[F.lit(float(u)) for u in [*uppers, float("inf")]])
    spine = samples.select(by).distinct().withColumn("le", F.explode(bounds))
    w = Window.partitionBy(by).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    filled = spine.join(counts, [by, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(by, "le", F.col("n").cast("long").alias("n"), F.sum("n").over(w).cast("long").alias("cumulative"))


def exponential_buckets(start: float, factor: float, n: int) -> Column:
    """WIN-12: start, and each the one before times factor, as repeated products give them."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(start / factor), lambda x, _: x * factor)) if n > 0 else F.array().cast("array<double>")


def select_series(samples: DataFrame, name: str, **labels: str) -> DataFrame:
    """FLT-04: series of a name whose labels hold all given pairs."""
    found = samples.where(F.col("name") == name)
    for k, v in labels.items():
        found = found.where(F.col("labels")[k] == v)
    return found


def series_sum(samples: DataFrame, name: str, **labels: str) -> DataFrame:
    """AGG-18: the sum over them, and the value if there is exactly one."""
    s = select_series(samples, name, **labels)
    return s.agg(F.count("*").alias("series"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"), F.when(F.count("*") == 1, F.round(F.max("value"), 6)).alias("single"))


def due_times(ops: DataFrame, interval_ns: int) -> DataFrame:
    """STR-07: open-loop due times start + k * interval, and latency from then on, whenever
    an operation was really sent."""
    due = F.col("k") * interval_ns
    return ops.withColumn("due_ns", due).withColumn("from_due_ns", F.col("done_ns") - due)


def capped(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """SRT-08: of each run the first ``most`` traces, and how many more there were."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("n", n).groupBy(by).agg(F.count_if(F.col("n") <= most).alias("kept"), F.count_if(F.col("n") > most).alias("dropped"))
