"""Rules on requests and runs: what is refused, which status an error has, why messages drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses by error; any other error leaves the outcome unknown.
STATUSES = {"not leader": "NOT_LEADER", "lost": "LOST", "entry too large": "INVALID", "busy": "UNAVAILABLE"}


def request_fault(op: Column, key: Column, value: Column, client: Column, request: Column, acked: Column) -> Column:
    """FLT-11: why a request is refused, or ok. A registration has no fields; others have a key, a
    value only to put, and a whole identity or none."""
    none = (request == 0) & (acked == 0)
    return (
        F.when(op == "register", F.when((key == "") & (value == "") & (client == 0) & none, "ok").otherwise("register with fields"))
        .when(key == "", "empty key")
        .when((op != "put") & (value != ""), "value without put")
        .when(client == 0, F.when(none, "ok").otherwise("identity without client"))
        .when((request == 0) | (acked == 0) | (acked > request), "bad identity")
        .otherwise("ok")
    )


def status_of(err: Column) -> Column:
    """PRJ-04: the status that an error is answered with."""
    return F.coalesce(*[F.when(err == e, F.lit(s)) for e, s in STATUSES.items()], F.lit("UNKNOWN_OUTCOME"))


def drops(messages: DataFrame, malformed: Column, hosted: Column) -> DataFrame:
    """AGG-36: dropped messages by reason: unreadable first, then of groups not hosted here, and
    the rest for want of room."""
    reason = F.when(malformed, "malformed").when(~hosted, "unknown_group").otherwise("inbox_full")
    return messages.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def crash_outcomes(runs: DataFrame, by: str) -> DataFrame:
    """AGG-40: of runs(fired, sound, settled) by crash point: how many there were, and how many
    survived, which needs that the fault fired, nothing was violated, and all converged."""
    survived = F.col("fired") & F.col("sound") & F.col("settled")
    return runs.groupBy(F.col(by).alias("point")).agg(F.count("*").alias("runs"), F.count_if(survived).alias("survived"))


def uniform(seed: int, at: Column) -> Column:
    """GEN-01: a number in [0, 1) from a seed and a position, the same on every engine: 52 bits
    of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), at.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def skewed_rank(u: Column, keys: int, skew: float) -> Column:
    """GEN-01: a rank from 0 to keys - 1 whose chance falls as a power of it (skew below 1), by
    the inverse of the continuous law."""
    power = 1 - skew
    return F.least(F.floor(F.pow(u * ((keys + 1) ** power - 1) + 1, F.lit(1 / power))) - 1, F.lit(keys - 1)).cast("long")


def phase_of(at: Column, warm_up: int, measured: int) -> Column:
    """GEN-02: which phase of a run an operation belongs to."""
    return F.when(at < warm_up, "warm-up").when(at < warm_up + measured, "measured").otherwise("cool-down")
