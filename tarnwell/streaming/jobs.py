"""Structured Streaming twins of batch operators.

Each runs what is there (availableNow) through a checkpointed query whose updates are
appended to a table with their batch; the last update of a key is its result. A restart
continues from the checkpoint, and a batch that is written again replaces itself.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwell.operators import measure, sessions, storage


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; on one machine only, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tarnwell-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")


def last_updates(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream over what is there; the last update of each key."""
    spark = stream.sparkSession
    at = shared_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields]).add("__batch", T.IntegerType())).parquet(f"{at}/out/*")
    rest = [c for c in stream.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("v"))
    return last.select(*keys, "v.*")


def timeline(ops: DataFrame, bucket: str = "1 hour", late: str = "1 day") -> DataFrame:
    """STR-04: successes and failures by bucket of completion of ops(done, class)."""
    ok = F.col("class").isin(*measure.SUCCESS)
    counts = ops.withWatermark("done", late).groupBy(F.window("done", bucket)).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    return last_updates(counts.select(F.col("window.start").alias("start"), "ok", "failed"), ["start"])


def latest(versions: DataFrame) -> DataFrame:
    """AGG-01 over a stream: the state is a row per key; tombstones are kept until the end."""
    got = last_updates(storage.latest(versions), ["key"])
    return got.where("kind = 1").select("key", "seq", "value")


def session_decisions(commands: DataFrame, max_sessions: int = sessions.MAX_SESSIONS, max_unacked: int = sessions.MAX_UNACKED) -> DataFrame:
    """STR-01, STR-02: FSM-01 as a state per group. Commands of a trigger are sorted, and one at
    or below the applied index is skipped, so that a batch that comes again does nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = sessions.Sessions(max_sessions, max_unacked)
        applied = 0
        if state.exists:
            applied, raw = state.get
            table.table = pickle.loads(raw)
        pdf = pd.concat(list(frames)).sort_values("index")
        pdf = pdf[pdf["index"] > applied]
        got = [table.decide(*r) for r in zip(pdf["index"], pdf["op"], pdf["client_id"], pdf["request_id"], pdf["acked_below"], pdf["fp"], strict=True)]
        if len(pdf):
            state.update((int(pdf["index"].max()), pickle.dumps(table.table)))
        yield pd.DataFrame({"grp": pd.Series([key[0]] * len(pdf), dtype="int64"), "index": pdf["index"].to_numpy(), "decision": [g[0] for g in got], "reported": pd.Series([g[1] for g in got], dtype="int64")})

    out = commands.select("grp", "index", "op", "client_id", "request_id", "acked_below", "fp").groupBy("grp").applyInPandasWithState(step, sessions.DECISIONS, "applied long, table binary", "update", GroupStateTimeout.NoTimeout)
    return last_updates(out, ["grp", "index"])
