"""Queries against their SQL on tables with what the given ones lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import storage
from tarnwell.plans import catalogue
from tarnwell.plans.history_queries import commands
from tests.test_goldens import Model


def test_entry_validation_of_empty_texts(spark, tmp_path):
    """Empty and null texts, with planted empty keys and without, and lengths at the limits."""
    texts = ["", None, "x", "é" * 2048, "é" * 2049, "x" * 4096, "x" * 4097, "x" * (1 << 20), "x" * ((1 << 20) + 1)]
    rows = [(i, t) for k, t in enumerate(texts) for i in (50 * k, 50 * k + 1, -50 * k, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["entry_validation"]).fetchall()
    got = catalogue.QUERIES["entry_validation"](spark, str(tmp_path)).select("fault", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3


def test_entry_fault_refuses_empty_keys(spark):
    """The operator itself: keys may not be empty, values may."""
    rows = [("", "v", "empty key"), (None, "v", "empty key"), ("", "", "empty key"), ("k", "", "ok"), ("k" * 4097, "", "key too large"), ("k", "v" * ((1 << 20) + 1), "value too large"), ("k" * 4096, "v" * (1 << 20), "ok")]
    df = spark.createDataFrame(rows, "k string, v string, want string")
    assert df.where(storage.entry_fault(F.col("k"), F.col("v")) != F.col("want")).count() == 0


@pytest.fixture
def crowd(spark, tmp_path):
    """Events of 1100 users in turn in group 0, whose sessions outnumber 1024, and of 50 in group
    1: the folder, decisions by the plain model under the usual limits, and those by SQL."""
    users = [3 * u for u in range(1100)] + [3 * u + 1 for u in range(50)]
    kinds = ["view", "purchase", "error"]
    rows = [(r * len(users) + k, u, kinds[(r + k) % 3]) for r in range(5) for k, u in enumerate(users)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    sql = {(g, i): (d, at) for g, i, d, at in con.execute(catalogue.ORACLES["session_decisions"]).fetchall()}
    models, want = {}, {}
    for r in commands(events).orderBy("grp", "index").collect():
        want[r.grp, r["index"]] = models.setdefault(r.grp, Model(1024, 128)).step(r["index"], r.op, r.client_id, r.request_id, r.acked_below, r.fp)
    return str(tmp_path), want, sql


def test_session_decisions_beyond_the_limits(spark, crowd):
    """Sessions are evicted where there are too many, which SQL does not tell; elsewhere it does."""
    folder, want, sql = crowd
    got = {(r.grp, r["index"]): (r.decision, r.reported) for r in catalogue.QUERIES["session_decisions"](spark, folder).collect()}
    assert got == want and got.keys() == sql.keys()
    assert {g for g, i in got if got[g, i] != sql[g, i]} == {0} and {got[k][0] for k in got if got[k] != sql[k]} == {"expired"}


def test_stream_sessions_beyond_the_limits(spark, crowd):
    """The stream evicts the same sessions."""
    folder, want, sql = crowd
    got = {(r.grp, r["index"]): (r.decision, r.reported) for r in catalogue.QUERIES["stream_sessions"](spark, folder).collect()}
    assert got == want and want != sql
