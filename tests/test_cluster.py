"""Health and readiness scenarios, log repair against a plain log, and order invariance."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import cluster as C
from tarnwell.operators import measure, sessions, storage

STATUS = "node string, grp int, role string, term long, leader string, commit long, applied long, last_index long, probe long, conf_index long, removed boolean, voters array<string>, outgoing array<string>, matches map<string,long>"
VOTERS = ["n1", "n2", "n3"]


def report(node, role="Follower", term=5, leader="n1", commit=100, applied=100, last=100, removed=False, voters=VOTERS, outgoing=(), matches=None):
    own = matches or {"n2": 100, "n3": 100}
    return (node, 1, role, term, leader, commit, applied, last, int(node[1:]), 1, removed, list(voters), list(outgoing), own if role == "Leader" else {})


def health(spark, reports, answered=None, lag=10):
    s = spark.createDataFrame(reports, STATUS)
    a = spark.createDataFrame([(n,) for n in (answered or [r[0] for r in reports])], "node string")
    v = C.voter_states(s, a, lag)
    h = C.group_health(v).first()
    return h.verdict, h.agreeing, {r.node: r.state for r in v.collect()}


SCENARIOS = {
    "healthy": ([report("n1", "Leader"), report("n2"), report("n3")], ("healthy", 3, {"n1": "leading", "n2": "following", "n3": "following"})),
    "leader lost": ([report("n2", leader=""), report("n3", leader="")], ("unavailable", 0, {"n1": "unreachable", "n2": "stale", "n3": "stale"})),
    "stale leader": ([report("n1", "Leader"), report("n2", "Leader", term=6, leader="n2", matches={"n1": 90, "n3": 100}), report("n3", term=6, leader="n2")], ("degraded", 2, {"n1": "stale", "n2": "leading", "n3": "following"})),
    "restarting": ([report("n1", "Leader"), report("n2")], ("degraded", 2, {"n1": "leading", "n2": "following", "n3": "unreachable"})),
    "majority down": ([report("n1", "Leader")], ("unavailable", 1, {"n1": "leading", "n2": "unreachable", "n3": "unreachable"})),
    "lagging": ([report("n1", "Leader", matches={"n2": 100, "n3": 50}), report("n2"), report("n3")], ("degraded", 3, {"n1": "leading", "n2": "following", "n3": "lagging"})),
    "unnamed voter": ([report("n1", "Leader", voters=[*VOTERS, "n9"]), report("n2"), report("n3")], ("degraded", 3, {"n1": "leading", "n2": "following", "n3": "following", "n9": "unreachable"})),
    "joint": ([report("n1", "Leader", voters=["n1", "n2"], outgoing=["n1", "n3"]), report("n2"), report("n3")], ("healthy", 3, {"n1": "leading", "n2": "following", "n3": "following"})),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_group_health(spark, name):
    reports, want = SCENARIOS[name]
    assert health(spark, reports) == want


def test_not_hosting(spark):
    assert health(spark, [report("n1", "Leader"), report("n2")], ["n1", "n2", "n3"])[2]["n3"] == "not-hosting"


def test_readiness(spark):
    rows = [report("n1", "Leader"), report("n2", leader=""), report("n3", applied=80), report("n4", voters=[]), report("n5", removed=True)]
    got = {r.node: (r.verdict, r.reasons) for r in C.readiness(spark.createDataFrame(rows, STATUS), 10).collect()}
    assert got == {
        "n1": ("ready", ""), "n2": ("not-ready", "group 1: no leader known"), "n3": ("not-ready", "group 1: apply lag"),
        "n4": ("not-ready", "group 1: not yet a member"), "n5": ("not-ready", "hosts no group"),
    }


def test_chosen_status(spark):
    rows = [report("n1"), report("n2", "Leader", term=4), report("n3", "Leader", term=6)]
    assert C.chosen_status(spark.createDataFrame(rows, STATUS)).first().node == "n3"
    assert C.chosen_status(spark.createDataFrame([report("n2"), report("n1")], STATUS)).first().node == "n1"


def test_survivors_equal_a_log_that_is_written(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 8)
    rng, rows, want = random.Random(3), [], set()
    for grp in range(10):
        log = []  # (index, pos)
        for pos in range(60):
            index = (log[-1][0] + 1) if log else 1
            if log and rng.random() < 0.2:
                index = rng.randint(max(1, index - 6), index)
            log = [e for e in log if e[0] < index] + [(index, pos)]
            rows.append((grp, pos, index, 1))
        want |= {(grp, p, i) for i, p in log}
    rng.shuffle(rows)
    got = C.survivors(spark.createDataFrame(rows, "grp int, pos long, index long, term long")).collect()
    assert {(r.grp, r.pos, r["index"]) for r in got} == want


def test_membership_steps(spark):
    def fault(before, after):
        shape = "struct<voters:array<string>,outgoing:array<string>,learners:array<string>>"
        df = spark.createDataFrame([(dict(zip(("voters", "outgoing", "learners"), map(list, before), strict=True)), dict(zip(("voters", "outgoing", "learners"), map(list, after), strict=True)))], f"a {shape}, b {shape}")
        return df.select(C.conf_step_fault(F.col("a"), F.col("b")).alias("f")).first().f

    assert fault(("abc", "", ""), ("abc", "", "d")) is None
    assert fault(("abc", "", "d"), ("abcd", "abc", "")) is None
    assert fault(("abcd", "abc", ""), ("abcd", "", "")) is None
    assert fault(("abc", "", ""), ("ab", "", "")) == "voters changed without a joint step"
    assert fault(("abc", "", ""), ("abc", "", "de")) == "more than one learner changed"
    assert fault(("abc", "", ""), ("abc", "", "a")) == "malformed"


def shuffled(df, n):
    return df.orderBy(F.rand(n)).repartition(n)


@pytest.mark.parametrize("n", [1, 7])
def test_results_do_not_depend_on_order(spark, sf_dir, n):
    from tarnwell.plans.history_queries import commands
    from tarnwell.sources import tables as T

    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    v, o = T.order_versions(spark, sf_dir), T.op_log(spark, sf_dir)
    assert rows(storage.snapshot(shuffled(v, n))) == rows(storage.snapshot(v))
    assert rows(storage.compaction_counters(shuffled(v, n), False)) == rows(storage.compaction_counters(v, False))
    assert rows(measure.latency_stats(shuffled(o, n), ["op"])) == rows(measure.latency_stats(o, ["op"]))
    c = commands(T.table(spark, sf_dir, "events"))
    assert rows(sessions.decisions(shuffled(c, n))) == rows(sessions.decisions(c))


def test_a_stream_that_comes_in_parts_equals_the_batch(spark, sf_dir, tmp_path):
    from tarnwell.sources import tables as T
    from tarnwell.streaming import jobs

    v = T.event_versions(spark, sf_dir)
    for i, part in enumerate(v.randomSplit([0.3, 0.3, 0.4], 5)):
        part.coalesce(1).write.parquet(f"{tmp_path}/v/part={i}")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/v/*")
    got = sorted(map(tuple, jobs.latest(stream).collect()))
    assert got == sorted(map(tuple, storage.snapshot(v).collect()))
