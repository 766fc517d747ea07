"""Replicated logs and cluster status: majorities, health, leader changes, log repair, and the
rules that hold in every trace as queries for what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def majority_index(match: Column) -> Column:
    """AGG-26: the largest index that a majority of an array holds; null for none."""
    return F.element_at(F.array_sort(match, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), (F.floor(F.size(match) / 2) + 1).cast("int"))


def commit_index(match: Column, outgoing: Column, term_at: Column, term: Column, commit: Column) -> Column:
    """That index in both halves of a joint configuration, if its entry is of the current term
    and it lies past what is committed; else the commit index as it was."""
    both = F.when(F.size(outgoing) > 0, F.least(majority_index(match), majority_index(outgoing))).otherwise(majority_index(match))
    own = F.element_at(term_at, both.cast("int")) == term
    return F.when((both > commit) & own, both).otherwise(commit)


def highest_leader(samples: DataFrame, by: list[str]) -> DataFrame:
    """AGG-39: the leader of the highest term; of equal terms the later node."""
    top = F.max_by(F.struct("node", "term"), F.struct("term", "node")).alias("top")
    return samples.where("role = 'Leader'").groupBy(*by).agg(top).select(*by, F.col("top.node").alias("leader"), F.col("top.term").alias("term"))


def follower_lag(samples: DataFrame) -> DataFrame:
    """WIN-07, AGG-35: over samples(grp, at, node, role, term, last_index), the most that each other
    node lay behind the leader of the highest term at the same instant, and how often it was seen."""
    top = F.max_by(F.struct("node", "last_index"), F.struct("term", "node")).alias("l")
    lead = samples.where("role = 'Leader'").groupBy("grp", "at").agg(top)
    seen = samples.join(lead, ["grp", "at"]).where("node <> l.node")
    lag = F.greatest(F.col("l.last_index") - F.col("last_index"), F.lit(0))
    return seen.groupBy("grp", "node").agg(F.max(lag).alias("lag"), F.count("*").alias("samples"))


def leader_changes(samples: DataFrame) -> DataFrame:
    """WIN-06: per group, instants whose highest-term leader differs from the one before."""
    at = highest_leader(samples, ["grp", "at"])
    before = F.lag("leader").over(Window.partitionBy("grp").orderBy("at"))
    moved = at.withColumn("before", before).where("before is null or before <> leader")
    return moved.select("grp", "at", "term", "before", "leader", F.when(F.col("before").isNull(), "first-leader").otherwise("change").alias("event"))


def chosen_status(status: DataFrame) -> DataFrame:
    """AGG-29: of a group's reports the leader's of the highest term, else that of the highest
    configuration; ties keep the first probe."""
    leads = F.col("role") == "Leader"
    order = F.struct(leads.cast("int"), F.when(leads, F.col("term")).otherwise(F.col("conf_index")), -F.col("probe"))
    return status.groupBy("grp").agg(F.max_by(F.struct("node", "role", "term", "conf_index"), order).alias("c")).select("grp", "c.*")


def readiness(status: DataFrame, most_lag: int) -> DataFrame:
    """AGG-28: per node, what keeps it from being ready; ready without reasons."""
    lag = F.greatest(F.col("commit") - F.col("applied"), F.lit(0))
    reason = (
        F.when(F.col("removed"), None)
        .when(F.size("voters") == 0, "not yet a member")
        .when(F.coalesce("leader", F.lit("")) == "", "no leader known")
        .when(lag > most_lag, "apply lag")
    )
    told = F.when(reason.isNotNull(), F.concat(F.lit("group "), F.col("grp"), F.lit(": "), reason))
    per = status.groupBy("node").agg(F.count_if(~F.col("removed")).alias("member"), F.array_sort(F.collect_list(told)).alias("reasons"))
    reasons = F.when(F.col("member") == 0, F.array_append("reasons", F.lit("hosts no group"))).otherwise(F.col("reasons"))
    return per.select("node", F.array_join(reasons, "; ").alias("reasons")).withColumn("verdict", F.when(F.col("reasons") == "", "ready").otherwise("not-ready"))


def voter_states(status: DataFrame, answered: DataFrame, most_lag: int) -> DataFrame:
    """JOI-07, JOI-08, SET-02: every voter of every group with its state and lag. Voters are the
    leader's, or where none leads all that anyone reports; a node that did not answer is
    unreachable, whoever was asked."""
    lead = status.where("role = 'Leader' and not removed").groupBy("grp").agg(
        F.max_by(F.struct("node", "term", "voters", "outgoing", "last_index", "matches"), F.struct("term", -F.col("probe"))).alias("l")
    )
    reported = status.join(lead, "grp", "left").where("l is null or node = l.node")
    voters = reported.select("grp", F.explode(F.array_union("voters", "outgoing")).alias("node")).distinct()
    own = status.select("grp", "node", F.col("term").alias("own_term"), F.col("leader").alias("own_leader"))
    asked = answered.select("node").distinct().withColumn("answered", F.lit(True))
    v = voters.join(lead, "grp", "left").join(own, ["grp", "node"], "left").join(asked, "node", "left")
    agrees = (F.col("own_leader") == F.col("l.node")) & (F.col("own_term") == F.col("l.term"))
    first = (
        F.when(F.col("answered").isNull(), "unreachable")
        .when(F.col("own_term").isNull(), "not-hosting")
        .when(F.col("l").isNull(), "stale")
        .when(F.col("node") == F.col("l.node"), "leading")
        .when(agrees, "following")
        .otherwise("stale")
    )
    lag = F.when(first == "following", F.greatest(F.col("l.last_index") - F.element_at("l.matches", F.col("node")), F.lit(0)))
    v = v.select("grp", "node", first.alias("first"), F.coalesce(lag, F.lit(0)).cast("long").alias("lag"), F.col("l.node").alias("leader"))
    return v.withColumn("state", F.when(F.col("lag") > most_lag, "lagging").otherwise(F.col("first")))


def group_health(voters: DataFrame) -> DataFrame:
    """AGG-27: per group, how many voters confirm the leader, and the verdict."""
    agreeing = F.count_if(F.col("first").isin("leading", "following"))
    majority = (F.floor(F.count("*") / 2) + 1).cast("long")
    well = F.bool_and(F.col("state").isin("leading", "following"))
    verdict = F.when(F.max("leader").isNull() | (agreeing < majority), "unavailable").when(~well, "degraded").otherwise("healthy")
    return voters.groupBy("grp").agg(F.max("leader").alias("leader"), agreeing.alias("agreeing"), majority.alias("majority"), verdict.alias("verdict"))


def discontiguous(log: DataFrame) -> DataFrame:
    """WIN-11, LOG-01, INV-P2: entries whose index is not the next, or whose term falls."""
    w = Window.partitionBy("grp", "node").orderBy("pos")
    i, t = F.lag("index").over(w), F.lag("term").over(w)
    fault = F.when(F.col("index") != i + 1, "gap").when(F.col("term") < t, "term")
    return log.withColumn("fault", fault).where("fault is not null").select("grp", "node", "index", "fault")


#: Positions of a log that one task looks through at a time.
STRETCH = 65_536


def survivors(writes: DataFrame) -> DataFrame:
    """LOG-03, SRC-14: writes(grp, pos, index, term, ...) that no later write at or below their
    index has cut off. The least index that follows is found per stretch of positions, then
    within each, so one long log is many tasks."""
    w = writes.withColumn("stretch", F.expr(f"pos div {STRETCH}"))
    after = Window.partitionBy("grp").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    least = w.groupBy("grp", "stretch").agg(F.min("index").alias("least")).select("grp", "stretch", F.min("least").over(after).alias("after"))
    within = Window.partitionBy("grp", "stretch").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    cut = w.withColumn("cut", F.min("index").over(within)).join(least, ["grp", "stretch"])
    return cut.where("(cut is null or cut > index) and (after is null or after > index)").drop("cut", "after", "stretch")


def term_bounds(log: DataFrame) -> DataFrame:
    """LOG-05: first and last index of each term."""
    return log.groupBy("grp", "term").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"))


def in_force(log: DataFrame, conf: str) -> DataFrame:
    """LOG-07: at each index the last configuration at or before it (null: the base one)."""
    w = Window.partitionBy("grp").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("in_force", F.last(conf, ignorenulls=True).over(w))


def proposal_outcome(proposed: DataFrame, applied: DataFrame) -> DataFrame:
    """JOI-06: proposals(grp, index, term) against what was applied there."""
    a = applied.select("grp", "index", F.col("term").alias("applied_term"))
    outcome = F.when(F.col("applied_term").isNull(), "pending").when(F.col("applied_term") == F.col("term"), "applied").otherwise("lost")
    return proposed.join(a, ["grp", "index"], "left").select("grp", "index", "term", outcome.alias("outcome"))


def compaction_point(snapshot: Column, retain: Column, durable: Column) -> Column:
    """LOG-09: how far a log may be cut: what is retained stays, and what is not yet durable."""
    return F.least(snapshot - F.least(snapshot, retain), durable)


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    """LOG-06: whether a candidate's log is at least as new as one's own."""
    return (last_term > own_term) | ((last_term == own_term) & (last_index >= own_index))


def conf_step_fault(before: Column, after: Column) -> Column:
    """SET-03, LOG-10, INV-MB1 over structs (voters, outgoing, learners): what is wrong with
    a step. A joint configuration keeps the old voters as outgoing and is left by dropping
    them; else one learner may be added, or dropped, at a time. Sets are sorted and apart."""

    def fine(c):
        sets = [c["voters"], c["outgoing"], c["learners"]]
        distinct = [F.size(F.array_distinct(s)) == F.size(s) for s in sets]
        return distinct[0] & distinct[1] & distinct[2] & ~F.arrays_overlap(c["voters"], c["learners"])

    same = (before["voters"] == after["voters"]) & (before["learners"] == after["learners"])
    changed = F.size(F.array_except(before["learners"], after["learners"])) + F.size(F.array_except(after["learners"], before["learners"]))
    enter = (F.size(before["outgoing"]) == 0) & (F.size(after["outgoing"]) > 0)
    leave = (F.size(before["outgoing"]) > 0) & (F.size(after["outgoing"]) == 0)
    return (
        F.when(~fine(after), "malformed")
        .when(enter, F.when(after["outgoing"] != before["voters"], "outgoing is not the old voters"))
        .when(leave, F.when(~same, "left with other changes"))
        .when(F.size(before["outgoing"]) > 0, "changed while joint")
        .when(before["voters"] != after["voters"], "voters changed without a joint step")
        .when(changed > 1, "more than one learner changed")
    )


def two_leaders(events: DataFrame) -> DataFrame:
    """INV-R1: terms of a group with more than one leader."""
    return events.where("role = 'Leader'").groupBy("grp", "term").agg(F.count_distinct("node").alias("leaders")).where("leaders > 1")


def mismatched_logs(log: DataFrame) -> DataFrame:
    """INV-R3, JOI-13: for each pair of nodes the highest index where terms agree, and the first
    below it where entries differ. An equi-join on the index, not on nodes."""
    a = log.select("grp", "index", F.col("node").alias("a"), F.col("term").alias("ta"), F.col("data").alias("da"))
    b = log.select("grp", "index", F.col("node").alias("b"), F.col("term").alias("tb"), F.col("data").alias("db"))
    met = a.join(b, ["grp", "index"]).where("a < b")
    agree = F.max(F.when(F.col("ta") == F.col("tb"), F.col("index"))).alias("agree")
    differ = F.min(F.when((F.col("ta") != F.col("tb")) | (F.col("da") != F.col("db")), F.col("index"))).alias("differ")
    return met.groupBy("grp", "a", "b").agg(agree, differ).where("differ <= agree")


def unsafe_applies(applied: DataFrame) -> DataFrame:
    """INV-R5: indexes at which nodes applied different entries."""
    return applied.groupBy("grp", "index").agg(F.count_distinct(F.struct("term", "data")).alias("entries")).where("entries > 1")


def missing_from_leader(committed: DataFrame, leader_log: DataFrame) -> DataFrame:
    """INV-R4: committed(grp, index, term) entries that a later term's leader's log lacks.
    leader_log(grp, leader_term, index, term)."""
    need = committed.join(leader_log.select("grp", "leader_term").distinct(), "grp").where("leader_term > term")
    have = leader_log.select("grp", "leader_term", "index", "term")
    return need.join(have, ["grp", "leader_term", "index", "term"], "left_anti").select("grp", "leader_term", "index", "term")


def regressions(rows: DataFrame, value: str) -> DataFrame:
    """INV-R8, WIN-10: places where a value falls along a node's trace."""
    before = F.lag(value).over(Window.partitionBy("grp", "node").orderBy("at"))
    return rows.withColumn("before", before).where(F.col(value) < F.col("before")).select("grp", "node", "at", "before", F.col(value).alias("after"))


def stale_actions(messages: DataFrame) -> DataFrame:
    """INV-R10: messages(grp, node, at, term, commit) of a term older than the node has seen that
    changed its commit index."""
    w = Window.partitionBy("grp", "node").orderBy("at")
    seen = F.max("term").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = messages.withColumn("seen", seen).withColumn("before", F.lag("commit").over(w))
    return m.where("term < seen and commit <> before").select("grp", "node", "at", "term", "seen")


def executed_twice(executions: DataFrame) -> DataFrame:
    """INV-X2: requests that took effect at more than one index."""
    return executions.groupBy("client", "request").agg(F.count_distinct("index").alias("times")).where("times > 1")


def fabricated(applied: DataFrame, proposed: DataFrame) -> DataFrame:
    """INV-F4: applied commands that nobody proposed."""
    return applied.join(proposed.select("data").distinct(), "data", "left_anti")


def stage_latency(events: DataFrame) -> DataFrame:
    """AGG-33 of events(grp, index, term, stage, at): accept to commit and commit to apply per
    entry; an index that more than one term accepted is dropped."""
    at = {s: F.min(F.when(F.col("stage") == s, F.col("at"))) for s in ("accept", "commit", "apply")}
    e = events.groupBy("grp", "index").agg(F.count_distinct("term").alias("terms"), *[v.alias(k) for k, v in at.items()])
    return e.where("terms = 1").select("grp", "index", (F.col("commit") - F.col("accept")).alias("to_commit"), (F.col("apply") - F.col("commit")).alias("to_apply"))


def unconfirmed_leaders(leads: DataFrame, voters: DataFrame) -> DataFrame:
    """INV-MB4, INV-MB5: leads(grp, node, at) of nodes that the configuration in force, the last
    of voters(grp, at, voters) at or before it, does not list."""
    both = leads.select("grp", "at", "node", F.lit(None).cast("array<string>").alias("v"), F.lit(1).alias("o")).unionByName(
        voters.select("grp", "at", F.lit(None).cast("string").alias("node"), F.col("voters").alias("v"), F.lit(0).alias("o"))
    )
    w = Window.partitionBy("grp").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("now", F.last("v", ignorenulls=True).over(w)).where("o = 1")
    return known.where(F.col("now").isNull() | ~F.array_contains("now", F.col("node"))).select("grp", "node", "at")


def unrecovered(recovered: DataFrame, persisted: DataFrame) -> DataFrame:
    """INV-F2, INV-CR: (node, incarnation, term, last) recovered that differ from what was
    durable, or that are missing."""
    keys = ["node", "incarnation"]
    j = persisted.join(recovered.select(*keys, F.col("term").alias("t"), F.col("last").alias("l")), keys, "left")
    fault = F.when(F.col("t").isNull(), "lost").when((F.col("t") < F.col("term")) | (F.col("l") < F.col("last")), "regressed").when((F.col("t") != F.col("term")) | (F.col("l") != F.col("last")), "differs")
    return j.withColumn("fault", fault).where("fault is not null").select(*keys, "fault")


def diverged(status: DataFrame) -> DataFrame:
    """INV-F3: nodes of a group whose commit and last index are not their leader's, and groups
    that do not have one leader."""
    lead = status.where("role = 'Leader'").groupBy("grp").agg(F.count("*").alias("leaders"), F.max("commit").alias("c"), F.max("last_index").alias("l"))
    j = status.join(lead, "grp", "left")
    fault = F.when(F.coalesce("leaders", F.lit(0)) != 1, "no single leader").when((F.col("commit") != F.col("c")) | (F.col("last_index") != F.col("l")), "behind")
    return j.withColumn("fault", fault).where("fault is not null").select("grp", "node", "fault")
