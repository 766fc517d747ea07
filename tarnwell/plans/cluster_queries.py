"""Cluster status, logs and invariants over traces made of events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell.operators import cluster as C
from tarnwell.operators import requests as Q
from tarnwell.plans.catalogue import register
from tarnwell.sources import json_text as J
from tarnwell.sources import tables as T

SAMPLES = """select event_id // 5 as "at", 'n' || user_id % 5 as node, user_id % 3 as grp, case when event_id % 7 < 2 then 'Leader' else 'Follower' end as role,
 1 + event_id // 90 as term, case when event_id % 11 <> 0 then 'n' || (event_id // 90) % 5 else '' end as leader, event_id * 2 - case when event_id % 13 = 0 then 60 else 0 end as commit,
 event_id * 2 - user_id % 8 as applied, event_id * 2 + floor(value)::bigint % 5 as last_index, event_id from events"""
_TOP = f"select grp, \"at\", arg_max(node, term * 10 + node[2:]::int) as leader, max(term) as term from ({SAMPLES}) where role = 'Leader' group by grp, \"at\""


def samples(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    n = lambda c: F.concat(F.lit("n"), c)
    return e.select(
        F.floor(i / 5).alias("at"), n(u % 5).alias("node"), (u % 3).alias("grp"), F.when(i % 7 < 2, "Leader").otherwise("Follower").alias("role"), (1 + F.floor(i / 90)).alias("term"),
        F.when(i % 11 != 0, n(F.floor(i / 90) % 5)).otherwise("").alias("leader"), (i * 2 - F.when(i % 13 == 0, 60).otherwise(0)).alias("commit"), (i * 2 - u % 8).alias("applied"),
        (i * 2 + F.floor("value") % 5).alias("last_index"), "event_id",
    )


@register(_TOP)
def highest_leader(spark, sf_dir):
    """AGG-39."""
    return C.highest_leader(samples(spark, sf_dir), ["grp", "at"])


@register(f"select grp, \"at\", term, before, leader, case when before is null then 'first-leader' else 'change' end as event from (select *, lag(leader) over (partition by grp order by \"at\") as before from ({_TOP})) where before is null or before <> leader")
def leader_changes(spark, sf_dir):
    """WIN-06 AGG-31 STR-03."""
    return C.leader_changes(samples(spark, sf_dir))


VOTERS = [["n0", "n1", "n2"], ["n1", "n2", "n3"], ["n0", "n1", "n2", "n3", "n4", "n9"]]
_LAST = f"select *, row_number() over (partition by node, grp order by event_id desc) as rn from ({SAMPLES})"
STATUS = f"""select node, grp, case when grp = 1 then 'Follower' when node = 'n' || grp then 'Leader' else 'Follower' end as role, case when node = 'n3' then 3 else 7 end as term, case when node = 'n4' then '' else 'n' || grp end as leader,
 commit, applied, last_index, node[2:]::bigint as probe, commit % 10 as conf_index, node = 'n4' and grp = 0 as removed,
 case grp when 0 then {VOTERS[0]} when 1 then {VOTERS[1]} else {VOTERS[2]} end as voters from ({_LAST}) where rn = 1"""


def status(spark, sf_dir):
    """The last sample of each node and group as a status report, with configurations."""
    w = Window.partitionBy("node", "grp").orderBy(F.desc("event_id"))
    s = samples(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    lists = [F.array(*map(F.lit, v)) for v in VOTERS]
    own = F.concat(F.lit("n"), "grp")
    num = F.substring("node", 2, 9).cast("long")
    return s.select(
        "node", "grp", F.when(F.col("grp") == 1, "Follower").when(F.col("node") == own, "Leader").otherwise("Follower").alias("role"), F.when(F.col("node") == "n3", 3).otherwise(7).alias("term"),
        F.when(F.col("node") == "n4", "").otherwise(own).alias("leader"), "commit", "applied", "last_index", num.alias("probe"), (F.col("commit") % 10).alias("conf_index"), ((F.col("node") == "n4") & (F.col("grp") == 0)).alias("removed"),
        F.when(F.col("grp") == 0, lists[0]).when(F.col("grp") == 1, lists[1]).otherwise(lists[2]).alias("voters"), F.array().cast("array<string>").alias("outgoing"),
        F.map_from_arrays(F.array(*[F.lit(f"n{k}") for k in range(5)]), F.array(*[F.col("last_index") - 3 * k for k in range(5)])).alias("matches"),
    )


@register(f"select grp, arg_max(node, rank) as node, arg_max(role, rank) as role, arg_max(term, rank) as term, arg_max(conf_index, rank) as conf_index from (select *, (case when role = 'Leader' then 1000000 + term * 100 else conf_index * 100 end) - probe as rank from ({STATUS})) group by grp")
def chosen_configuration(spark, sf_dir):
    """AGG-29."""
    return C.chosen_status(status(spark, sf_dir))


@register(f"""select node, coalesce(string_agg(reason, '; ' order by reason), '') as reasons, case when count(reason) = 0 then 'ready' else 'not-ready' end as verdict from
 (select node, 'group ' || grp || ': ' || case when removed then null when leader = '' then 'no leader known' when commit - applied > 5 then 'apply lag' end as reason from ({STATUS})) group by node""")
def node_readiness(spark, sf_dir):
    """AGG-28 SRC-17."""
    return C.readiness(status(spark, sf_dir), 5)


_VOTERS = f"""select v.grp, v.node, l.node as leader, case when v.node = 'n9' then 'unreachable' when s.node is null then 'not-hosting' when l.node is null then 'stale' when v.node = l.node then 'leading' when s.leader = l.node and s.term = l.term then 'following' else 'stale' end as first,
 greatest(3 * v.node[2:]::bigint, 0) as behind from (select distinct grp, unnest(voters) as node from ({STATUS})) v left join (select * from ({STATUS}) where role = 'Leader') l using (grp) left join ({STATUS}) s on s.grp = v.grp and s.node = v.node"""
_STATES = f"select grp, node, leader, first, case when first = 'following' then behind else 0 end as lag, case when first = 'following' and behind > 4 then 'lagging' else first end as state from ({_VOTERS})"


def voters(spark, sf_dir):
    s = status(spark, sf_dir)
    return C.voter_states(s, s.select("node"), 4)


@register(f"select grp, node, state, lag, leader from ({_STATES})")
def voter_states(spark, sf_dir):
    """JOI-07 JOI-08 SET-02: follower lag and states."""
    return voters(spark, sf_dir).select("grp", "node", "state", "lag", "leader")


@register(f"select grp, max(leader) as leader, count(*) filter (first in ('leading', 'following')) as agreeing, count(*) // 2 + 1 as majority, case when max(leader) is null or count(*) filter (first in ('leading', 'following')) < count(*) // 2 + 1 then 'unavailable' when not bool_and(state in ('leading', 'following')) then 'degraded' else 'healthy' end as verdict from ({_STATES}) group by grp")
def group_health(spark, sf_dir):
    """AGG-27."""
    return C.group_health(voters(spark, sf_dir))


@register(f"select node, r.role, (count(*) filter (s.role = r.role))::bigint as samples, max(case when s.role = r.role then 1 else 0 end)::int as gauge from (select * from ({SAMPLES})) s, (select unnest(['Leader', 'Follower', 'Candidate']) as role) r group by node, r.role")
def role_gauge(spark, sf_dir):
    """AGG-35: one row per node and role."""
    s = samples(spark, sf_dir).select("node", F.col("role").alias("own"))
    each = s.withColumn("role", F.explode(F.array(*map(F.lit, ["Leader", "Follower", "Candidate"]))))
    is_ = (F.col("own") == F.col("role")).cast("int")
    return each.groupBy("node", "role").agg(F.sum(is_).alias("samples"), F.max(is_).alias("gauge"))


_MATCH = "select event_id, list_transform(range(1 + user_id % 5), lambda i: (event_id * (i + 3)) % 50 + 1) as m, case when event_id % 3 = 0 then list_transform(range(3), lambda i: (event_id * (i + 7)) % 50 + 1) else [] end as o from events"


@register(f"select event_id, case when c > event_id % 20 and 1 + c // 10 = 1 + event_id % 5 then c else event_id % 20 end as commit from (select event_id, case when len(o) > 0 then least(list_reverse_sort(m)[len(m) // 2 + 1], list_reverse_sort(o)[len(o) // 2 + 1]) else list_reverse_sort(m)[len(m) // 2 + 1] end as c from ({_MATCH}))")
def commit_index(spark, sf_dir):
    """AGG-26 with joint configurations and the own-term rule (INV-R9)."""
    i, u = F.col("event_id"), F.col("user_id")
    m = F.transform(F.sequence(F.lit(0), (u % 5).cast("int")), lambda k: (i * (k + 3)) % 50 + 1)
    o = F.when(i % 3 == 0, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (i * (k + 7)) % 50 + 1)).otherwise(F.array().cast("array<bigint>"))
    terms = F.array(*[F.lit(1 + k // 10) for k in range(1, 51)])
    return T.table(spark, sf_dir, "events").select("event_id", C.commit_index(m, o, terms, 1 + i % 5, i % 20).alias("commit"))


LOG = """select user_id % 3 as grp, 'n' || event_id % 4 as node, event_id // 12 as index, 1 + event_id // 200 + case when event_id % 53 = 0 then 1 else 0 end as term, event_type || case when event_id % 47 = 0 then 'x' else '' end as data, event_id as pos from events"""


def log(spark, sf_dir):
    i = F.col("event_id")
    return T.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("grp"), F.concat(F.lit("n"), i % 4).alias("node"), F.floor(i / 12).alias("index"), (1 + F.floor(i / 200) + F.when(i % 53 == 0, 1).otherwise(0)).alias("term"),
        F.concat("event_type", F.when(i % 47 == 0, "x").otherwise("")).alias("data"), i.alias("pos"),
    )


@register(f"select grp, node, index, case when index <> i + 1 then 'gap' when term < t then 'term' end as fault from (select *, lag(index) over w as i, lag(term) over w as t from ({LOG}) window w as (partition by grp, node order by pos)) where (index <> i + 1) or term < t")
def contiguity_violations(spark, sf_dir):
    """WIN-11 LOG-01 INV-P2."""
    return C.discontiguous(log(spark, sf_dir))


WRITES = "select user_id % 3 as grp, event_id as pos, event_id - (case when event_id % 17 = 0 then 12 else 0 end) as index, 1 + event_id // 17 as term from events"


def writes(spark, sf_dir):
    i = F.col("event_id")
    return T.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), i.alias("pos"), (i - F.when(i % 17 == 0, 12).otherwise(0)).alias("index"), (1 + F.floor(i / 17)).alias("term"))


_SURVIVE = f"select grp, pos, index, term from (select *, min(index) over (partition by grp order by pos rows between 1 following and unbounded following) as cut from ({WRITES})) where cut is null or cut > index"


@register(_SURVIVE)
def log_survivors(spark, sf_dir):
    """LOG-03 SRC-14."""
    return C.survivors(writes(spark, sf_dir))


@register(f"select grp, term, min(index) as first_index, max(index) as last_index from ({_SURVIVE}) group by grp, term")
def term_bounds(spark, sf_dir):
    """LOG-05."""
    return C.term_bounds(C.survivors(writes(spark, sf_dir)))


@register(f"select grp, index, last_value(conf ignore nulls) over (partition by grp order by index rows between unbounded preceding and current row) as in_force from (select grp, index, case when index % 23 = 0 then 'c' || index end as conf from ({_SURVIVE}))")
def conf_as_of(spark, sf_dir):
    """LOG-07 INV-MB2: the configuration in force at each index."""
    s = C.survivors(writes(spark, sf_dir)).withColumn("conf", F.when(F.col("index") % 23 == 0, F.concat(F.lit("c"), "index")))
    return C.in_force(s, "conf").select("grp", "index", "in_force")


_APPLIED = f"select s.* from ({_SURVIVE}) s join (select grp, max(index) * 9 // 10 as applied from ({_SURVIVE}) group by grp) m on m.grp = s.grp and s.index <= m.applied"


@register(f"select w.grp, w.index, w.term, case when s.term is null then 'pending' when s.term = w.term then 'applied' else 'lost' end as outcome from ({WRITES}) w left join ({_APPLIED}) s on s.index = w.index and s.grp = w.grp")
def proposal_outcomes(spark, sf_dir):
    """JOI-06 INV-X5 INV-X6: what became of every proposal at its index; each group has applied nine
    tenths of its log."""
    w = writes(spark, sf_dir)
    s = C.survivors(w)
    applied = s.groupBy("grp").agg(F.expr("max(index) * 9 div 10").alias("applied"))
    return C.proposal_outcome(w, s.join(applied, "grp").where("index <= applied"))


@register("select event_id, least(event_id - least(event_id, 1 + user_id), event_id - user_id % 30) as point, (event_id % 9 > user_id % 9) or (event_id % 9 = user_id % 9 and event_id >= 500) as up_to_date, event_id between user_id and user_id + 200 as unapplied from events")
def log_rules(spark, sf_dir):
    """LOG-02 LOG-06 LOG-09: compaction point, candidates' logs, what is committed and not applied."""
    i, u = F.col("event_id"), F.col("user_id")
    return T.table(spark, sf_dir, "events").select(
        "event_id", C.compaction_point(i, 1 + u, i - u % 30).alias("point"), C.up_to_date(i % 9, i, u % 9, F.lit(500)).alias("up_to_date"), i.between(u, u + 200).alias("unapplied")
    )


@register(f"select grp, index, term, case when index <= 400 then 'compacted' else 'kept' end as fate from ({_SURVIVE})")
def snapshot_boundary(spark, sf_dir):
    """LOG-04 LOG-08 INV-SN3: what a snapshot at 400 leaves of each log."""
    s = C.survivors(writes(spark, sf_dir))
    return s.select("grp", "index", "term", F.when(F.col("index") <= 400, "compacted").otherwise("kept").alias("fate"))


_V = "list_sort(['n' || (({0}) % 5), 'n' || (({0} + 1) % 5), 'n' || (({0} + 2) % 5)])"
_STEPS = f"""select user_id, event_id, case when event_id % 11 = 0 then {_V.format('b + 2')} when s = 0 then {_V.format('b')} else {_V.format('b + 1')} end as av, case when s = 1 then {_V.format('b')} else [] end as ao,
 case when event_id % 7 = 0 then ['n8', 'n9'] when event_id % 13 = 0 then ['n' || (b % 5)] when s = 3 then ['n8'] else [] end as al from (select *, n // 4 as b, n % 4 as s from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events))"""
_STEP_FAULT = """case when list_has_any(av, al) then 'malformed' when len(bo) = 0 and len(ao) > 0 then case when ao <> bv then 'outgoing is not the old voters' end when len(bo) > 0 and len(ao) = 0 then case when av <> bv or al <> bl then 'left with other changes' end
 when len(bo) > 0 then 'changed while joint' when av <> bv then 'voters changed without a joint step' when len(list_filter(al, lambda x: not list_contains(bl, x))) + len(list_filter(bl, lambda x: not list_contains(al, x))) > 1 then 'more than one learner changed' end"""


@register(f"select * from (select event_id, {_STEP_FAULT} as fault from (select *, lag(av) over w as bv, lag(ao) over w as bo, lag(al) over w as bl from ({_STEPS}) window w as (partition by user_id order by event_id)) where bv is not null) where fault is not null")
def conf_steps(spark, sf_dir):
    """SET-03 SET-06 LOG-10 INV-MB1: a user's events as configurations, through joint steps, some wrong."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("n"))
    i, b, s = F.col("event_id"), F.floor(F.col("n") / 4), F.col("n") % 4
    node = lambda x: F.concat(F.lit("n"), (x % 5).cast("string"))
    voters = lambda x: F.array_sort(F.array(node(x), node(x + 1), node(x + 2)))
    none = F.array().cast("array<string>")
    c = e.select(
        "user_id", "event_id",
        F.struct(
            F.when(i % 11 == 0, voters(b + 2)).when(s == 0, voters(b)).otherwise(voters(b + 1)).alias("voters"),
            F.when(s == 1, voters(b)).otherwise(none).alias("outgoing"),
            F.when(i % 7 == 0, F.array(F.lit("n8"), F.lit("n9"))).when(i % 13 == 0, F.array(node(b))).when(s == 3, F.array(F.lit("n8"))).otherwise(none).alias("learners"),
        ).alias("conf"),
    )
    c = c.withColumn("before", F.lag("conf").over(w)).where("before is not null")
    return c.withColumn("fault", C.conf_step_fault(F.col("before"), F.col("conf"))).where("fault is not null").select("event_id", "fault")


@register(f"select grp, term, count(distinct node) as leaders from ({SAMPLES}) where role = 'Leader' group by grp, term having count(distinct node) > 1")
def election_safety(spark, sf_dir):
    """INV-R1 INV-R6 (votes are counted alike)."""
    return C.two_leaders(samples(spark, sf_dir))


@register(f"select grp, a, b, max(index) filter (ta = tb) as agree, min(index) filter (ta <> tb or da <> db) as differ from (select x.grp, x.index, x.node a, y.node b, x.term ta, y.term tb, x.data da, y.data db from ({LOG}) x join ({LOG}) y on x.grp = y.grp and x.index = y.index and x.node < y.node) group by grp, a, b having min(index) filter (ta <> tb or da <> db) <= max(index) filter (ta = tb)")
def log_matching(spark, sf_dir):
    """INV-R3 INV-R2 JOI-13."""
    return C.mismatched_logs(log(spark, sf_dir))


@register(f"select grp, index, count(distinct (term, data)) as entries from ({LOG}) group by grp, index having count(distinct (term, data)) > 1")
def state_machine_safety(spark, sf_dir):
    """INV-R5 INV-P9."""
    return C.unsafe_applies(log(spark, sf_dir))


_COMMITTED = f"select distinct grp, index, term from ({LOG}) where node = 'n0'"
_LEADERS = f"select distinct grp, 4 + grp as leader_term, index, term from ({LOG}) where node = 'n1' or index % 3 = 0"


@register(f"select c.grp, l.leader_term, c.index, c.term from ({_COMMITTED}) c join (select distinct grp, leader_term from ({_LEADERS})) l on l.grp = c.grp and l.leader_term > c.term where not exists (select 1 from ({_LEADERS}) h where h.grp = c.grp and h.leader_term = l.leader_term and h.index = c.index and h.term = c.term)")
def leader_completeness(spark, sf_dir):
    """INV-R4."""
    g = log(spark, sf_dir)
    committed = g.where("node = 'n0'").select("grp", "index", "term").distinct()
    leaders = g.where("node = 'n1' or index % 3 = 0").select("grp", (F.col("grp") + 4).alias("leader_term"), "index", "term").distinct()
    return C.missing_from_leader(committed, leaders)


@register(f"select grp, node, event_id as \"at\", before, commit as after from (select *, lag(commit) over (partition by grp, node order by event_id) as before from ({SAMPLES})) where commit < before")
def commit_monotone(spark, sf_dir):
    """INV-R8 WIN-10."""
    return C.regressions(samples(spark, sf_dir).drop("at").withColumnRenamed("event_id", "at"), "commit")


@register(f"select grp, node, event_id, applied, commit from ({SAMPLES}) where applied > commit")
def apply_past_commit(spark, sf_dir):
    """INV-R7."""
    return samples(spark, sf_dir).where("applied > commit").select("grp", "node", "event_id", "applied", "commit")


@register("select user_id as client, event_id // 40 as request, count(distinct event_id) as times from events where event_type = 'purchase' group by all having count(distinct event_id) > 1")
def at_most_once(spark, sf_dir):
    """INV-X2 INV-X11: requests with more than one execution."""
    e = T.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return C.executed_twice(e.select(F.col("user_id").alias("client"), F.floor(F.col("event_id") / 40).alias("request"), F.col("event_id").alias("index")))


@register(f"select grp, node, index, data from ({LOG}) where data not in (select event_type from events)")
def fabricated_commands(spark, sf_dir):
    """INV-F4."""
    proposed = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("data"))
    return C.fabricated(log(spark, sf_dir), proposed).select("grp", "node", "index", "data")


@register(f"select grp, index, count(distinct node) as holders, count(distinct node) < 3 as below_majority from ({LOG}) group by grp, index")
def durable_count(spark, sf_dir):
    """AGG-32 INV-MB3: nodes that hold an entry, against a majority of 3 in 5."""
    return log(spark, sf_dir).groupBy("grp", "index").agg(F.count_distinct("node").alias("holders"), (F.count_distinct("node") < 3).alias("below_majority"))


_STAGES = "select user_id % 3 as grp, event_id // 6 as index, 1 + (event_id // 6) // 50 + case when event_id % 61 = 0 then 1 else 0 end as term, case event_id % 3 when 0 then 'accept' when 1 then 'commit' else 'apply' end as stage, epoch_us(ts) as \"at\" from events"


@register(f"select grp, index, min(\"at\") filter (stage = 'commit') - min(\"at\") filter (stage = 'accept') as to_commit, min(\"at\") filter (stage = 'apply') - min(\"at\") filter (stage = 'commit') as to_apply from ({_STAGES}) group by grp, index having count(distinct term) = 1")
def stage_latency(spark, sf_dir):
    """AGG-33."""
    i = F.col("event_id")
    e = T.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("grp"), F.floor(i / 6).alias("index"), (1 + F.floor(F.floor(i / 6) / 50) + F.when(i % 61 == 0, 1).otherwise(0)).alias("term"),
        F.when(i % 3 == 0, "accept").when(i % 3 == 1, "commit").otherwise("apply").alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    return C.stage_latency(e)


@register("select event_type as point, count(*) as runs, count(*) filter (value > 5 and user_id % 4 <> 0 and event_id % 9 <> 0) as survived from events group by event_type")
def crash_matrix(spark, sf_dir):
    """AGG-40: survived if it fired, nothing was violated and all converged."""
    runs = T.table(spark, sf_dir, "events").select("event_type", (F.col("value") > 5).alias("fired"), (F.col("user_id") % 4 != 0).alias("sound"), (F.col("event_id") % 9 != 0).alias("settled"))
    return Q.crash_outcomes(runs, "event_type")


@register(f"select grp, node, max(greatest(l.last_index - s.last_index, 0)) as lag, count(*) as samples from ({SAMPLES}) s join (select grp, \"at\", max(last_index) as last_index, max(node) as leader from ({SAMPLES}) s1 where role = 'Leader' and term * 10 + node[2:]::int = (select max(term * 10 + node[2:]::int) from ({SAMPLES}) s2 where role = 'Leader' and s2.grp = s1.grp and s2.\"at\" = s1.\"at\") group by grp, \"at\") l using (grp, \"at\") where s.node <> l.leader group by grp, node")
def follower_lag(spark, sf_dir):
    """WIN-07 AGG-35: the most that each follower lay behind its leader at any instant."""
    return C.follower_lag(samples(spark, sf_dir))


_FAULTS = "select ts::date as run, epoch_us(ts) * 1000 as at_ns, 'pause' as kind, user_id % 3 as grp, 'n' || user_id % 5 as node, case when event_id % 2 = 0 then 'n' || event_id % 5 end as peer, floor(value * 1000)::bigint as hold_ns from events where event_type = 'error'"


@register(f"select run, (row_number() over (partition by run order by at_ns) - 1)::int as place, at_ns, kind, grp, node, peer, hold_ns from ({_FAULTS})")
def schedule_json(spark, sf_dir):
    """SRC-18 GEN-03: each day's faults as a schedule of JSON, written and read again."""
    e, i, u = T.table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("event_id"), F.col("user_id")
    f = e.select(F.to_date("ts").alias("run"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at_ns"), F.lit("pause").alias("kind"), (u % 3).alias("grp"), F.concat(F.lit("n"), u % 5).alias("node"), F.when(i % 2 == 0, F.concat(F.lit("n"), i % 5)).alias("peer"), F.floor(F.col("value") * 1000).alias("hold_ns"))
    return J.read_schedules(J.write_schedules(f))


@register(f"select node, grp, role, term, leader, commit, applied, last_index, conf_index, removed, array_to_string(voters, ',') as voters, null::varchar as fault from ({STATUS}) union all select null, null, null, null, null, null, null, null, null, null, null, 'unreadable' from ({STATUS}) where node = 'n3'")
def status_json(spark, sf_dir):
    """SRC-17: status reports as lines of JSON, those of n3 a second time cut short, read again."""
    lines = J.write_status(status(spark, sf_dir))
    cut = lines.where(F.get_json_object("line", "$.node") == "n3").select(F.expr("substring(line, 1, 9)").alias("line"))
    got = J.read_status(lines.unionByName(cut))
    return got.select("node", "grp", "role", "term", "leader", "commit", "applied", "last_index", "conf_index", "removed", F.array_join("voters", ",").alias("voters"), "fault")


@register("select event_id, \"at\", prev_end from (select event_id, epoch_us(ts) as \"at\", lag(epoch_us(ts) + floor(value * 1000000)::bigint * 20) over (partition by date_trunc('day', ts) order by ts) as prev_end from events where event_type = 'error') where prev_end > \"at\"")
def overlapping_faults(spark, sf_dir):
    """GEN-03 SRC-18: faults of a schedule that begin before the one before has ended. A day is a
    run, and a schedule is one run's list of faults."""
    e = T.table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.to_date("ts").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.floor(F.col("value") * 1_000_000) * 20).alias("hold"))
    end = F.lag(F.col("at") + F.col("hold")).over(Window.partitionBy("run").orderBy("at"))
    return e.withColumn("prev_end", end).where("prev_end > at").select("event_id", "at", "prev_end")
