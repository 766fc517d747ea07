"""Histories, sessions and streams over operations made of events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell import functions as fn
from tarnwell.operators import history as H
from tarnwell.operators import requests as Q
from tarnwell.operators import sessions as X
from tarnwell.operators import storage as S
from tarnwell.plans.catalogue import register
from tarnwell.plans.measure_queries import OPS
from tarnwell.plans.storage_queries import VERSIONS, latest_sql
from tarnwell.sources import history_text
from tarnwell.sources import tables as T
from tarnwell.streaming import jobs

HISTORY = """select *, case when kind = 'get' and outcome = 'ok' then case when event_id % 211 = 0 then 'wrong' else prior end end as output from (
 select *, case when kind <> 'get' then case when event_id % 37 = 0 then 'rejected' when event_id % 29 = 0 then 'incomplete' else 'ok' end when prior is null then 'notfound' else 'ok' end as outcome from (
 select *, last_value(case when event_id % 37 <> 0 then case kind when 'put' then value when 'delete' then '' end end ignore nulls) over (partition by key order by event_id rows between unbounded preceding and 1 preceding) as raw, nullif(raw, '') as prior from (
 select event_id, 'h' as history, event_id as id, 'c' || user_id % 4 as client, case event_type when 'purchase' then 'put' when 'signup' then 'put' when 'error' then 'delete' else 'get' end as kind,
 'k' || user_id as key, case when event_type in ('purchase', 'signup') then 'v' || event_id end as value, event_id * 16 + 2 as invoke, event_id * 16 + 18 * (user_id % 3) + 7 as ended from events)))"""
_H = f"select history, id, client, kind, key, value, invoke, case when outcome = 'incomplete' then 0 else ended end as complete, outcome, output from ({HISTORY})"
_EFFECTIVE = f"select * from ({_H}) where outcome <> 'rejected' and not (outcome = 'incomplete' and kind = 'get')"


@register(f"select history, count(*) as total, count(*) filter (outcome='ok') as ok, count(*) filter (outcome='notfound') as notfound, count(*) filter (outcome='rejected') as rejected, count(*) filter (outcome='incomplete') as incomplete, count(*) filter (kind='put') as puts, count(*) filter (kind='get') as gets, count(*) filter (kind='delete') as deletes, count(distinct key) as keys, count(distinct client) as clients from ({_H}) group by history")
def history_summary(spark, sf_dir):
    """AGG-06 AGG-07."""
    return H.summary(T.history(spark, sf_dir))


_BROKEN = f"select *, case when id % 101 = 0 then id * 16 + 18 else invoke end as inv, case when id % 59 = 0 then 1 else complete end as com, case when id % 83 = 0 then '' else client end as cli from ({_H})"


@register(f"""select distinct history, id, fault from (
 select history, id, unnest([case when cli = '' then 'missing client, key or kind' end, case when outcome = 'incomplete' and com <> 0 then 'incomplete with completion' end, case when outcome <> 'incomplete' and com <= inv then 'completed before its invocation' end]) as fault from ({_BROKEN})
 union all select history, id, 'shared position' from (select *, count(*) over (partition by history, p) as n from (select history, id, unnest([inv, case when outcome <> 'incomplete' then com end]) as p from ({_BROKEN})) where p is not null) where n > 1) where fault is not null""")
def history_violations(spark, sf_dir):
    """FLT-12 over a history with planted faults."""
    h, i = T.history(spark, sf_dir), F.col("id")
    h = h.withColumn("invoke", F.when(i % 101 == 0, i * 16 + 18).otherwise(F.col("invoke"))).withColumn("complete", F.when(i % 59 == 0, 1).otherwise(F.col("complete"))).withColumn("client", F.when(i % 83 == 0, "").otherwise(F.col("client")))
    return H.faults(h)


@register(f"select history, key, id, output, b as expected from (select *, last_value(w ignore nulls) over (partition by history, key order by invoke rows between unbounded preceding and 1 preceding) as raw, nullif(raw, '') as b from (select *, case kind when 'put' then value when 'delete' then '' end as w from ({_EFFECTIVE}))) where kind = 'get' and (case when outcome = 'notfound' then b is not null else b is null or output is distinct from b end)")
def sequential_check(spark, sf_dir):
    """LIN-03 FUN-14 FLT-03."""
    return H.sequential_faults(T.history(spark, sf_dir))


@register(f"select r.history, r.key, r.id, case when first_write is null then 'never written' else 'read before written' end as screen from ({_H}) r left join (select history, key, value, min(invoke) as first_write from ({_EFFECTIVE}) where kind = 'put' group by all) w on w.history = r.history and w.key = r.key and w.value = r.output where r.kind = 'get' and r.outcome = 'ok' and (first_write is null or r.complete < first_write)")
def lin_screens(spark, sf_dir):
    """LIN-07 JOI-11 JOI-12."""
    return H.screens(T.history(spark, sf_dir))


@register()
def linearizability(spark, sf_dir):
    """LIN-01 LIN-02 LIN-06: a search per key; tests hold it against brute force and a corpus."""
    return H.linearizability(T.history(spark, sf_dir)).drop("counterexample")


@register()
def minimized_counterexample(spark, sf_dir):
    """LIN-05: the fewest operations that still fail, of each key that does."""
    v = H.linearizability(T.history(spark, sf_dir), minimize=True)
    return v.where("verdict = 'violation'").select("history", "key", "culprit", F.size("counterexample").alias("ops"), F.array_join("counterexample", ",").alias("ids"))


_SENDS = f"select history, id, client, kind, key, value, invoke, complete, outcome, output, case when kind = 'get' then 0 else 1 + id // 30 end as cid, case when kind = 'get' then 0 else 1 + id % 7 end as rid from ({_H})"
_GROUPED = f"""select *, list_distinct(list(case when outcome = 'ok' then cmd end) over w) as oks, list_distinct(list(case when outcome = 'incomplete' then cmd end) over w) as opens, count(*) over w as n, arg_min(cmd, id) over w as first_cmd
 from (select *, {{'kind': kind, 'key': key, 'value': value}} as cmd from ({_SENDS}) where cid <> 0) window w as (partition by history, cid, rid)"""


@register(f"""select history, id, kind, key, value, invoke, complete, outcome, client_id, request_id, fault from (
 select history, min(id) as id, arg_min(kind, id) as kind, arg_min(key, id) as key, arg_min_null(value, id) as value, min(invoke) as invoke,
 case when bool_or(outcome = 'ok') then min(complete) filter (outcome = 'ok') when bool_or(outcome = 'incomplete') then 0 else min(complete) end as complete,
 case when bool_or(outcome = 'ok') then 'ok' when bool_or(outcome = 'incomplete') then 'incomplete' else 'rejected' end as outcome, cid as client_id, rid as request_id, max(fault) as fault
 from (select *, case when n = 1 then null when len(oks) > 1 then 'two commands acknowledged' when len(oks) = 0 and len(opens) > 1 then 'unanswered sends differ' end as fault, case when len(oks) > 0 then oks[1] when len(opens) > 0 then opens[1] else first_cmd end as owner from ({_GROUPED}))
 where fault is not null or cmd = owner group by history, cid, rid)
 union all select history, id, kind, key, value, invoke, complete, outcome, 0, 0, null from ({_SENDS}) where cid = 0""")
def logical_ops(spark, sf_dir):
    """AGG-08: writes that share an identity merged; conflicting ones told."""
    h, w = T.history(spark, sf_dir), F.col("kind") != "get"
    h = h.withColumn("client_id", F.when(w, 1 + F.floor(F.col("id") / 30)).otherwise(0)).withColumn("request_id", F.when(w, 1 + F.col("id") % 7).otherwise(0))
    return H.logical(h).select("history", "id", "kind", "key", "value", "invoke", "complete", "outcome", "client_id", "request_id", "fault")


@register(f"select id, concat_ws(' ', id, client, kind, '\"' || key || '\"', invoke, complete, outcome) || case when kind = 'put' then ' value=\"' || value || '\"' else '' end || case when kind = 'get' and outcome = 'ok' then ' output=\"' || output || '\"' else '' end as line from ({_H})")
def history_text_lines(spark, sf_dir):
    """SNK-05 SRC-15: lines written and read again give the same lines."""
    h = T.history(spark, sf_dir)
    lines = h.select("history", history_text.line_of().alias("value"))
    again = history_text.read_history(lines, ["history"])
    return again.select("id", history_text.line_of().alias("line"))


@register(f"select key, sha256(string_agg(id || ':' || kind || ':' || outcome, chr(10) order by id)) as hash from ({_H}) group by key")
def trace_hash(spark, sf_dir):
    """SNK-08: SHA-256 over the ordered lines of each key's trace."""
    line = F.concat_ws(":", "id", "kind", "outcome")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return T.history(spark, sf_dir).groupBy("key").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


@register("select 'h' as history, event_id as id, event_id * 3 as invoke, case when event_id % 10 = 0 then 0 else event_id * 3 + 100 end as complete from events")
def recorded_intervals(spark, sf_dir):
    """LIN-08: begin and end events to intervals."""
    i = F.col("event_id")
    e = T.table(spark, sf_dir, "events").select(F.lit("h").alias("history"), i.alias("id"))
    begin = e.select("history", "id", F.lit("begin").alias("what"), (F.col("id") * 3).alias("at"))
    end = e.where("id % 10 <> 0").select("history", "id", F.lit("end").alias("what"), (F.col("id") * 3 + 100).alias("at"))
    return H.intervals(begin.unionByName(end))


_CMD = """select grp, index, case when n = 1 then 'register' when event_type in ('purchase', 'signup') then 'put' when event_type = 'error' then 'delete' else 'put' end as op, case when n = 1 then 0 when user_id % 10 = 9 then 0 when user_id % 10 = 8 then 1 else client end as cid,
 case when n = 1 or user_id % 10 = 9 then 0 else 1 + n // 2 + case when event_id % 13 = 0 then -2 else 0 end end as rid, case when n = 1 or user_id % 10 = 9 then 0 else greatest(1 + n // 2 - 2, 0) end as acked, sha256(event_type || n // 2) as fp, user_id, event_id
 from (select *, user_id % 3 as grp, event_id + 1 as index, row_number() over (partition by user_id order by event_id) as n, min(event_id + 1) over (partition by user_id) as client from events)"""


def commands(e):
    """A user's first event registers a session; the others are its requests, each sent about twice."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    n, first, u, i = F.row_number().over(w), F.min(F.col("event_id") + 1).over(Window.partitionBy("user_id")), F.col("user_id"), F.col("event_id")
    c = e.select("event_id", "user_id", "event_type", n.alias("n"), first.alias("client"))
    n = F.col("n")
    half = F.floor(n / 2)
    op = F.when(n == 1, "register").when(F.col("event_type") == "error", "delete").otherwise("put")
    anonymous = (n == 1) | (u % 10 == 9)
    return c.select(
        (u % 3).alias("grp"), (i + 1).alias("index"), op.alias("op"), F.when(anonymous, 0).when(u % 10 == 8, 1).otherwise(F.col("client")).cast("long").alias("client_id"),
        F.when(anonymous, 0).otherwise(1 + half + F.when(i % 13 == 0, -2).otherwise(0)).cast("long").alias("request_id"), F.when(anonymous, 0).otherwise(F.greatest(half - 1, F.lit(0))).cast("long").alias("acked_below"),
        F.sha2(F.concat("event_type", half.cast("string")), 256).alias("fp"), F.concat(F.lit("k"), u).alias("key"), F.concat(F.lit("v"), i).alias("value"),
    )


_KNOWN = f"select c.*, r.index is not null and c.cid < c.index as known, rid < greatest(max(least(acked, rid)) over (partition by c.grp, cid order by c.index rows between unbounded preceding and current row), 1) as stale from ({_CMD}) c left join (select grp, index from ({_CMD}) where op = 'register') r on r.grp = c.grp and r.index = c.cid where op <> 'register'"
_DECIDED = f"""select grp, index, decision, case decision when 'executed' then index when 'duplicate' then first_index else 0 end as reported from (select *, case when cid = 0 then 'executed' when not known then 'expired' when stale then 'stale' when first_index = index then 'executed' when first_fp = fp then 'duplicate' else 'conflict' end as decision
 from (select *, first_value(index) over w as first_index, first_value(fp) over w as first_fp from ({_KNOWN}) window w as (partition by grp, cid, rid, stale order by index))) union all select grp, index, 'registered', index from ({_CMD}) where op = 'register'"""


@register(_DECIDED)
def session_decisions(spark, sf_dir):
    """FSM-01 JOI-05: every command's decision under the usual limits. SQL over clients knows none
    and tells the same as long as no session that is used again has been evicted or is full."""
    return X.decide(commands(T.table(spark, sf_dir, "events")))


@register()
def session_limits(spark, sf_dir):
    """FSM-01 SRT-04: the same under limits of 4 sessions and 2 results, where the least recently
    used session is evicted and requests are refused (a test holds it against a plain model)."""
    return X.decide(commands(T.table(spark, sf_dir, "events")), max_sessions=4, max_unacked=2)


@register(_DECIDED)
def session_decisions_by_client(spark, sf_dir):
    """WIN-08: the window form for groups that are not coupled."""
    return X.decisions_by_client(commands(T.table(spark, sf_dir, "events")))


@register(f"select decision, count(*) as n from ({_DECIDED}) group by decision")
def apply_stats(spark, sf_dir):
    """AGG-22."""
    return X.decisions_by_client(commands(T.table(spark, sf_dir, "events"))).groupBy("decision").agg(F.count("*").alias("n"))


@register(f"select grp, key, value, index from (select d.grp, 'k' || user_id as key, 'v' || event_id as value, d.index, op, row_number() over (partition by d.grp, user_id order by d.index desc) as rn from ({_DECIDED}) d join ({_CMD}) c on c.grp = d.grp and c.index = d.index where decision = 'executed' and op in ('put', 'delete')) where rn = 1 and op = 'put'")
def applied_state(spark, sf_dir):
    """FSM-03 INV-SN1: the store after the executed writes."""
    c = commands(T.table(spark, sf_dir, "events"))
    return X.applied_state(c, X.decisions_by_client(c))


@register(f"select key, seq, value from ({latest_sql(VERSIONS)}) where kind = 1")
def stream_lww(spark, sf_dir):
    """STR-06: the snapshot from a stream of versions."""
    e = jobs.events(spark, sf_dir)
    return jobs.latest(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("kind"), "value"))


@register(f"select time_bucket(interval '1 hour', make_timestamp((epoch_us(run::timestamp) + done_ns // 1000)::bigint)) as start, count(*) filter (class in ('ok', 'not_found')) as ok, count(*) filter (class not in ('ok', 'not_found')) as failed from ({OPS}) group by 1")
def stream_timeline(spark, sf_dir):
    """STR-04: buckets of completion from a stream."""
    o = T.op_log_of(jobs.events(spark, sf_dir))
    done = F.timestamp_micros(F.unix_micros(F.col("run").cast("timestamp")) + F.floor(F.col("done_ns") / 1000))
    got = jobs.timeline(o.select(done.alias("done"), "class"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "ok", "failed")


@register(_DECIDED)
def stream_sessions(spark, sf_dir):
    """STR-01 STR-02: session decisions, under the usual limits too, from a stream of commands in a
    table."""
    at = jobs.shared_folder(spark)
    c = commands(T.table(spark, sf_dir, "events"))
    c.write.parquet(f"{at}/commands")
    stream = spark.readStream.schema(c.schema).parquet(f"{at}/commands")
    return jobs.session_decisions(stream)


_U = "('0x' || md5('{}:' || i)[1:13])::bigint / 4503599627370496.0::double"


@register(f"select i as id, case when i < 500 then 'warm-up' when i < 4500 then 'measured' else 'cool-down' end as phase, case when u < 0.5::double then 'get' when u < 0.6::double then 'delete' else 'put' end as op, 'key:' || lpad(least(floor(pow(w * (pow(998.0::double, 0.2::double) - 1) + 1, 5.0::double)) - 1, 996)::bigint::varchar, 8, '0') as key from (select i, {_U.format(7)} as u, {_U.format(8)} as w from range(5000) t(i))")
def operation_stream(spark, sf_dir):
    """GEN-01 GEN-02: a seeded mix of operations on keys of falling popularity, in three phases."""
    i = F.col("id")
    key = fn.key_name(Q.skewed_rank(Q.uniform(8, i), 997, 0.8))
    return spark.range(5000).select("id", Q.phase_of(i, 500, 4000).alias("phase"), fn.mix_pick(Q.uniform(7, i), 0.5, 0.1).alias("op"), key.alias("key"))


@register("select nodes, groups, reads from (select unnest([1, 3, 5])::int as nodes), (select unnest([1, 4, 16])::int as groups), (select unnest([5, 50, 95])::int as reads)")
def scenario_matrix(spark, sf_dir):
    """GEN-05: every combination of named parameters."""
    each = lambda name, *v: F.explode(F.array(*map(F.lit, v))).alias(name)
    return spark.range(1).select(each("nodes", 1, 3, 5)).select("nodes", each("groups", 1, 4, 16)).select("nodes", "groups", each("reads", 5, 50, 95))


@register(f"select count(*) as entries, count(distinct key) as keys from ({VERSIONS}) where key in (select key from ({latest_sql(VERSIONS)}) where kind = 1)")
def live_versions(spark, sf_dir):
    """JOI-11 by a semi-join: versions of keys that are live."""
    v = T.event_versions(spark, sf_dir)
    return v.join(S.snapshot(v).select("key"), "key", "left_semi").agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))
