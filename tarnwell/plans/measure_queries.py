"""Measurement over an operation log and scrapes made of events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell.operators import measure as M
from tarnwell.operators import requests as Q
from tarnwell.plans.catalogue import register
from tarnwell.sources import tables as T

OPS = """select event_id, date_trunc('day', ts)::date as run, user_id as client,
 case event_type when 'view' then 'get' when 'click' then 'get' when 'purchase' then 'put' when 'signup' then 'delete' else 'put' end as op,
 case when event_type = 'error' then 'unknown' when event_type = 'click' and user_id % 3 = 0 then 'not_found' when event_type = 'signup' and user_id % 4 = 0 then 'refused' else 'ok' end as class,
 (epoch_us(ts) - epoch_us(date_trunc('day', ts)::timestamp)) * 1000 as intended_ns,
 (epoch_us(ts) - epoch_us(date_trunc('day', ts)::timestamp)) * 1000 + floor(value * 1000000)::bigint as done_ns,
 floor(value * 1000000)::bigint as ns from events"""
HOUR = 3_600_000_000_000
RANKS = ", ".join(f"quantile_disc(ns, {p}::double / 100::double) / 1e3 as {n}_us" for n, p in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99), ("p999", "99.9")))


@register(f"select op, count(*) as n, min(ns) / 1e3 as min_us, round(sum(ns)::double / count(*) / 1e3, 6) as mean_us, {RANKS}, max(ns) / 1e3 as max_us from ({OPS}) where class in ('ok', 'not_found') group by op")
def latency_stats_by_op(spark, sf_dir):
    """AGG-09 AGG-11: exact percentiles of successes."""
    return M.latency_stats(T.op_log(spark, sf_dir).where(F.col("class").isin(*M.SUCCESS)), ["op"])


@register(f"select run, op, quantile_disc(ns, 0.5) / 1e3 as p50_us, quantile_disc(ns, 0.95) / 1e3 as p95_us, quantile_disc(ns, 0.99) / 1e3 as p99_us from ({OPS}) group by run, op")
def bench_latency(spark, sf_dir):
    """AGG-10: per run and operation."""
    o = T.op_log(spark, sf_dir)
    return o.groupBy("run", "op").agg(*[(M.percentile(p, "ns") / 1e3).alias(f"p{p}_us") for p in (50, 95, 99)])


@register(f"select op, count(*) as total, count(*) filter (class='ok') as ok, count(*) filter (class='not_found') as not_found, count(*) filter (class='refused') as refused, count(*) filter (class='unknown') as unknown, count(*) filter (class not in ('ok','not_found')) as excluded from ({OPS}) group by op")
def outcome_classes(spark, sf_dir):
    """AGG-12 PRJ-03."""
    return M.outcome_counts(T.op_log(spark, sf_dir), ["ok", "not_found", "refused", "unknown"])


@register(f"select run, count(*) filter (class in ('ok','not_found') and done_ns >= {2 * HOUR} and done_ns < {20 * HOUR}) as in_window, count(*) filter (intended_ns >= {2 * HOUR} and done_ns >= {20 * HOUR}) as late, count(*) filter (intended_ns < {2 * HOUR}) as warm_up, round(count(*) filter (class in ('ok','not_found') and done_ns >= {2 * HOUR} and done_ns < {20 * HOUR}) / 64800.0::double, 6) as per_second from ({OPS}) group by run")
def throughput(spark, sf_dir):
    """AGG-13 FLT-09 STR-05."""
    return M.throughput(T.op_log(spark, sf_dir), 2 * HOUR, 20 * HOUR)


_COUNTS = f"select run, done_ns // {HOUR} as b, count(*) filter (class in ('ok','not_found')) as ok, count(*) filter (class not in ('ok','not_found')) as failed from ({OPS}) group by all"
_LINE = f"select s.run, s.b, coalesce(ok, 0) as ok, coalesce(failed, 0) as failed from (select distinct run, unnest(range(24))::int as b from ({OPS})) s left join ({_COUNTS}) c on c.run = s.run and c.b = s.b"


@register(_LINE)
def timeline(spark, sf_dir):
    """WIN-01: hours of each run, empty ones too."""
    return M.timeline(T.op_log(spark, sf_dir), HOUR, 24)


@register(f"select r.run, coalesce(max(ns), 0)::bigint as outage_ns from (select distinct run from ({OPS})) r left join (select run, island, count(*) * {HOUR} as ns from (select *, sum((ok > 0)::int) over (partition by run order by b) as island from ({_LINE}) where b >= 1 and b + 1 <= 23) where ok = 0 group by run, island) o on o.run = r.run group by r.run")
def longest_outage(spark, sf_dir):
    """WIN-02."""
    return M.longest_outage(M.timeline(T.op_log(spark, sf_dir), HOUR, 24), HOUR, HOUR, 23 * HOUR)


@register("select event_type as config, count(value) as n, round(median(value), 9) as median, min(value) as low, max(value) as high, round(case when median(value) <> 0 then (max(value) - min(value)) / median(value) else 0 end, 9) as spread, case when count(value) >= 10 then quantile_disc(value, 0.95) end as p95 from events group by event_type")
def runset_summary(spark, sf_dir):
    """AGG-14."""
    return M.run_summary(T.table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), "value"), ["config"])


_METRICS = f"select op as config, unnest(['ops', 'mean_ns', 'max_ns']) as metric, unnest([count(*)::double, (sum(ns) // count(*))::double, max(ns)::double]) as value from ({OPS}) group by op, run"


@register(f"select config, metric, count(value) as n, round(median(value), 9) as median, min(value) as low, max(value) as high, round(case when median(value) <> 0 then (max(value) - min(value)) / median(value) else 0 end, 9) as spread, case when count(value) >= 10 then quantile_disc(value, 0.95) end as p95 from ({_METRICS}) group by config, metric")
def configuration_report(spark, sf_dir):
    """AGG-16: metrics of each run unpivoted and summarised by configuration."""
    runs = T.op_log(spark, sf_dir).groupBy(F.col("op").alias("config"), "run").agg(
        F.count("*").cast("double").alias("ops"), F.floor(F.sum("ns") / F.count("*")).cast("double").alias("mean_ns"), F.max("ns").cast("double").alias("max_ns")
    )
    return M.run_summary(runs.unpivot(["config", "run"], ["ops", "mean_ns", "max_ns"], "metric", "value"), ["config", "metric"])


_SCRAPE = "select 'n' || user_id % 5 as node, case event_type when 'error' then 'commit_index' else event_type || '_total' end as name, sum(floor(value * 100))::double as value from events where {} group by all"


@register(f"select coalesce(a.node, b.node) as node, coalesce(a.name, b.name) as name, case when coalesce(a.node, b.node) = 'n2' and not coalesce(a.name, b.name) like '%_index' then coalesce(b.value, 0) else coalesce(b.value, 0) - coalesce(a.value, 0) end as delta from ({_SCRAPE.format("ts < timestamp '2024-01-16'")}) a full join ({_SCRAPE.format('true')}) b on a.node = b.node and a.name = b.name")
def usage_delta(spark, sf_dir):
    """AGG-17 JOI-09 AGG-34: scrapes before the 16th and after all; node n2 restarted between."""
    e = T.table(spark, sf_dir, "events").select("ts", F.concat(F.lit("n"), F.col("user_id") % 5).alias("node"), F.when(F.col("event_type") == "error", "commit_index").otherwise(F.concat("event_type", F.lit("_total"))).alias("name"), F.floor(F.col("value") * 100).alias("v"))
    scrape = lambda d: d.groupBy("node", "name").agg(F.sum("v").cast("double").alias("value"))
    return M.counter_deltas(scrape(e.where("ts < timestamp_ntz '2024-01-16'")), scrape(e), F.col("node") == "n2")


_ATTEMPTS = """select event_id, case when event_id % 41 = 0 then 'context canceled' end as err,
 list_transform(range(1 + event_id % 4), lambda i: {'status': case (event_id + i * 7) % 6 when 0 then 'UNKNOWN_OUTCOME' when 1 then 'NOT_LEADER' when 2 then 'UNAVAILABLE' when 3 then 'OK' when 4 then 'LOST' else null end,
 'err': case when (event_id + i * 7) % 6 = 5 then case when event_id % 2 = 0 then 'node unavailable' else 'broken pipe' end end}) as a from events"""


@register(f"""select cause, count(*) as n from (select *, case when err is not null then 'cancelled' when last < 0 then 'other' when last = len(a) - 1 then 'unanswered at give-up'
 when len(list_filter(a[last + 2:], lambda x: not coalesce(case when x.err is not null then contains(x.err, 'node unavailable') else x.status in ('UNAVAILABLE','NOT_LEADER','LOST','SESSION_LIMIT') end, false))) = 0 then 'refused until give-up' else 'other' end as cause
 from (select *, coalesce(list_max(list_transform(a, lambda x, i: case when coalesce(case when x.err is not null then not contains(x.err, 'node unavailable') else x.status = 'UNKNOWN_OUTCOME' end, false) then i - 1 else -1 end)), -1) as last from ({_ATTEMPTS}))) group by cause""")
def unknown_causes(spark, sf_dir):
    """PRJ-05 over attempts made of event ids."""
    e = T.table(spark, sf_dir, "events").select("event_id")
    k = lambda i: (F.col("event_id") + i * 7) % 6
    status = lambda i: F.when(k(i) == 0, "UNKNOWN_OUTCOME").when(k(i) == 1, "NOT_LEADER").when(k(i) == 2, "UNAVAILABLE").when(k(i) == 3, "OK").when(k(i) == 4, "LOST")
    err = lambda i: F.when(k(i) == 5, F.when(F.col("event_id") % 2 == 0, "node unavailable").otherwise("broken pipe"))
    a = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: F.struct(status(i).alias("status"), err(i).alias("err")))
    top = F.when(F.col("event_id") % 41 == 0, "context canceled")
    return e.withColumn("a", a).groupBy(M.unknown_cause(top, F.col("a")).alias("cause")).agg(F.count("*").alias("n"))


@register(f"select run, count(*) filter (n <= 20) as kept, count(*) filter (n > 20) as dropped from (select run, row_number() over (partition by run order by event_id) n from ({OPS})) group by run")
def trace_cap(spark, sf_dir):
    """SRT-08."""
    return M.capped(T.op_log(spark, sf_dir), "run", "event_id", 20)


@register(f"select op, count(*) as n, quantile_disc(done_ns - k * 60000000000, 0.5) as p50_from_due, max(done_ns - k * 60000000000) as most_from_due from (select *, row_number() over (partition by run order by event_id) - 1 as k from ({OPS})) group by op")
def open_loop_latency(spark, sf_dir):
    """STR-07: latency from the due time of a schedule of one a minute."""
    k = F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1
    due = M.due_times(T.op_log(spark, sf_dir).withColumn("k", k.cast("long")), 60_000_000_000)
    return due.groupBy("op").agg(F.count("*").alias("n"), M.percentile(50, "from_due_ns").cast("long").alias("p50_from_due"), F.max("from_due_ns").alias("most_from_due"))


_UPPERS = [1.0, 5.0, 10.0, 50.0, 100.0]
_LES = "unnest([1.0, 5.0, 10.0, 50.0, 100.0, 'infinity'::double]::double[])"


@register(f"select t.event_type, le, count(*) filter (value <= le and (low is null or value > low)) as n, count(*) filter (value <= le) as cumulative from (select event_type, le, lag(le) over (partition by event_type order by le) as low from (select distinct event_type, {_LES} as le from events)) t join events e on e.event_type = t.event_type group by t.event_type, le")
def histogram_buckets(spark, sf_dir):
    """AGG-19 AGG-20 SNK-06."""
    return M.histogram(T.table(spark, sf_dir, "events"), "event_type", "value", _UPPERS)


@register("select i::int as i, pow(2.0, i) * 0.5 as bound from range(12) t(i)")
def exponential_buckets(spark, sf_dir):
    """WIN-12."""
    b = spark.range(1).select(F.posexplode(M.exponential_buckets(0.5, 2.0, 12)).alias("i", "bound"))
    return b.select("i", "bound")


@register("select count(*) as series, round(coalesce(sum(value), 0), 6) as total, case when count(*) = 1 then round(max(value), 6) end as single from (select event_type as name, user_id % 3 as grp, user_id % 7 as peer, sum(floor(value * 100)) as value from events group by all) where name = 'purchase' and grp = 1")
def metric_select_sum(spark, sf_dir):
    """FLT-04 AGG-18 AGG-21: one name, a subset of labels."""
    labels = F.create_map(F.lit("group"), (F.col("user_id") % 3).cast("string"), F.lit("peer"), (F.col("user_id") % 7).cast("string"))
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("g"), (F.col("user_id") % 7).alias("p"), labels.alias("labels"), F.floor(F.col("value") * 100).cast("double").alias("v"))
    s = e.groupBy("name", "g", "p").agg(F.max_by("labels", "v").alias("labels"), F.sum("v").alias("value"))
    return M.series_sum(s, "purchase", group="1")


@register("select family, label, row_number() over (partition by family order by try_cast(label as double) nulls last, label) as place from (select distinct user_id % 3 as family, case when user_id % 5 = 0 then 'n' || user_id else user_id::varchar end as label from events)")
def numeric_aware_order(spark, sf_dir):
    """WIN-13 SRT-07: labels that are numbers by value, others by text, within each family."""
    label = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("n"), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("family"), label.alias("label")).distinct()
    return e.select("family", "label", F.row_number().over(Window.partitionBy("family").orderBy(F.asc_nulls_last(F.expr("try_cast(label as double)")), "label")).cast("long").alias("place"))


@register("select case when user_id % 4 = 3 then 'other' else (user_id % 4)::varchar end as grp, event_type as op, case when value > 50 then 'OK' else 'NOT_FOUND' end as status, count(*) as requests, sum(floor(value * 100))::bigint as hundredths from events group by all")
def request_counters(spark, sf_dir):
    """AGG-37: by group, operation and status; groups not hosted are one."""
    e = T.table(spark, sf_dir, "events")
    grp = F.when(F.col("user_id") % 4 == 3, None).otherwise((F.col("user_id") % 4).cast("string"))
    return e.groupBy(F.coalesce(grp, F.lit("other")).alias("grp"), F.col("event_type").alias("op"), F.when(F.col("value") > 50, "OK").otherwise("NOT_FOUND").alias("status")).agg(F.count("*").alias("requests"), F.sum(F.floor(F.col("value") * 100)).alias("hundredths"))


@register("select case when length(props) % 5 = 0 then 'malformed' when user_id % 4 = 3 then 'unknown_group' else 'inbox_full' end as reason, count(*) as n from events where event_type = 'error' group by 1")
def drop_reasons(spark, sf_dir):
    """AGG-36."""
    e = T.table(spark, sf_dir, "events").where("event_type = 'error'")
    return Q.drops(e, F.length("props") % 5 == 0, F.col("user_id") % 4 != 3)


@register("select 'n' || user_id % 5 as node, greatest(max(event_id) filter (event_type = 'view') - max(event_id) filter (event_type = 'click'), 0) as gap, max(event_id) filter (event_type = 'purchase') - min(event_id) filter (event_type = 'purchase') as purchases_span from events group by 1")
def counter_gauges(spark, sf_dir):
    """AGG-21 AGG-35 WIN-07: gauges and lags of nodes."""
    at = lambda f, t: f(F.when(F.col("event_type") == t, F.col("event_id")))
    return T.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("n"), F.col("user_id") % 5).alias("node")).agg(
        F.greatest(at(F.max, "view") - at(F.max, "click"), F.lit(0)).alias("gap"), (at(F.max, "purchase") - at(F.min, "purchase")).alias("purchases_span")
    )


@register(f"select op, sum(block_reads)::bigint as block_reads, sum(filter_skips)::bigint as filter_skips from (select op, case when class = 'not_found' then 0 else 1 + client % 3 end as block_reads, case when class = 'not_found' then 1 else client % 2 end as filter_skips from ({OPS})) group by op")
def read_amplification(spark, sf_dir):
    """AGG-24: block reads and filter skips per configuration."""
    o = T.op_log(spark, sf_dir)
    miss = F.col("class") == "not_found"
    return o.groupBy("op").agg(F.sum(F.when(miss, 0).otherwise(1 + F.col("client") % 3)).alias("block_reads"), F.sum(F.when(miss, 1).otherwise(F.col("client") % 2)).alias("filter_skips"))


@register(f"select count(distinct client) as clients, count(*) as attempts, count(*) filter (class = 'ok') as acknowledged, count(*) filter (class = 'unknown') as unknown, count(*) filter (class = 'refused') as refused, sum(ns)::bigint as waited_ns from ({OPS})")
def workload_stats(spark, sf_dir):
    """AGG-38 AGG-25: counters summed over clients."""
    per = T.op_log(spark, sf_dir).groupBy("client").agg(F.count("*").alias("a"), F.count_if(F.col("class") == "ok").alias("k"), F.count_if(F.col("class") == "unknown").alias("u"), F.count_if(F.col("class") == "refused").alias("r"), F.sum("ns").alias("w"))
    return per.agg(F.count("*").alias("clients"), F.sum("a").alias("attempts"), F.sum("k").alias("acknowledged"), F.sum("u").alias("unknown"), F.sum("r").alias("refused"), F.sum("w").alias("waited_ns"))
