"""Scans, snapshots of state, and the remaining invariants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwell.operators import cluster as C
from tarnwell.operators import routing as R
from tarnwell.operators import sessions as X
from tarnwell.operators import storage as S
from tarnwell.plans.catalogue import register
from tarnwell.plans.cluster_queries import SAMPLES, STATUS, samples, status
from tarnwell.plans.history_queries import _CMD, _DECIDED, _H, commands
from tarnwell.plans.routing_queries import RING, SHARDS
from tarnwell.plans.storage_queries import ORDERS, catalog
from tarnwell.sources import tables as T


@register(f"select key, seq, kind, value from ({ORDERS}) where key >= 40 and (key > 40 or seq <= 1000) and key <= 60")
def range_scan(spark, sf_dir):
    """SRC-01 SRC-02: from a seek to (key 40, sequence 1000) up to key 60; the bounds reach the scan."""
    v = T.order_versions(spark, sf_dir).select("key", "seq", "kind", "value")
    return v.where((F.col("key") >= 40) & ((F.col("key") > 40) | (F.col("seq") <= 1000)) & (F.col("key") <= 60))


@register(f"select key, seq, kind, 'file' as source from ({ORDERS}) where file < 2 union all select key, seq, kind, 'memtable' from ({ORDERS}) where file >= 2")
def merged_scan(spark, sf_dir):
    """SET-01 SRT-02: files and memtable as one stream of versions, in order within ranges of keys."""
    v = T.order_versions(spark, sf_dir)
    part = lambda d, name: d.select("key", "seq", "kind", F.lit(name).alias("source"))
    both = part(v.where("file < 2"), "file").unionByName(part(v.where("file >= 2"), "memtable"))
    return both.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"), F.desc("kind"))


@register(f"select id, kind, invoke, row_number() over (partition by key order by invoke) as place, key from ({_H})")
def key_histories(spark, sf_dir):
    """FLT-02: each key's history by invocation."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("invoke")).cast("long")
    return T.history(spark, sf_dir).select("id", "kind", "invoke", place.alias("place"), "key")


_BEFORE = "c.cid <> 0 and c.op <> 'register' and d.decision <> 'expired'"
_PER = f"select c.grp, c.cid, max(c.index) as last, max(least(acked, rid)) as mark, list_sort(list(distinct rid) filter (d.decision = 'executed')) as done from ({_CMD}) c join ({_DECIDED}) d on c.grp = d.grp and c.index = d.index where {_BEFORE} group by c.grp, c.cid"


@register(f"select r.grp, r.index as client_id, coalesce(last, r.index) as last, greatest(coalesce(mark, 1), 1) as acked_below, coalesce(array_to_string(list_filter(done, lambda x: x >= greatest(coalesce(mark, 1), 1)), ','), '') as requests from (select grp, index from ({_CMD}) where op = 'register') r left join ({_PER}) p on p.grp = r.grp and p.cid = r.index")
def session_table(spark, sf_dir):
    """SRC-11 FSM-05: sessions as a snapshot holds them."""
    c = commands(T.table(spark, sf_dir, "events"))
    return X.session_table(c, X.decisions_by_client(c))


@register(f"select d.grp, d.index // 16 as cycle, max(d.index) as applied, count(*) filter (decision = 'executed' and op <> 'register') as mutations from ({_DECIDED}) d join ({_CMD}) c on c.grp = d.grp and c.index = d.index group by all")
def apply_cycles(spark, sf_dir):
    """FSM-04: entries of a cycle as one batch with its applied index."""
    c = commands(T.table(spark, sf_dir, "events"))
    d = X.decisions_by_client(c).join(c.select("grp", "index", "op"), ["grp", "index"])
    return d.groupBy("grp", F.floor(F.col("index") / 16).alias("cycle")).agg(F.max("index").alias("applied"), F.count_if((F.col("decision") == "executed") & (F.col("op") != "register")).alias("mutations"))


@register("select client, request, min(other) as acked_below from (select a.client, a.request, b.request as other from (select user_id as client, event_id as request, event_id as b, event_id + user_id % 60 as e from events) a join (select user_id as client, event_id as request, event_id as b, event_id + user_id % 60 as e from events) b on a.client = b.client and b.b <= a.b and b.e > a.b) group by client, request")
def client_watermarks(spark, sf_dir):
    """WIN-09: the lowest request in flight when each is sent."""
    i, u = F.col("event_id"), F.col("user_id")
    r = T.table(spark, sf_dir, "events").select(u.alias("client"), i.alias("request"), i.alias("begin"), (i + u % 60).alias("end"))
    return X.in_flight_watermark(r)


@register(f"select owner::int as owner, vnode::int as vnode, round(token::double / 18446744073709551616.0 * 360, 6) as angle from ({RING})")
def ring_angles(spark, sf_dir):
    """FUN-15: where each point stands on a drawn ring."""
    return R.shard_ring(spark, SHARDS).select("owner", "vnode", F.round(F.col("token").cast("double") / float(2**64) * 360, 6).alias("angle"))


@register("select user_id % 4 as client, 1 + event_id % 3 as attempts, count(*) as operations, count(*) filter (event_type = 'error') as unknown from events group by all")
def attempt_counts(spark, sf_dir):
    """GEN-04: operations by how many attempts they took, and those that ended unknown."""
    e = T.table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 4).alias("client"), (1 + F.col("event_id") % 3).alias("attempts")).agg(F.count("*").alias("operations"), F.count_if(F.col("event_type") == "error").alias("unknown"))


@register("select event_id as step, event_type as kind, 'n' || user_id % 5 as node, event_id * 3 as arg from events")
def script_events(spark, sf_dir):
    """SRC-20: a script of events, one a line, written and read by a pattern."""
    e = T.table(spark, sf_dir, "events")
    lines = e.select(F.format_string("%d %s node=n%d arg=%d", "event_id", "event_type", F.col("user_id") % 5, F.col("event_id") * 3).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(\d+) (\w+) node=(\w+) arg=(\d+)$", k)
    return lines.select(part(1).cast("long").alias("step"), part(2).alias("kind"), part(3).alias("node"), part(4).cast("long").alias("arg"))


@register(f"select 0::bigint as edit, array_to_string(list_sort(list(file)), ',') as files, max(largest_seq) as last_sequence from (select file, max(seq) as largest_seq from ({ORDERS}) group by file)")
def manifest_snapshot(spark, sf_dir):
    """SNK-04: the live files as the one edit that begins a new manifest."""
    c = catalog(spark, sf_dir)
    return c.agg(F.lit(0).cast("long").alias("edit"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"), F.max("largest_seq").alias("last_sequence"))


_LEADS = f'select grp, node, event_id as "at" from ({SAMPLES}) where role = \'Leader\''
_CONFS = "select user_id % 3 as grp, event_id as \"at\", case when event_id % 2 = 0 then ['n0', 'n1', 'n2'] else ['n2', 'n3', 'n4'] end as voters from events where event_id % 40 = 1 or event_id % 50 = 2"


@register(f'select l.grp, l.node, l."at" from ({_LEADS}) l asof left join ({_CONFS}) c on l.grp = c.grp and l."at" >= c."at" where c.voters is null or not list_contains(c.voters, l.node)')
def leaders_outside_configuration(spark, sf_dir):
    """INV-MB4 INV-MB5 LOG-07: leaders that the configuration in force does not list."""
    i = F.col("event_id")
    leads = samples(spark, sf_dir).where("role = 'Leader'").select("grp", "node", i.alias("at"))
    lists = [F.array(*map(F.lit, v)) for v in (["n0", "n1", "n2"], ["n2", "n3", "n4"])]
    confs = T.table(spark, sf_dir, "events").where((i % 40 == 1) | (i % 50 == 2)).select((F.col("user_id") % 3).alias("grp"), i.alias("at"), F.when(i % 2 == 0, lists[0]).otherwise(lists[1]).alias("voters"))
    return C.unconfirmed_leaders(leads, confs)


_DURABLE = "select 'n' || user_id % 5 as node, event_id // 100 as incarnation, max(1 + event_id // 70) as term, max(event_id) as last from events group by all"


@register(f"select node, incarnation, fault from (select p.node, p.incarnation, case when p.incarnation % 7 = 3 then 'lost' when p.incarnation % 5 = 1 then 'regressed' when p.incarnation % 4 = 2 then 'differs' end as fault from ({_DURABLE}) p) where fault is not null")
def recovery_faults(spark, sf_dir):
    """INV-F2 INV-CR: recovered state against what was durable, with planted faults."""
    i, n = F.col("event_id"), F.col("incarnation")
    p = T.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("n"), F.col("user_id") % 5).alias("node"), F.floor(i / 100).alias("incarnation")).agg(F.max(1 + F.floor(i / 70)).alias("term"), F.max(i).alias("last"))
    r = p.where(n % 7 != 3).select("node", "incarnation", (F.col("term") - F.when(n % 5 == 1, 1).otherwise(0)).alias("term"), (F.col("last") + F.when((n % 5 != 1) & (n % 4 == 2), 1).otherwise(0)).alias("last"))
    return C.unrecovered(r, p)


@register(f"select s.grp, s.node, case when coalesce(leaders, 0) <> 1 then 'no single leader' when s.commit <> l.c or s.last_index <> l.li then 'behind' end as fault from ({STATUS}) s left join (select grp, count(*) as leaders, max(commit) as c, max(last_index) as li from ({STATUS}) where role = 'Leader' group by grp) l using (grp) where coalesce(leaders, 0) <> 1 or s.commit <> l.c or s.last_index <> l.li")
def convergence(spark, sf_dir):
    """INV-F3."""
    return C.diverged(status(spark, sf_dir))


_MESSAGES = f'select grp, node, event_id as "at", term - case when event_id % 19 = 0 then 1 else 0 end as term, event_id // 40 as commit from ({SAMPLES})'


@register(f'select grp, node, "at", term, seen from (select *, max(term) over (partition by grp, node order by "at" rows between unbounded preceding and 1 preceding) as seen, lag(commit) over (partition by grp, node order by "at") as before from ({_MESSAGES})) where term < seen and commit <> before')
def stale_messages_that_acted(spark, sf_dir):
    """INV-R10: a message of an older term must change nothing; every 19th is planted as one."""
    i = F.col("event_id")
    m = samples(spark, sf_dir).select("grp", "node", i.alias("at"), (F.col("term") - F.when(i % 19 == 0, 1).otherwise(0)).alias("term"), F.floor(i / 40).alias("commit"))
    return C.stale_actions(m)


@register(f"select count(*) as versions, (select count(*) from (select key from ({ORDERS}) group by key)) as keys from ({ORDERS})")
def store_size(spark, sf_dir):
    """AGG-25: totals of a store."""
    v = T.order_versions(spark, sf_dir)
    return S.latest(v).agg(F.count("*").alias("keys")).join(v.agg(F.count("*").alias("versions")), F.lit(True)).select("versions", "keys")  # one row each
