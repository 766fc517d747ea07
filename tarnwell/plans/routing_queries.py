"""Placement of customers' names, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell import functions as fn
from tarnwell.operators import routing as R
from tarnwell.plans.catalogue import register
from tarnwell.sources import tables as T

SHARDS, NODES, MORE = 16, ["n0", "n1", "n2"], ["n0", "n1", "n2", "n3"]


def _token(raw: str) -> str:
    return f"concat('0x', substr(sha256({raw}), 1, 16))::ubigint"


def _labelled(name: str, *parts: str) -> str:
    """The token of a label, a zero byte, and hexadecimal parts."""
    return _token(f"unhex(concat('{name.encode().hex()}00', {', '.join(parts)}))")


RING = f"""select {_labelled(fn.SHARD, "lpad(hex(s), 8, '0')", "lpad(hex(v), 8, '0')")} as token, s as owner, v as vnode
 from range({SHARDS}) a(s), range(128) b(v)"""


def node_points(nodes: list[str]) -> str:
    token = _labelled(fn.NODE, "hex(encode(n))", "lpad(hex(v), 8, '0')")
    return f"select {token} as token, n as owner from (select unnest({nodes}) as n), range(128) b(v)"


def groups_sql(shards: int, nodes: list[str], rf: int) -> str:
    anchor = _labelled(fn.ANCHOR, "lpad(hex(s), 8, '0')")
    near = f"select s, owner, min(case when token >= anchor then token::hugeint - anchor::hugeint else token::hugeint - anchor::hugeint + 18446744073709551616 end) as gap from (select s, {anchor} as anchor from range({shards}) a(s)), ({node_points(nodes)}) group by s, owner"
    return f"select s::int as shard, list(owner order by gap)[1:{rf}] as replicas from ({near}) group by s"


_ROUTED = f"select k.c_name, k.token, coalesce(r.owner, (select owner from ({RING}) order by token limit 1))::int as shard from (select c_name, {_token('encode(c_name)')} as token from customer) k asof left join ({RING}) r on k.token <= r.token"


@register(f"select c_name, {_token('encode(c_name)')}::decimal(20,0) as token from customer")
def token_of(spark, sf_dir):
    """FUN-01."""
    return T.table(spark, sf_dir, "customer").select("c_name", fn.token_of(F.col("c_name").cast("binary")).alias("token"))


@register(f"select token::decimal(20,0) as token, owner::int as owner, vnode::int as vnode from ({RING})")
def ring_points(spark, sf_dir):
    """FUN-02 SRT-03."""
    return R.shard_ring(spark, SHARDS)


@register(_ROUTED.replace("k.token,", "k.token::decimal(20,0) as token,", 1))
def route_keys(spark, sf_dir):
    """JOI-01."""
    keys = T.table(spark, sf_dir, "customer").select("c_name")
    return R.route(keys, "c_name", SHARDS).select("c_name", "token", "shard")


@register(f"select shard, count(*) as keys from ({_ROUTED}) group by shard")
def keys_per_shard(spark, sf_dir):
    """AGG-30 by keys; INV-C1 of routing: every key has one shard."""
    return R.route(T.table(spark, sf_dir, "customer").select("c_name"), "c_name", SHARDS).groupBy("shard").agg(F.count("*").alias("keys"))


@register(groups_sql(SHARDS, MORE, 3))
def replica_groups(spark, sf_dir):
    """JOI-02."""
    return R.replica_groups(spark, SHARDS, MORE, 3)


@register(f"select count(*) filter (a.replicas[1] <> b.replicas[1]) as moved, count(*) filter (a.shard % 3 <> a.shard % 4) as moved_by_modulo, count(*) as shards from ({groups_sql(512, NODES, 1)}) a join ({groups_sql(512, MORE, 1)}) b using (shard)")
def redistribution(spark, sf_dir):
    """JOI-10 INV-C3 of routing: three nodes to four over 512 shards."""
    return R.redistribution(spark, 512, NODES, MORE)


@register(f"select owner, round(sum(case when low is null then token::double + 18446744073709551616.0 - last::double else token::double - low::double end) / 18446744073709551616.0, 9) as share from (select owner, token, lag(token) over (order by token) as low, max(token) over () as last from ({node_points(MORE)})) group by owner")
def ring_share(spark, sf_dir):
    """AGG-30."""
    return R.ownership(R.node_ring(spark, MORE))


@register("select shard, case when len(replicas) = 0 then 'empty' when len(list_distinct(replicas)) < len(replicas) then 'repeated' when len(replicas) <> 3 then 'size' end as fault from (select s::int as shard, case s % 4 when 0 then ['n0', 'n1', 'n2'] when 1 then ['n0', 'n1'] when 2 then ['n0', 'n0', 'n1'] else []::varchar[] end as replicas from range(12) t(s)) where fault is not null")
def replica_group_faults(spark, sf_dir):
    """SET-07."""
    lists = F.when(F.col("id") % 4 == 0, F.array(*map(F.lit, ["n0", "n1", "n2"]))).when(F.col("id") % 4 == 1, F.array(*map(F.lit, ["n0", "n1"]))).when(F.col("id") % 4 == 2, F.array(*map(F.lit, ["n0", "n0", "n1"]))).otherwise(F.array().cast("array<string>"))
    return R.group_faults(spark.range(12).select(F.col("id").cast("int").alias("shard"), lists.alias("replicas")), 3)


@register("select event_id, format('key:{:08d}', event_id) as name, hex(unhex(concat(lpad(hex(event_id), 16, '0'), repeat(lpad(hex(event_id % 256), 2, '0'), 8)))) as value, event_id as back, least(10 * pow(2, event_id % 12), 5000)::bigint as backoff, greatest(ceil(length(bin(event_id)) / 7.0), 1)::int as varint, case when event_id % 100 < 50 then 'get' when event_id % 100 < 60 then 'delete' else 'put' end as op, replace(replace(replace(props, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '\"', chr(92) || '\"') as label, case when user_id % 5 <> 0 then value / (user_id % 5) end as ratio from events")
def scalar_functions(spark, sf_dir):
    """FUN-06 FUN-07 FUN-08 FUN-09 FUN-11 FUN-12 FUN-13 PRJ-06."""
    e, i = T.table(spark, sf_dir, "events"), F.col("event_id")
    value = fn.value_pattern(i, 16)
    return e.select(
        "event_id", fn.key_name(i).alias("name"), F.hex(value).alias("value"), fn.value_index(value).alias("back"), fn.backoff(i % 12, 10, 5000).alias("backoff"), fn.varint_length(i).alias("varint"),
        fn.mix_pick((i % 100) / 100, 0.5, 0.1).alias("op"), fn.escape_label(F.col("props")).alias("label"), fn.ratio(F.col("value"), F.col("user_id") % 5).alias("ratio"),
    )


@register("select event_id, sha256(unhex(hex(encode(event_type)) || lpad(hex(octet_length(encode(user_id::varchar))), 8, '0') || hex(encode(user_id::varchar)) || lpad(hex(octet_length(encode(props))), 8, '0') || hex(encode(props)))) as fp from events")
def fingerprints(spark, sf_dir):
    """FUN-03."""
    return T.table(spark, sf_dir, "events").select("event_id", fn.fingerprint(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("fp"))
