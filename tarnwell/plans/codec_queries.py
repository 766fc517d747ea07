"""Codecs and rules on requests, over events and documents as payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tarnwell.functions import bloom
from tarnwell.functions import varint_length
from tarnwell.operators import measure
from tarnwell.operators import requests as Q
from tarnwell.plans.catalogue import register
from tarnwell.sources import framed, metrics_text
from tarnwell.sources import tables as T


def _varint(n: str) -> str:
    return f"greatest(ceil(length(bin({n})) / 7.0), 1)::int"


_REQ = """select event_id, case event_type when 'view' then 'get' when 'click' then 'get' when 'error' then 'delete' when 'signup' then 'register' else 'put' end as op, case when event_id % 31 = 0 then '' else user_id::varchar end as key,
 case when event_type = 'purchase' then props when event_id % 17 = 0 then 'x' else '' end as value, case when event_type = 'signup' then 0 else user_id % 5 end as client, case when user_id % 5 = 0 or event_type = 'signup' then 0 else event_id % 50 end as request, case when user_id % 5 = 0 or event_type = 'signup' then 0 else event_id % 40 end as acked from events"""


def requests(spark, sf_dir):
    e, i, u, t = T.table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id"), F.col("event_type")
    op = F.when(t.isin("view", "click"), "get").when(t == "error", "delete").when(t == "signup", "register").otherwise("put")
    anonymous = (u % 5 == 0) | (t == "signup")
    return e.select(
        "event_id", op.alias("op"), F.when(i % 31 == 0, "").otherwise(u.cast("string")).alias("key"), F.when(t == "purchase", F.col("props")).when(i % 17 == 0, "x").otherwise("").alias("value"),
        F.when(t == "signup", 0).otherwise(u % 5).alias("client"), F.when(anonymous, 0).otherwise(i % 50).alias("request"), F.when(anonymous, 0).otherwise(i % 40).alias("acked"),
    )


_STATUS = """case when op = 'register' then case when key = '' and value = '' and client = 0 and request = 0 and acked = 0 then 'ok' else 'register with fields' end when key = '' then 'empty key' when op <> 'put' and value <> '' then 'value without put'
 when client = 0 then case when request <> 0 or acked <> 0 then 'identity without client' else 'ok' end when request = 0 or acked = 0 or acked > request then 'bad identity' else 'ok' end"""


@register(f"select event_id, {_STATUS} as status from ({_REQ})")
def request_validation(spark, sf_dir):
    """FLT-11."""
    fields = [F.col(c) for c in ("op", "key", "value", "client", "request", "acked")]
    return requests(spark, sf_dir).select("event_id", Q.request_fault(*fields).alias("status"))


@register("select err, case err when 'not leader' then 'NOT_LEADER' when 'lost' then 'LOST' when 'entry too large' then 'INVALID' when 'busy' then 'UNAVAILABLE' else 'UNKNOWN_OUTCOME' end as status, count(*) as n from (select case event_id % 5 when 0 then 'not leader' when 1 then 'lost' when 2 then 'entry too large' when 3 then 'busy' else 'timeout' end as err from events) group by err")
def status_mapping(spark, sf_dir):
    """PRJ-04."""
    i = F.col("event_id") % 5
    err = F.when(i == 0, "not leader").when(i == 1, "lost").when(i == 2, "entry too large").when(i == 3, "busy").otherwise("timeout")
    return T.table(spark, sf_dir, "events").select(err.alias("err")).groupBy("err").agg(F.count("*").alias("n")).select("err", Q.status_of(F.col("err")).alias("status"), "n")


@register("select event_id, case when event_id % 6 = 0 then 'unknown' when event_type <> 'error' and user_id % 4 > 0 then 'ok' when user_id % 4 = 0 then 'not_found' else 'refused' end as class from events")
def outcome_classification(spark, sf_dir):
    """PRJ-03."""
    c = measure.outcome_class(F.col("event_id") % 6 != 0, F.when(F.col("event_type") == "error", "broken"), F.when(F.col("user_id") % 4 == 0, "NOT_FOUND").otherwise("OK"))
    return T.table(spark, sf_dir, "events").select("event_id", c.alias("class"))


@register(f"select event_id, op, (case when op = 'register' then 1 else 1 + {_varint('length(key)')} + length(key) + case when client <> 0 then {_varint('client')} + {_varint('request')} + {_varint('acked')} else 0 end + case when op = 'put' then {_varint('length(value)')} + length(value) else 0 end end)::int as encoded_len from ({_REQ}) where op <> 'get'")
def command_lengths(spark, sf_dir):
    """PRJ-02 FUN-13 SRC-19: lengths of encoded commands, from their bytes."""
    r = requests(spark, sf_dir).where("op <> 'get'")
    raw = framed.command(F.col("op"), F.col("key").cast("binary"), F.col("value").cast("binary"), F.col("client"), F.col("request"), F.col("acked"))
    return r.select("event_id", "op", F.octet_length(raw).alias("encoded_len"))


@register("select event_id, (octet_length(encode(props)) + 9)::int as length, octet_length(encode(props))::int as payload, event_type as kind from events")
def framed_records(spark, sf_dir):
    """SNK-03 SRC-07 FUN-04 SNK-02: a record of each event, written, read and checked."""
    kinds = ["signup", "purchase", "error", "view", "click"]
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(kinds)])
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), framed.framed(kind, F.col("props").cast("binary")).alias("content"))
    read = framed.read_records(e).where("kind >= 0")
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1)
    return read.select(F.col("path").cast("long").alias("event_id"), (F.octet_length("payload") + 9).alias("length"), F.octet_length("payload").alias("payload"), name.alias("kind"))


@register("select path, case when path % 3 <> 1 then 'ok' when path < (select max(event_id // 500) from events) then 'error' else 'truncate' end as verdict from (select distinct event_id // 500 as path from events)")
def log_replay(spark, sf_dir):
    """SRC-06 SRC-21: all events framed into segments of 500, every third cut short; only the
    newest may be."""
    e = T.table(spark, sf_dir, "events")
    record = framed.framed(F.lit(1), F.col("props").cast("binary"))
    files = framed.segments(e.select("event_id", record.alias("record")), "event_id", "record", 500)
    cut = F.when(F.col("segment") % 3 == 1, F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 5)).otherwise(F.col("content"))
    files = files.select(F.lpad(F.col("segment").cast("string"), 19, "0").alias("path"), cut.alias("content"))
    return framed.replayable(framed.read_records(files)).select(F.col("path").cast("long").alias("path"), "verdict")


@register("select c_custkey // 1000 as file, count(*) as keys, 0::bigint as missed, greatest(count(distinct c_name) * 10, 64) as bits, floor(10 * ln(2) + 0.5)::int as probes, true as few_false from customer group by 1")
def bloom_membership(spark, sf_dir):
    """FLT-05 FUN-05: filters of about a thousand names each never miss one of theirs; their sizes;
    and whether at most 3 % of as many other names pass (0.8 % are expected at ten bits a key)."""
    c = T.table(spark, sf_dir, "customer").select("c_name", F.floor(F.col("c_custkey") / 1000).alias("file"))

    def check(pdf):
        names = [n.encode() for n in pdf["c_name"]]
        b = bloom.Bloom(names)
        missed, false = int((~b.may_hold(names)).sum()), int(b.may_hold([b"not " + n for n in names]).sum())
        return pd.DataFrame([(pdf["file"].iloc[0], len(names), missed, b.m, b.k, false <= 0.03 * len(names) + 2)], columns=["file", "keys", "missed", "bits", "probes", "few_false"])

    return c.groupBy("file").applyInPandas(check, "file long, keys long, missed long, bits long, probes int, few_false boolean")


_SERIES = "select event_type as name, user_id % 12 as grp, user_id % 3 as op, sum(floor(value * 100))::bigint as v from events group by all"


@register(f"select name, grp::varchar as grp, v::double as value, row_number() over (partition by name order by grp, op) as place from ({_SERIES})")
def metrics_text_round_trip(spark, sf_dir):
    """SNK-06 SRC-16 FUN-11: series written in order as text and read back."""
    from pyspark.sql.window import Window

    e = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 12).alias("g"), (F.col("user_id") % 3).alias("o")).agg(F.sum(F.floor(F.col("value") * 100)).cast("double").alias("value"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    s = e.select("name", F.array(pair('gr"p', F.col("g")), pair("op", F.col("o"))).alias("labels"), "value")
    s = s.withColumn("labels", F.transform("labels", lambda x: F.struct(F.replace(x["key"], F.lit('"'), F.lit("")).alias("key"), x["value"].alias("value"))))
    lines = metrics_text.write_lines(s)
    place = F.row_number().over(Window.partitionBy("name").orderBy("rank")).cast("long")
    back = metrics_text.read_samples(lines.select(place.alias("place"), F.col("line").alias("value")), ["place"])
    return back.select("name", F.col("labels")["grp"].alias("grp"), "value", "place")


@register("select to_json({'run': event_type, 'n': count(*), 'most': max(event_id)})::varchar as line from events group by event_type")
def result_json(spark, sf_dir):
    """SNK-07: a result as a line of JSON."""
    r = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n"), F.max("event_id").alias("most"))
    return r.select(F.to_json(F.struct("run", "n", "most")).alias("line"))


@register(f"select event_id, {_varint('event_id')} as bytes from events")
def varint_lengths(spark, sf_dir):
    """FUN-13."""
    return T.table(spark, sf_dir, "events").select("event_id", varint_length(F.col("event_id")).alias("bytes"))
