"""Ordered session semantics: which commands of a replicated log take effect."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_SESSIONS, MAX_UNACKED = 1024, 128
DECISIONS = "grp long, index long, decision string, reported long"


class Sessions:
    """The session table of a group. Commands must come in log order."""

    def __init__(self, max_sessions: int = MAX_SESSIONS, max_unacked: int = MAX_UNACKED):
        self.max_sessions, self.max_unacked = max_sessions, max_unacked
        # sessions in order of last use, which is also that of eviction: id -> (watermark, {request: (print, index)})
        self.table: dict[int, tuple[int, dict[int, tuple[str, int]]]] = {}

    def decide(self, index: int, op: str, client: int, request: int, acked: int, fp: str) -> tuple[str, int]:
        """The decision, and the index it reports (0 for none)."""
        if op == "register":
            self.table[index] = (1, {})
            while len(self.table) > self.max_sessions:
                del self.table[next(iter(self.table))]
            return "registered", index
        if client == 0:
            return "executed", index
        if client not in self.table:
            return "expired", 0
        mark, results = self.table.pop(client)
        raised = min(acked, request)
        if raised > mark:
            mark = raised
            results = {r: v for r, v in results.items() if r >= mark}
        self.table[client] = (mark, results)
        if request < mark:
            return "stale", 0
        if request in results:
            known, at = results[request]
            return ("duplicate", at) if known == fp else ("conflict", 0)
        if len(results) >= self.max_unacked:
            return "limit", 0
        results[request] = (fp, index)
        return "executed", index


def decisions(commands: DataFrame, max_sessions: int = MAX_SESSIONS, max_unacked: int = MAX_UNACKED) -> DataFrame:
    """FSM-01 of commands(grp, index, op, client_id, request_id, acked_below, fp). Eviction
    couples the sessions of a group, so a group is folded in order: a task holds a batch of its
    log and its session table, which the limits bound."""

    kinds = pa.schema([("grp", pa.int64()), ("index", pa.int64()), ("decision", pa.string()), ("reported", pa.int64())])

    def fold(batches):
        s, now = None, None
        for b in batches:
            grp = b.column("grp").to_pylist()
            got = []
            for g, *command in zip(grp, *(b.column(c).to_pylist() for c in ("index", "op", "client_id", "request_id", "acked_below", "fp")), strict=True):
                if g != now or s is None:
                    s, now = Sessions(max_sessions, max_unacked), g
                got.append(s.decide(*command))
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), b.column("index").cast(pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64())], schema=kinds)

    c = commands.select(F.col("grp").cast("long").alias("grp"), "index", "op", "client_id", "request_id", "acked_below", "fp")
    return c.repartition("grp").sortWithinPartitions("grp", "index").mapInArrow(fold, DECISIONS)


def coupled(commands: DataFrame, max_sessions: int = MAX_SESSIONS, max_unacked: int = MAX_UNACKED) -> DataFrame:
    """Groups in which sessions might be evicted or a session refused, so that its clients do
    not decide alone: more registrations than sessions, or more requests than results."""
    regs = commands.where("op = 'register'").groupBy("grp").count().where(F.col("count") > max_sessions).select("grp")
    reqs = commands.where("client_id <> 0").groupBy("grp", "client_id").agg(F.count_distinct("request_id").alias("n")).where(F.col("n") > max_unacked).select("grp")
    return regs.unionByName(reqs).distinct()


def decisions_by_client(commands: DataFrame) -> DataFrame:
    """The same decisions, for groups that are not ``coupled``, by windows over a client: the
    running watermark makes requests stale; the first of the others executes."""
    me = Window.partitionBy("grp", "client_id").orderBy("index")
    mark = F.greatest(F.max(F.least("acked_below", "request_id")).over(me.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    registered = commands.where("op = 'register'").select("grp", F.col("index").alias("client_id"), F.lit(True).alias("known"))
    c = commands.where("op <> 'register'").join(registered, ["grp", "client_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)) & (F.col("client_id") < F.col("index")))
    c = c.withColumn("stale", F.col("request_id") < mark)
    same = Window.partitionBy("grp", "client_id", "request_id", "stale").orderBy("index")
    c = c.withColumn("first", F.first(F.struct("index", "fp")).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    is_first = F.col("first.index") == F.col("index")
    decision = (
        F.when(F.col("client_id") == 0, "executed").when(~F.col("known"), "expired").when(F.col("stale"), "stale")
        .when(is_first, "executed").when(F.col("first.fp") == F.col("fp"), "duplicate").otherwise("conflict")
    )
    c = c.withColumn("decision", decision)
    reported = F.when(F.col("decision") == "executed", F.col("index")).when(F.col("decision") == "duplicate", F.col("first.index")).otherwise(0)
    done = c.select("grp", "index", "decision", reported.cast("long").alias("reported"))
    return done.unionByName(commands.where("op = 'register'").select("grp", "index", F.lit("registered").alias("decision"), F.col("index").alias("reported")))


def decide(commands: DataFrame, max_sessions: int = MAX_SESSIONS, max_unacked: int = MAX_UNACKED) -> DataFrame:
    """FSM-01: ``decisions`` for the groups whose sessions are ``coupled``, which a fold in order
    must decide, and windows by client for all others, whose clients decide alone."""
    both = coupled(commands, max_sessions, max_unacked)
    alone = decisions_by_client(commands.join(both, "grp", "left_anti"))
    return decisions(commands.join(both, "grp", "left_semi"), max_sessions, max_unacked).unionByName(alone.select(F.col("grp").cast("long").alias("grp"), "index", "decision", "reported"))


def applied_state(commands: DataFrame, decided: DataFrame) -> DataFrame:
    """FSM-03: live keys after the writes that were executed, by index."""
    done = decided.where("decision = 'executed'").select("grp", "index")
    w = commands.where("op in ('put', 'delete')").join(done, ["grp", "index"])
    newest = F.max_by(F.struct("op", "value", "index"), "index").alias("v")
    return w.groupBy("grp", "key").agg(newest).where("v.op = 'put'").select("grp", "key", "v.value", "v.index")


def session_table(commands: DataFrame, decided: DataFrame) -> DataFrame:
    """SRC-11, FSM-05: the sessions of a snapshot, in canonical order of their requests: last use,
    watermark, and the requests still remembered. For groups without evictions."""
    regs = commands.where("op = 'register'").select("grp", F.col("index").alias("client_id"))
    used = commands.where("client_id <> 0 and op <> 'register'").join(decided.where("decision <> 'expired'"), ["grp", "index"])
    per = used.groupBy("grp", "client_id").agg(F.max("index").alias("last"), F.max(F.least("acked_below", "request_id")).alias("mark"), F.collect_set(F.when(F.col("decision") == "executed", F.col("request_id"))).alias("done"))
    t = regs.join(per, ["grp", "client_id"], "left")
    mark = F.greatest(F.coalesce("mark", F.lit(1)), F.lit(1))
    held = F.array_sort(F.filter(F.coalesce("done", F.array().cast("array<bigint>")), lambda r: r >= mark))
    return t.select("grp", "client_id", F.coalesce("last", "client_id").alias("last"), mark.cast("long").alias("acked_below"), F.array_join(held, ",").alias("requests"))


def in_flight_watermark(requests: DataFrame) -> DataFrame:
    """WIN-09 of requests(client, request, begin, end): at each begin the lowest request of the
    client still open, its own included; a request that ends as it begins is never open. A sweep
    over begins and ends in order: a task holds what is open of one client."""
    kinds = pa.schema([("client", pa.int64()), ("request", pa.int64()), ("acked_below", pa.int64())])

    def sweep(batches):
        heap: list[tuple] = []  # (request, end) of what may be open
        begun: list[int] = []  # requests that begin at this instant
        now, out = None, []

        def told():
            while heap and heap[0][1] is not None and heap[0][1] <= now[1]:
                heapq.heappop(heap)
            if heap:
                out.extend((now[0], r, heap[0][0]) for r in begun)

        for b in batches:
            for client, request, begin, end in zip(*(b.column(c).to_pylist() for c in ("client", "request", "begin", "end")), strict=True):
                if (client, begin) != now:
                    if now:
                        told()
                    if now and now[0] != client:
                        heap = []
                    begun, now = [], (client, begin)
                begun.append(request)
                heapq.heappush(heap, (request, end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)
                out = []
        if now:
            told()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)

    r = requests.select(*[F.col(c).cast("long").alias(c) for c in ("client", "request", "begin", "end")])
    return r.repartition("client").sortWithinPartitions("client", "begin").mapInArrow(sweep, "client long, request long, acked_below long")
