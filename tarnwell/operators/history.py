"""Histories of operations on registers: validity, logical operations, linearizability.

history(history, id, client, kind, key, value, invoke, complete, outcome, output, client_id,
request_id); positions are logical, 0 for no completion.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Configurations that a search of one key may visit.
BUDGET = 2_000_000


def summary(h: DataFrame) -> DataFrame:
    """AGG-06, AGG-07: counts by outcome and kind, and of different keys and clients."""
    return h.groupBy("history").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "notfound", "rejected", "incomplete")],
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("put", "get", "delete")],
        F.count_distinct("key").alias("keys"),
        F.count_distinct("client").alias("clients"),
    )


def faults(h: DataFrame) -> DataFrame:
    """FLT-12: rows (history, id, fault) for what no recorded history may hold."""
    open_, done = F.col("outcome") == "incomplete", F.col("outcome") != "incomplete"
    rules = F.array(
        F.when((F.coalesce("client", F.lit("")) == "") | (F.coalesce("key", F.lit("")) == "") | F.col("kind").isNull(), "missing client, key or kind"),
        F.when(F.col("invoke") <= 0, "no invocation"),
        F.when(open_ & (F.col("complete") != 0), "incomplete with completion"),
        F.when(done & (F.col("complete") <= F.col("invoke")), "completed before its invocation"),
        F.when((F.col("outcome") == "notfound") & (F.col("kind") != "get"), "notfound of a write"),
        F.when(F.col("output").isNotNull() & ~((F.col("kind") == "get") & (F.col("outcome") == "ok")), "output without a read"),
        F.when((F.col("client_id") == 0) != (F.col("request_id") == 0), "half an identity"),
    )
    own = h.select("history", "id", F.explode(F.array_compact(rules)).alias("fault"))
    positions = h.select("history", "id", F.explode(F.array("invoke", F.when(done, F.col("complete")))).alias("at")).where("at is not null")
    shared = positions.withColumn("n", F.count("*").over(Window.partitionBy("history", "at"))).where("n > 1")
    return own.unionByName(shared.select("history", "id", F.lit("shared position").alias("fault"))).distinct()


def logical(h: DataFrame) -> DataFrame:
    """AGG-08: the sends of one identified write as one operation. The acknowledged command
    owns the identity, or else the unanswered ones', which must agree; sends of another
    command are left out. fault tells identities that break the contract."""
    is_single = (F.col("client_id") == 0) | (F.col("kind") == "get")
    fields = ["history", "id", "client", "kind", "key", "value", "invoke", "complete", "outcome", "output", "client_id", "request_id"]
    alone = h.where(is_single).select(*fields, F.lit(None).cast("string").alias("fault"))
    sends = h.where(~is_single).withColumn("cmd", F.struct("kind", "key", "value"))
    w = Window.partitionBy("history", "client_id", "request_id")
    of = lambda outcome: F.collect_set(F.when(F.col("outcome") == outcome, F.col("cmd"))).over(w)
    sends = sends.withColumn("oks", of("ok")).withColumn("open", of("incomplete")).withColumn("n", F.count("*").over(w)).withColumn("first", F.min_by("cmd", "id").over(w))
    fault = F.when(F.col("n") == 1, None).when(F.size("oks") > 1, "two commands acknowledged").when((F.size("oks") == 0) & (F.size("open") > 1), "unanswered sends differ")
    owner = F.when(F.size("oks") > 0, F.col("oks")[0]).when(F.size("open") > 0, F.col("open")[0]).otherwise(F.col("first"))
    own = sends.withColumn("fault", fault).where(F.col("fault").isNotNull() | (F.col("cmd") == owner))
    rank = F.when(F.col("outcome") == "ok", 0).when(F.col("outcome") == "incomplete", 1).otherwise(2)
    merged = own.groupBy("history", "client_id", "request_id").agg(
        F.min("id").alias("id"), F.min_by("client", "id").alias("client"), F.min_by("cmd", "id").alias("cmd"), F.min("invoke").alias("invoke"),
        F.min(F.struct(rank.alias("r"), F.when(rank == 1, 0).otherwise(F.col("complete")).alias("complete"), "outcome")).alias("end"), F.max("fault").alias("fault"),
    )
    merged = merged.select("history", "id", "client", "cmd.kind", "cmd.key", "cmd.value", "invoke", "end.complete", "end.outcome", F.lit(None).cast("string").alias("output"), "client_id", "request_id", "fault")
    return alone.unionByName(merged)


def effective(h: DataFrame) -> DataFrame:
    """FLT-03: what a linearization may hold: refused operations and open reads drop out."""
    return h.where("outcome <> 'rejected' and not (outcome = 'incomplete' and kind = 'get')")


def sequential_faults(h: DataFrame) -> DataFrame:
    """LIN-03: reads that contradict the last write before them, for histories known to be
    sequential. Writes that were not acknowledged count as done."""
    w = Window.partitionBy("history", "key").orderBy("invoke").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("kind") == "put", F.struct(F.lit(True).alias("present"), "value")).when(F.col("kind") == "delete", F.struct(F.lit(False).alias("present"), F.lit(None).cast("string").alias("value")))
    before = F.last(write, ignorenulls=True).over(w)
    seen = effective(h).withColumn("before", before)
    present = F.coalesce(F.col("before.present"), F.lit(False))
    wrong = F.when(F.col("outcome") == "notfound", present).otherwise(~present | ~F.col("output").eqNullSafe(F.col("before.value")))
    return seen.where((F.col("kind") == "get") & wrong).select("history", "key", "id", "output", F.when(present, F.col("before.value")).alias("expected"))


def screens(h: DataFrame) -> DataFrame:
    """LIN-07: reads that no linearization explains, by cheap conditions: of a value that nobody
    wrote, or that completed before its only writer began. Not a verdict on the others."""
    writes = effective(h).where("kind = 'put'").groupBy("history", "key", F.col("value").alias("output")).agg(F.min("invoke").alias("first_write"))
    reads = h.where("kind = 'get' and outcome = 'ok'")
    found = reads.join(writes, ["history", "key", "output"], "left")
    why = F.when(F.col("first_write").isNull(), "never written").when(F.col("complete") < F.col("first_write"), "read before written")
    return found.withColumn("screen", why).where("screen is not null").select("history", "key", "id", "screen")


class Register:
    """Linearizability of one key by following events in order: after each, all states that
    some order of the operations so far can have led to.

    A configuration is (writes that took effect while still open, value). An operation's
    completion keeps the configurations in which it has taken effect, after any open ones
    that may have gone before it. None left: nothing explains it. Operations that never
    complete stay open. States number few, as only operations open together multiply them.
    """

    def __init__(self, ops: list[dict], budget: int = BUDGET):
        self.budget, self.visited = budget, 0
        self.ops = [o for o in ops if o["outcome"] != "rejected" and not (o["outcome"] == "incomplete" and o["kind"] == "get")]
        self.culprit: int | None = None
        self.verdict = self._run()

    def _steps(self, op: dict, value):
        """The value after op, or nothing if what it saw contradicts the value."""
        if op["kind"] == "put":
            return [op["value"]]
        if op["kind"] == "delete":
            return [None]
        saw = op["output"] if op["outcome"] == "ok" else None
        return [value] if saw == value else []

    def _run(self) -> str:
        events = []
        for i, o in enumerate(self.ops):
            events.append((o["invoke"], 0, i))
            if o["outcome"] != "incomplete":
                events.append((o["complete"], 1, i))
        pending: set[int] = set()
        states = {(frozenset(), None)}
        for _, ends, i in sorted(events):
            if not ends:
                pending.add(i)
                continue
            done, todo = set(), list(states)
            seen = set(states)
            while todo:
                placed, value = todo.pop()
                self.visited += 1
                if self.visited > self.budget:
                    self.culprit = self.ops[i]["id"]
                    return "unchecked"
                if i in placed:
                    done.add((placed - {i}, value))
                    continue
                for j in pending - placed:
                    for v in self._steps(self.ops[j], value):
                        nxt = (placed | {j}, v)
                        if nxt not in seen:
                            seen.add(nxt)
                            todo.append(nxt)
            pending.discard(i)
            if not done:
                self.culprit = self.ops[i]["id"]
                return "violation"
            states = done
        return "ok"


def minimal(ops: list[dict], budget: int = BUDGET) -> list[dict]:
    """LIN-05: fewer operations that end in the same violation, none of which can be spared.

    The culprit is a read that nothing explains when it completes, so what begins later has no
    part in it. Of the rest, writes go with all the reads of their value, as a value that was
    read must have been written; whole clients are tried first, then values and single
    operations from the last to begin backwards, until nothing more can go.
    """
    whole = Register(ops, budget)
    if whole.verdict != "violation":
        return ops
    culprit = next(o for o in ops if o["id"] == whole.culprit)

    def same(some: dict[int, dict]) -> bool:
        got = Register(list(some.values()), budget)
        return got.verdict == "violation" and got.culprit == whole.culprit

    def without(some: dict[int, dict], gone: set[int]) -> dict[int, dict] | None:
        """some less these and the reads that lose their last writer; None if the culprit goes."""
        left = {i: o for i, o in some.items() if i not in gone}
        values = {o["value"] for o in left.values() if o["kind"] == "put"}
        lost = {o["value"] for o in some.values() if o["kind"] == "put"} - values
        left = {i: o for i, o in left.items() if not (o["kind"] == "get" and o["outcome"] == "ok" and o["output"] in lost)}
        return left if culprit["id"] in left else None

    kept = {o["id"]: o for o in ops}
    early = without(kept, {o["id"] for o in ops if o["invoke"] > culprit["complete"]})
    if early is not None and same(early):
        kept = early
    clients: dict[str, set[int]] = {}
    for o in kept.values():
        clients.setdefault(o.get("client"), set()).add(o["id"])

    def spare(units) -> bool:
        """Leave out each unit that can go; whether any did."""
        nonlocal kept
        was = len(kept)
        for unit in units:
            fewer = without(kept, unit) if kept.keys() & unit else None
            if fewer is not None and same(fewer):
                kept = fewer
        return len(kept) < was

    spare(clients.values())
    while spare([{o["id"]} for o in sorted(kept.values(), key=lambda o: -o["invoke"])]):
        pass
    return [o for o in ops if o["id"] in kept]


_VERDICT = "history string, key string, ops long, verdict string, culprit long, visited long, counterexample array<long>"


def linearizability(h: DataFrame, budget: int = BUDGET, minimize: bool = False) -> DataFrame:
    """LIN-01, LIN-02, LIN-06: a verdict for each key of each history: ok, violation with the
    first operation that nothing explains, or unchecked when the budget ran out. Logical
    operations are checked; keys are independent, and a task holds one at a time."""

    names = [f.split()[0] for f in _VERDICT.split(", ")]
    needed = ["history", "key", "id", "client", "kind", "value", "invoke", "complete", "outcome", "output", "fault"]

    def decide(rows: list[dict]) -> tuple:
        bad = [r["id"] for r in rows if r["fault"]]
        if bad:
            return (rows[0]["history"], rows[0]["key"], len(rows), "identity", min(bad), 0, None)
        r = Register(rows, budget)
        few = [o["id"] for o in minimal(rows, budget)] if minimize and r.verdict == "violation" else None
        return (rows[0]["history"], rows[0]["key"], len(rows), r.verdict, r.culprit, r.visited, few)

    def run(batches):
        def out(done):
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        held, now, done = [], None, []
        for b in batches:
            for row in b.to_pylist():
                if (row["history"], row["key"]) != now:
                    if held:
                        done.append(decide(held))
                        if len(done) >= 1000:
                            yield out(done)
                            done = []
                    held, now = [], (row["history"], row["key"])
                held.append(row)
        if held:
            done.append(decide(held))
        if done:
            yield out(done)

    return logical(h).select(*needed).repartition("history", "key").sortWithinPartitions("history", "key", "invoke", "id").mapInArrow(run, _VERDICT)


def verdicts(per_key: DataFrame, invalid: DataFrame) -> DataFrame:
    """A history's verdict from those of its keys: ok only if all are, and it is valid."""
    bad = invalid.select("history").distinct().withColumn("invalid", F.lit(True))
    each = per_key.groupBy("history").agg(F.bool_and(F.col("verdict") == "ok").alias("ok"), F.bool_or(F.col("verdict") == "unchecked").alias("unchecked"), F.min(F.when(F.col("verdict") != "ok", F.col("key"))).alias("key"))
    j = each.join(bad, "history", "left")
    return j.select("history", F.when(F.col("invalid"), "invalid").when(F.col("ok"), "ok").when(F.col("unchecked"), "unchecked").otherwise("violation").alias("verdict"), "key")


def intervals(events: DataFrame) -> DataFrame:
    """LIN-08: begin and end events(history, id, what, at) to intervals; without an end, 0."""
    first = lambda what: F.min(F.when(F.col("what") == what, F.col("at")))
    return events.groupBy("history", "id").agg(first("begin").alias("invoke"), F.coalesce(first("end"), F.lit(0)).alias("complete"))
