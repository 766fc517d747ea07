"""Known answers: tokens, groups, statistics, outages, causes, exposition text, checksums."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell import functions as fn
from tarnwell.functions import bloom
from tarnwell.operators import cluster, history, measure, routing, sessions, storage
from tarnwell.sources import framed, history_text, metrics_text

KEYS = [b"", b"user:123", bytes([0]), bytes.fromhex("fffefd0001"), b"The quick brown fox", bytes(8)]


def test_tokens_and_shards(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS)], "i int, k binary")
    hexes = [f"{int(r.t):016x}" for r in df.select("i", fn.token_of(F.col("k")).alias("t")).orderBy("i").collect()]
    assert hexes[:5] == ["e3b0c44298fc1c14", "61b7de306ccf11d6", "6e340b9cffb37a98", "491865266935dcc5", "5cac4f980fedc3d3"]
    assert [r.shard for r in routing.route(df, "k", 16).orderBy("i").collect()] == [8, 6, 6, 3, 11, 1]


def test_replica_groups_and_redistribution(spark):
    groups = {r.shard: r.replicas for r in routing.replica_groups(spark, 16, ["n2", "n0", "n1"], 3).collect()}
    assert len(groups) == 16 and all(sorted(g) == ["n0", "n1", "n2"] for g in groups.values())
    assert routing.group_faults(routing.replica_groups(spark, 16, ["n0", "n1", "n2"], 3), 3).count() == 0
    nodes = [f"n{i}" for i in range(4)]
    for before, after, want in ((nodes[:3], nodes, (141, 383)), (nodes, nodes[:3], (141, 383)), (list("abcde"), list("abcdef"), (68, 425))):
        r = routing.redistribution(spark, 512, before, after).first()
        assert (r.moved, r.moved_by_modulo) == want
    shares = routing.ownership(routing.node_ring(spark, nodes)).collect()
    assert sum(r.share for r in shares) == pytest.approx(1, abs=1e-6)


def test_latencies(spark):
    r = measure.latency_stats(spark.range(1, 101).select(F.lit(1).alias("g"), (F.col("id") * 1000).alias("ns")), ["g"]).first()
    assert (r.n, r.min_us, r.mean_us, r.p50_us, r.p90_us, r.p99_us, r.p999_us, r.max_us) == (100, 1, 50.5, 50, 90, 99, 100, 100)


def test_outages(spark):
    rows = [(0, 0, 0), (100, 0, 1), (200, 5, 0), (300, 0, 3), (400, 0, 0), (500, 0, 0), (600, 7, 0), (700, 0, 0)]
    points = spark.createDataFrame([("r", at // 100, ok, bad) for at, ok, bad in rows], "run string, b int, ok long, failed long")
    for start, end, want in ((0, 800, 300), (200, 700, 300), (500, 700, 100), (0, 50, 0)):
        assert measure.longest_outage(points, 100, start, end).first().outage_ns == want


def test_run_summaries(spark):
    def of(*v):
        return measure.run_summary(spark.createDataFrame([("c", float(x)) for x in v], "config string, value double"), ["config"]).first()

    assert (of(30, 10, 20).median, of(30, 10, 20).spread, of(30, 10, 20).p95) == (20, 1, None)
    assert of(1, 2, 3, 4).median == 2.5 and of(*range(1, 21)).p95 == 19


def test_unknown_causes(spark):
    cases = [
        ("context canceled", [("x", "")], "cancelled"),
        ("", [("", "UNKNOWN_OUTCOME")], "unanswered at give-up"),
        ("", [("broken", ""), ("", "NOT_LEADER"), ("node unavailable", "")], "refused until give-up"),
        ("", [("", "NOT_LEADER")], "other"),
        ("", [("broken", ""), ("", "OK")], "other"),
        ("", [], "other"),
    ]
    df = spark.createDataFrame([(i, e, [{"err": x, "status": s} for x, s in a]) for i, (e, a, _) in enumerate(cases)], "i int, err string, a array<struct<err:string,status:string>>")
    got = [r.c for r in df.select("i", measure.unknown_cause(F.col("err"), F.col("a")).alias("c")).orderBy("i").collect()]
    assert got == [c for *_, c in cases]


def test_commit_index(spark):
    def of(match, outgoing, terms, term, commit):
        df = spark.createDataFrame([(match, outgoing, terms, term, commit)], "m array<long>, o array<long>, t array<long>, term long, c long")
        return df.select(cluster.commit_index(F.col("m"), F.col("o"), F.col("t"), F.col("term"), F.col("c")).alias("x")).first().x

    assert of([5, 3, 4], [], [1] * 5, 1, 2) == 4
    assert of([5, 3, 4], [1, 2, 2], [1] * 5, 1, 0) == 2
    assert of([5, 3, 4], [], [1, 1, 1, 1, 2], 2, 2) == 2  # not of the current term
    assert of([5, 5], [], [1] * 5, 1, 2) == 5 and of([5, 1], [], [1] * 5, 1, 0) == 1


def test_merge_equals_a_plain_merge(spark):
    for seed in range(6):
        rng = random.Random(seed)
        rows, seq = [], 0
        for file in range(rng.randint(1, 6)):
            for _ in range(rng.randint(0, 24)):
                seq += 1
                rows.append((file, f"key{rng.randrange(15):02d}", seq, int(rng.random() > 0.25), f"v{seq}"))
        df = spark.createDataFrame(rows, "file int, key string, seq long, kind int, value string")
        last = {}
        for _, k, s, kind, v in rows:
            last[k] = (s, kind, v)
        for bottom in (True, False):
            want = sorted((k, *x) for k, x in last.items() if x[1] or not bottom)
            assert sorted(tuple(r) for r in storage.compact(df, bottom).collect()) == want
            c = storage.compaction_counters(df, bottom).first()
            stones = sum(1 for x in last.values() if not x[1])
            assert tuple(c) == (len(rows), len(want), len(rows) - len(last), stones * bottom, stones * (not bottom), len(last))


class Model:
    """Sessions stated over the whole list of commands before each."""

    def __init__(self, sessions_, unacked):
        self.limit, self.unacked, self.s = sessions_, unacked, {}

    def step(self, i, op, client, request, acked, fp):
        if op == "register":
            self.s[i] = {"last": i, "low": 1, "done": {}}
            if len(self.s) > self.limit:
                self.s.pop(min(self.s, key=lambda k: self.s[k]["last"]))
            return "registered", i
        if not client:
            return "executed", i
        if client not in self.s:
            return "expired", 0
        me = self.s[client]
        me["last"], me["low"] = i, max(me["low"], min(acked, request))
        me["done"] = {r: v for r, v in me["done"].items() if r >= me["low"]}
        if request < me["low"]:
            return "stale", 0
        if request in me["done"]:
            return ("duplicate", me["done"][request][1]) if me["done"][request][0] == fp else ("conflict", 0)
        if len(me["done"]) >= self.unacked:
            return "limit", 0
        me["done"][request] = (fp, i)
        return "executed", i


def test_session_decisions_equal_a_model(spark):
    rng, rows, want, seen = random.Random(7), [], {}, set()
    for grp in range(120):
        m, ids = Model(3, 4), []
        for i in range(1, 61):
            op = "register" if rng.random() < 0.15 or not ids else "put"
            client = 0 if op == "register" or rng.random() < 0.05 else rng.choice(ids)
            request = rng.randint(1, 12) if client else 0
            row = (grp, i, op, client, request, rng.randint(1, request) if request else 0, rng.choice("ab"))
            rows.append(row)
            want[grp, i] = m.step(*row[1:])
            seen.add(want[grp, i][0])
            ids += [i] if op == "register" else []
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp long, index long, op string, client_id long, request_id long, acked_below long, fp string")
    assert {(r.grp, r["index"]): (r.decision, r.reported) for r in sessions.decisions(df, 3, 4).collect()} == want
    assert seen == {"registered", "executed", "duplicate", "conflict", "stale", "expired", "limit"}
    assert {(r.grp, r["index"]): (r.decision, r.reported) for r in sessions.decide(df, 3, 4).collect()} == want
    free = {(r.grp, r["index"]): (r.decision, r.reported) for r in sessions.decisions(df, 10**6, 10**6).collect()}
    assert {(r.grp, r["index"]): (r.decision, r.reported) for r in sessions.decisions_by_client(df).collect()} == free
    assert sessions.coupled(df, 3, 4).count() > 0 and sessions.coupled(df, 10**6, 10**6).count() == 0


def test_session_limits_over_events(spark, sf_dir):
    """The query with evictions and refusals against the plain model, group by group."""
    from tarnwell.plans.history_queries import commands, session_limits

    log = commands(spark.read.parquet(f"{sf_dir}/events.parquet")).orderBy("grp", "index").collect()
    models = {}
    want = {(r.grp, r["index"]): models.setdefault(r.grp, Model(4, 2)).step(r["index"], r.op, r.client_id, r.request_id, r.acked_below, r.fp) for r in log}
    assert {(r.grp, r["index"]): (r.decision, r.reported) for r in session_limits(spark, sf_dir).collect()} == want
    assert {"expired", "executed", "duplicate", "limit"} <= {d for d, _ in want.values()} and max(len(m.s) for m in models.values()) == 4


def test_lowest_request_in_flight(spark):
    """The sweep against all pairs: ties, requests that never end, and ones that end as they begin."""
    rng = random.Random(4)
    rows = [(rng.randrange(4), i, b, None if rng.random() < 0.1 else b + rng.randrange(25)) for i, b in enumerate(rng.randrange(300) for _ in range(400))]
    got = sorted(tuple(r) for r in sessions.in_flight_watermark(spark.createDataFrame(rows, "client long, request long, begin long, end long")).collect())
    want = []
    for c, r, b, _ in rows:
        open_ = [q for d, q, x, e in rows if d == c and x <= b and (e is None or e > b)]
        want += [(c, r, min(open_))] if open_ else []
    assert got == sorted(want)


def test_segments_and_truncation(spark):
    rows = [(i, bytes([i % 251]) * (i % 7)) for i in range(100)]
    files = framed.segments(spark.createDataFrame(rows, "at long, record binary"), "at", "record", 16)
    want = {k: b"".join(b for i, b in rows if i // 16 == k) for k in range(7)}
    assert {r.segment: bytes(r.content) for r in files.collect()} == want
    assert sorted(r.segment for r in framed.kept_segments(files, 40, 16).collect()) == [2, 3, 4, 5, 6]


#: Histories in short: client kind@begin-end=value, "!" refused, "?" never answered, "0" not found.
GOOD = {
    "one after another": "a put@1-2=x a get@3-4=x a delete@5-6 a get@7-8=0",
    "overlapping writes, either may be last": "a put@1-4=x b put@2-3=y c get@5-6=x",
    "a read during a write sees the new value": "a put@1-2=x b put@3-6=y c get@4-5=y",
    "a read during a write sees the old value": "a put@1-2=x b put@3-6=y c get@4-5=x",
    "an unanswered write took effect": "a put@1-?=x b get@2-3=x",
    "an unanswered write never took effect": "a put@1-?=x b get@2-3=0",
    "an unanswered write takes effect late": "a put@1-?=x b get@2-3=0 b get@4-5=x",
    "a refused write left out": "a put@1-2=x b put@3-4=y! c get@5-6=x",
    "an unanswered read says nothing": "a put@1-2=x b get@3-? a get@4-5=x",
    "an empty value is there": "a put@1-2= b get@3-4=",
    "delete and write together": "a put@1-2=x b delete@3-6 c put@4-5=y d get@7-8=0",
    "delete of nothing": "a delete@1-2 a delete@3-4 a get@5-6=0",
}
BAD = {
    "a read of what nobody wrote": "a put@1-2=x b get@3-4=z",
    "an older value after a newer one": "a put@1-2=x a put@3-4=y b get@5-6=x",
    "a write that is lost": "a put@1-2=x b get@3-4=0",
    "a value before its write": "b get@1-2=x a put@3-4=x",
    "a refused write is seen": "a put@1-2=x! b get@3-4=x",
    "a deleted value is seen": "a put@1-2=x a delete@3-4 b get@5-6=x",
    "two readers, two orders": "a put@1-4=x b put@2-3=y c get@5-6=x d get@7-8=y",
    "seen, then not, then seen": "a put@1-?=x b get@2-3=x b get@4-5=0",
    "an empty value read as nothing": "a put@1-2= b get@3-4=0",
    "nothing read as an empty value": "b get@1-2=",
    "an unanswered write before it was sent": "b get@1-2=x a put@3-?=x",
    "both of two writes last": "a put@1-2=x b put@3-4=y c get@5-6=y d get@7-8=x",
}


def lines_of(name, short):
    import re

    for i, (client, kind, begin, end, value, refused) in enumerate(re.findall(r"(\w) (\w+)@(\d+)-(\d+|\?)(=\w*)?(!)?", short)):
        outcome = "rejected" if refused else "incomplete" if end == "?" else "notfound" if kind == "get" and value == "=0" else "ok"
        shown = "" if kind == "delete" or outcome == "notfound" or not value else f' {"value" if kind == "put" else "output"}="{value[1:]}"'
        yield name, f'{i + 1} {client} {kind} "k" {begin} {0 if end == "?" else end} {outcome}{shown}'


def test_known_histories(spark):
    rows = [r for part, all_ in (("good/", GOOD), ("bad/", BAD)) for name, short in all_.items() for r in lines_of(part + name, short)]
    ops = history_text.read_history(spark.createDataFrame(rows + [("good/" + n, "# " + n) for n in GOOD], "history string, value string"), ["history"]).cache()
    assert ops.count() == len(rows) and history.faults(ops).count() == 0
    per_key = history.linearizability(ops, minimize=True).cache()
    got = {r.history: r.verdict for r in history.verdicts(per_key, history.faults(ops)).collect()}
    assert got == {h: "ok" if h.startswith("good/") else "violation" for h, _ in rows}
    for r in per_key.where("verdict = 'violation'").collect():
        assert r.culprit in r.counterexample


def test_identities(spark):
    """Sends of one request are one operation; two acknowledged commands break the contract."""
    def verdict(*lines):
        ops = history_text.read_history(spark.createDataFrame([("h", x) for x in lines], "history string, value string"), ["history"])
        return history.linearizability(ops).first().verdict

    retry = '1 a put "k" 1 0 incomplete value="x" cid=1 rid=1', '2 a put "k" 4 5 ok value="x" cid=1 rid=1'
    assert verdict(*retry, '3 b get "k" 2 3 ok output="x"') == "ok"  # the first send took effect
    assert verdict(*retry, '3 b put "k" 6 7 ok value="y"', '4 b get "k" 8 9 ok output="x"') == "violation"  # not twice
    assert verdict('1 a put "k" 1 2 ok value="x" cid=1 rid=1', '2 a put "k" 3 4 ok value="y" cid=1 rid=1') == "identity"
    assert verdict('1 a put "k" 1 2 ok value="x" cid=1 rid=1', '2 a put "k" 3 4 rejected value="y" cid=1 rid=1', '3 b get "k" 5 6 ok output="x"') == "ok"


def brute(ops):
    """Some order of all that completed and of any open writes explains every read."""
    from itertools import permutations

    ops = [o for o in ops if o["outcome"] != "rejected" and not (o["outcome"] == "incomplete" and o["kind"] == "get")]
    must = [o for o in ops if o["outcome"] != "incomplete"]
    maybe = [o for o in ops if o["outcome"] == "incomplete"]
    for bits in range(1 << len(maybe)):
        chosen = must + [o for i, o in enumerate(maybe) if bits >> i & 1]
        for order in permutations(chosen):
            if any(b["outcome"] != "incomplete" and b["complete"] < a["invoke"] for i, a in enumerate(order) for b in order[i + 1 :]):
                continue
            value, fine = None, True
            for o in order:
                if o["kind"] == "put":
                    value = o["value"]
                elif o["kind"] == "delete":
                    value = None
                elif (o["output"] if o["outcome"] == "ok" else None) != value:
                    fine = False
                    break
            if fine:
                return True
    return False


def test_register_search_equals_brute_force():
    rng, seen = random.Random(11), set()
    for _ in range(400):
        n = rng.randint(1, 5)
        at = rng.sample(range(1, 40), 2 * n)
        ops = []
        for i in range(n):
            a, b = sorted(at[2 * i : 2 * i + 2])
            kind = rng.choice(["put", "get", "get", "delete"])
            outcome = rng.choice(["ok", "ok", "incomplete", "rejected"]) if kind != "get" else rng.choice(["ok", "notfound", "incomplete"])
            ops.append({"id": i, "kind": kind, "value": rng.choice("xy") if kind == "put" else None, "output": rng.choice("xy") if kind == "get" and outcome == "ok" else None, "invoke": a, "complete": 0 if outcome == "incomplete" else b, "outcome": outcome})
        verdict = history.Register(ops).verdict
        seen.add(verdict)
        assert verdict == ("ok" if brute(ops) else "violation"), ops
    assert seen == {"ok", "violation"}
    many = [{"id": i, "kind": "put", "value": str(i), "output": None, "invoke": i + 1, "complete": 1000 + i, "outcome": "ok"} for i in range(14)]
    assert history.Register(many, budget=1000).verdict == "unchecked"


def test_metrics_text():
    name, labels, value = metrics_text.parse_line('op_x{k="a\\"b\\\\c\\nd", le="+Inf"} 42 1700000000')
    assert (name, labels, value) == ("op_x", {"k": 'a"b\\c\nd', "le": "+Inf"}, 42)
    assert metrics_text.parse_line("a +Inf")[2] == float("inf") and metrics_text.parse_line("# HELP x") is None
    for bad in ('op_bad{a="x} 1', "op_novalue"):
        with pytest.raises(ValueError):
            metrics_text.parse_line(bad)


def test_metrics_lines(spark):
    rows = [("c", [("kind", 'q"x\\y'), ("le", le)], v) for le, v in (("+Inf", 5.0), ("1", 4.0), ("0.1", 2.0))] + [("b", [("group", g)], v) for g, v in (("10", 3.0), ("2", 1.5))] + [("a", [], -1.5)]
    df = spark.createDataFrame([(n, [{"key": k, "value": v} for k, v in ls], x) for n, ls, x in rows], "name string, labels array<struct<key:string,value:string>>, value double")
    got = [r.line for r in metrics_text.write_lines(df).orderBy("name", "rank").collect()]
    assert got == ["a -1.5", 'b{group="2"} 1.5', 'b{group="10"} 3', 'c{kind="q\\"x\\\\y",le="0.1"} 2', 'c{kind="q\\"x\\\\y",le="1"} 4', 'c{kind="q\\"x\\\\y",le="+Inf"} 5']


def test_checksums_and_records():
    assert framed.crc32c([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    one = lambda k, p: framed.framed.func(__import__("pandas").Series([k]), __import__("pandas").Series([p]))[0]
    log = one(1, b"hello") + one(2, b"") + one(3, b"x" * 300)
    [(got, state, at)] = framed.records([log])
    assert [(k, p) for _, k, p in got] == [(1, b"hello"), (2, b""), (3, b"x" * 300)] and (state, at) == ("clean", len(log))
    damaged = [log[:-1], log[:10] + b"!" + log[11:], log + bytes(20), log + bytes(20) + b"x", b""]
    assert [r[1:] for r in framed.records(damaged)] == [("torn", len(log) - 309), ("corrupt", 0), ("torn", len(log)), ("corrupt", len(log)), ("clean", 0)]
    assert framed.crc32c([bytes(5)])[0] == 0x45727635


def test_commands(spark):
    rows = [("put", b"k", b"", 0, 0, 0), ("put", b"key", b"v" * 200, 300, 5, 2), ("delete", b"k", None, 0, 0, 0), ("delete", b"k", None, 7, 1, 1), ("register", None, None, 0, 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, op string, k binary, v binary, c long, r long, a long")
    for r in df.withColumn("raw", framed.command(*[F.col(x) for x in ("op", "k", "v", "c", "r", "a")])).collect():
        got = framed.decode_command(bytes(r.raw))
        assert (got["op"], got["key"], got["client_id"], got["request_id"], got["acked_below"]) == (r.op, r.k, r.c, r.r, r.a)
        assert framed.decode_command(bytes(r.raw) + b"!") is None and framed.decode_command(bytes(r.raw)[:-1]) is None


def test_bloom():
    keys = [f"key{i}".encode() for i in range(2000)]
    b = bloom.Bloom(keys)
    assert b.may_hold(keys).all() and b.k == 7 and b.m == 20_000
    assert b.may_hold([f"other{i}".encode() for i in range(4000)]).mean() < 0.02
    assert not bloom.Bloom([]).may_hold(keys).any() and bloom.probes(0) == 1 and bloom.bits(0, 10) == 64


def test_history_lines_round_trip():
    line = '7 c1 put "k \\"x\\"" 3 9 ok value="a\\nb" cid=4 rid=2 node=n1 term=3 index=8'
    op = history_text.parse_line(line)
    assert (op["key"], op["value"], op["client_id"], op["node"], op["index"]) == ('k "x"', "a\nb", 4, "n1", 8)
    assert history_text.unquote(history_text.quote('é"\\\n\0')) == 'é"\\\n\0'
    for bad in ('1 c put "k" 1 0 ok', "1 c put k 1 2 ok", '1 c put "k 1 2 ok', '1 c put "k" 1 2 ok what=3'):
        with pytest.raises(ValueError):
            history_text.parse_line(bad)
