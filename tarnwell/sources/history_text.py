"""Histories of client operations as text: one operation a line, # for comments.

    id client kind "key" invoke complete outcome [value="v"] [output="v"] [cid=c rid=r] [node=n term=t index=i]
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS, OUTCOMES = ("put", "get", "delete"), ("incomplete", "ok", "notfound", "rejected")
OP_SCHEMA = "id long, client string, kind string, key string, value string, invoke long, complete long, outcome string, output string, client_id long, request_id long, node string, term long, index long"
_TOKEN = re.compile(r'\s*((?:[^\s"]|"(?:[^"\\]|\\.)*")+)')
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"'}


def unquote(s: str) -> str:
    """A quoted string's text; raises ValueError if it is not one."""
    if len(s) < 2 or s[0] != '"' or s[-1] != '"':
        raise ValueError(f"not quoted: {s}")

    def one(m):
        e = m[1]
        if e[0] in "xuU":
            return chr(int(e[1:], 16))
        if len(e) == 3 and e.isdigit():
            return chr(int(e, 8))
        if e not in _NAMED:
            raise ValueError(f"bad escape in {s}")
        return _NAMED[e]

    return _ESCAPE.sub(one, s[1:-1])


def quote(s: str) -> str:
    back = {v: "\\" + k for k, v in _NAMED.items()}
    return '"' + "".join(back.get(c) or (c if c.isprintable() else f"\\u{ord(c):04x}") for c in s) + '"'


def parse_line(line: str) -> dict | None:
    """An operation, None for blank lines and comments; raises ValueError for others."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    parts, at = [], 0
    while at < len(line):
        m = _TOKEN.match(line, at)
        if not m:
            raise ValueError(f"unterminated quote in {line}")
        parts.append(m[1])
        at = m.end()
    if len(parts) < 7 or parts[2] not in KINDS or parts[6] not in OUTCOMES:
        raise ValueError(f"not an operation: {line}")
    op = dict.fromkeys((f.split()[0] for f in OP_SCHEMA.split(", ")), None)
    op |= {"id": int(parts[0]), "client": parts[1], "kind": parts[2], "key": unquote(parts[3]), "invoke": int(parts[4]), "complete": int(parts[5]), "outcome": parts[6], "client_id": 0, "request_id": 0}
    for field in parts[7:]:
        name, eq, v = field.partition("=")
        if name in ("value", "output") and eq:
            op[name] = unquote(v)
        elif name == "node" and eq:
            op["node"] = v
        elif name in ("cid", "rid", "term", "index") and eq:
            op[{"cid": "client_id", "rid": "request_id"}.get(name, name)] = int(v)
        else:
            raise ValueError(f"unknown field {field} in {line}")
    if (op["outcome"] == "incomplete") != (op["complete"] == 0):
        raise ValueError(f"outcome {op['outcome']} with completion {op['complete']} in {line}")
    if op["kind"] == "put" and op["value"] is None:
        op["value"] = ""
    return op


def read_history(lines: DataFrame, keep: list[str]) -> DataFrame:
    """SRC-15: operations of lines(value, ...), with the columns ``keep`` (a history's name, say)."""
    names = [f.split()[0] for f in OP_SCHEMA.split(", ")]
    source = lines.select(*keep, F.col("value").alias("__line"))
    schema = source.drop("__line").schema
    for f in lines.sparkSession.createDataFrame([], OP_SCHEMA).schema:
        schema = schema.add(f)

    def run(batches):
        for b in batches:
            got = [(i, op) for i, line in enumerate(b.column("__line").to_pylist()) if (op := parse_line(line)) is not None]
            kept = [b.column(c).take(pa.array([i for i, _ in got], pa.int64())) for c in keep]
            kinds = [pa.string() if f.split()[1] == "string" else pa.int64() for f in OP_SCHEMA.split(", ")]
            cols = [pa.array([op[n] for _, op in got], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + cols, [*keep, *names])

    return source.mapInArrow(run, schema)


def line_of():
    """SNK-05: the line of an operation whose strings need no escapes but quotes."""

    def quoted(c):
        return F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    head = F.concat_ws(" ", "id", "client", "kind", quoted("key"), "invoke", "complete", "outcome")
    value = F.when(F.col("kind") == "put", F.concat(F.lit(" value="), quoted("value"))).otherwise("")
    output = F.when((F.col("kind") == "get") & (F.col("outcome") == "ok"), F.concat(F.lit(" output="), quoted("output"))).otherwise("")
    who = F.when(F.col("client_id") != 0, F.concat(F.lit(" cid="), "client_id", F.lit(" rid="), "request_id")).otherwise("")
    where = F.when(F.coalesce("node", F.lit("")) != "", F.concat(F.lit(" node="), "node", F.lit(" term="), "term", F.lit(" index="), "index")).otherwise("")
    return F.concat(head, value, output, who, where)
