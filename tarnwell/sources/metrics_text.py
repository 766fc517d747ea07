"""Metric samples as exposition text: name{label="value",...} value, and # lines."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell import functions as fn

_SERIES = re.compile(r'\s*([^\s{]+)\s*(?:\{((?:[^"}]|"(?:[^"\\]|\\.)*")*)\})?\s+(\S+)(?:\s+\S+)?\s*$')
_LABEL = re.compile(r'[\s,]*([^\s=,"]+)\s*="((?:[^"\\]|\\.)*)"[\s,]*')
_NUMBERS = {"+Inf": math.inf, "Inf": math.inf, "-Inf": -math.inf, "NaN": math.nan}  # fixed values


def parse_line(line: str) -> tuple[str, dict[str, str], float] | None:
    """A sample, None for blank lines and comments; raises ValueError for others."""
    if not line.strip() or line.lstrip().startswith("#"):
        return None
    m = _SERIES.match(line)
    if not m:
        raise ValueError(f"not a sample: {line}")
    labels, at, body = {}, 0, m[2] or ""
    while at < len(body):
        p = _LABEL.match(body, at)
        if not p:
            raise ValueError(f"malformed labels: {line}")
        labels[p[1]] = re.sub(r"\\(.)", lambda e: "\n" if e[1] == "n" else e[1], p[2], flags=re.S)
        at = p.end()
    return m[1], labels, _NUMBERS[m[3]] if m[3] in _NUMBERS else float(m[3])


def read_samples(lines: DataFrame, keep: list[str]) -> DataFrame:
    """SRC-16: (keep, name, labels, value) of lines(value)."""
    source = lines.select(*keep, F.col("value").alias("__line"))
    schema = source.drop("__line").schema
    for f in lines.sparkSession.createDataFrame([], "name string, labels map<string,string>, value double").schema:
        schema = schema.add(f)

    def run(batches):
        for b in batches:
            got = [(i, s) for i, line in enumerate(b.column("__line").to_pylist()) if (s := parse_line(line)) is not None]
            kept = [b.column(c).take(pa.array([i for i, _ in got], pa.int64())) for c in keep]
            cols = [pa.array([s[0] for _, s in got], pa.string()), pa.array([list(s[1].items()) for _, s in got], pa.map_(pa.string(), pa.string())), pa.array([s[2] for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(kept + cols, [*keep, "name", "labels", "value"])

    return source.mapInArrow(run, schema)


def number_text(v):
    """A value as text: the shortest that reads back, no fraction for whole numbers."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def write_lines(samples: DataFrame) -> DataFrame:
    """SNK-06: (name, rank, line) of samples(name, labels array of (key, value), value); series of a
    name in order of their label values, numbers by value."""
    pairs = F.transform("labels", lambda x: F.concat(x["key"], F.lit('="'), fn.escape_label(x["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    order = F.transform("labels", lambda x: F.struct(F.coalesce(x["value"].try_cast("double"), F.lit(float("inf"))).alias("n"), x["value"].alias("s")))
    return samples.select("name", order.alias("rank"), F.concat("name", labels, F.lit(" "), number_text(F.col("value"))).alias("line"))
