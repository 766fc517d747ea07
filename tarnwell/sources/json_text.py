"""JSON as nodes and runs write it: status reports, a line each, and schedules of faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "node string, grp long, role string, term long, leader string, commit long, applied long, last_index long, conf_index long, removed boolean, voters array<string>, outgoing array<string>, matches map<string,long>"
FAULT = "at_ns long, kind string, grp long, node string, peer string, hold_ns long"


def read_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """SRC-17: status reports of lines of JSON, with ``fault`` where a line is none: fields that
    are missing are null, others are passed over."""
    got = F.from_json(line, STATUS, {"mode": "PERMISSIVE"})
    bad = F.when(got.isNull() | got["node"].isNull() | got["grp"].isNull(), "unreadable")
    return lines.select(got.alias("s"), bad.alias("fault")).select("s.*", "fault")


def write_status(status: DataFrame) -> DataFrame:
    """A line of JSON for each report."""
    return status.select(F.to_json(F.struct(*[f.split()[0] for f in STATUS.split(", ") if f.split()[0] in status.columns])).alias("line"))


def read_schedules(files: DataFrame, run: str = "run", text: str = "text") -> DataFrame:
    """SRC-18: the faults of each run's schedule, an array of JSON, with their place in it."""
    each = F.posexplode(F.from_json(text, f"array<struct<{FAULT.replace(' ', ':').replace(',:', ',')}>>"))
    return files.select(run, each.alias("place", "f")).select(run, "place", "f.*")


def write_schedules(faults: DataFrame, run: str = "run") -> DataFrame:
    """run and text: the faults of each run in order of time, as one array. A schedule is a run's
    own list, which its length bounds."""
    names = [f.split()[0] for f in FAULT.split(", ")]
    return faults.groupBy(run).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*names)))).alias("text"))
