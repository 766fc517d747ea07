"""Versioned storage: last writer wins, compaction, probes, file sets, manifests.

A version is (key, seq, kind, value): kind 1 a value, 0 a tombstone. seq is unique, and the
highest of a key wins. Nothing here collects; every operator is one or two shuffles by key,
file or edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included. One partial aggregation, by hash
    where values are of fixed width (a struct of them would make Spark sort)."""
    return versions.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"), F.max_by("value", "seq").alias("value"))


def snapshot(versions: DataFrame) -> DataFrame:
    """AGG-01, SRC-09: live keys, the newest version of each unless it is a tombstone."""
    return latest(versions).where("kind = 1").select("key", "seq", "value")


def as_of(versions: DataFrame, seq: int) -> DataFrame:
    """FLT-06: the snapshot that a reader at ``seq`` sees. The filter reaches the scan."""
    return snapshot(versions.where(F.col("seq") <= seq))


def probe(keys: DataFrame, versions: DataFrame) -> DataFrame:
    """JOI-03: keys(key) with what a lookup finds: value, tombstone or absent. Versions of
    keys that nobody asks for are dropped before they are aggregated."""
    asked = versions.join(keys.select("key").distinct(), "key", "left_semi")
    outcome = F.when(F.col("kind").isNull(), "absent").when(F.col("kind") == 0, "tombstone").otherwise("value")
    return keys.join(latest(asked), "key", "left").select("key", outcome.alias("outcome"), F.when(F.col("kind") == 1, F.col("value")).alias("value"))


def overlay(base: DataFrame, staged: DataFrame) -> DataFrame:
    """JOI-04, SRC-10: live contents where staged(key, kind, value) stands before base(key,
    value). Presence decides, not the value, since an empty value is present."""
    s = staged.select("key", F.col("kind").alias("s_kind"), F.col("value").alias("s_value"))
    joined = base.join(s, "key", "full_outer")
    value = F.when(F.col("s_kind").isNotNull(), F.col("s_value")).otherwise(F.col("value"))
    return joined.where("s_kind is null or s_kind = 1").select("key", value.alias("value"), F.col("s_kind").isNotNull().alias("staged"))


def compact(versions: DataFrame, bottom_most: bool) -> DataFrame:
    """AGG-02: one row per key; its tombstone goes only where nothing older can lie below."""
    rows = latest(versions)
    return rows.where("kind = 1") if bottom_most else rows


def compaction_counters(versions: DataFrame, bottom_most: bool) -> DataFrame:
    """The counters of that merge, in one pass over the keys."""
    keys = versions.groupBy("key").agg(F.count("*").alias("n"), F.max_by("kind", "seq").alias("kind"))
    stones = F.count_if(F.col("kind") == 0)
    dropped = stones if bottom_most else F.lit(0).cast("long")
    kept = F.lit(0).cast("long") if bottom_most else stones
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_entries"),
        (F.count("*") - dropped).alias("output_entries"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("versions_dropped"),
        dropped.alias("tombstones_dropped"),
        kept.alias("tombstones_kept"),
        F.count("*").alias("distinct_keys"),
    )


def file_catalog(versions: DataFrame) -> DataFrame:
    """SRC-05, SNK-01: metadata of each file of versions(file, key, seq, ...)."""
    return versions.groupBy("file").agg(
        F.count("*").alias("entries"),
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.min("seq").alias("smallest_seq"),
        F.max("seq").alias("largest_seq"),
    )


def bottom_most(catalog: DataFrame, inputs: Column) -> DataFrame:
    """AGG-03: whether the files that ``inputs`` picks hold the oldest live version."""
    return catalog.agg((F.min(F.when(inputs, F.col("smallest_seq"))) == F.min("smallest_seq")).alias("bottom_most"))


def level_summary(files: DataFrame) -> DataFrame:
    """AGG-04 of files(level, file, size)."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def compaction_pick(files: DataFrame, trigger: int, base_bytes: int) -> DataFrame:
    """SRT-05: level 0 with ``trigger`` files or more, else the first level with two files or more
    and over its budget base_bytes * 10^(level-1); null if none is due."""
    s = level_summary(files)
    due = F.when(F.col("level") == 0, F.col("files") >= trigger).otherwise((F.col("files") >= 2) & (F.col("bytes") > F.lit(base_bytes) * F.pow(F.lit(10.0), F.col("level") - 1)))
    return s.agg(F.min(F.when(due, F.col("level"))).alias("level"))


def incoherent(catalog: DataFrame) -> DataFrame:
    """WIN-04: files whose range is empty or inverted, or overlaps the next newer file's."""
    newer = F.lag("smallest_seq").over(Window.orderBy(F.desc("largest_seq"), "file"))
    fault = (
        F.when(F.col("entries") == 0, "empty")
        .when(F.col("smallest_seq") > F.col("largest_seq"), "inverted")
        .when(F.col("largest_seq") >= newer, "overlap")
    )
    return catalog.withColumn("fault", fault).where("fault is not null").select("file", "fault")


def misordered(rows: DataFrame) -> DataFrame:
    """WIN-05: per file of rows(file, pos, key, seq), places that do not come after the one
    before them: key up, then seq down."""
    w = Window.partitionBy("file").orderBy("pos")
    key, seq = F.lag("key").over(w), F.lag("seq").over(w)
    bad = (key > F.col("key")) | ((key == F.col("key")) & (seq <= F.col("seq")))
    return rows.withColumn("bad", bad).where("bad").select("file", "pos")


def blocks(versions: DataFrame, size: Column, target: int) -> DataFrame:
    """SNK-01: files cut into blocks of about ``target`` bytes in key order: (file, block,
    entries, bytes, last_key), the sparse index. A block ends with the entry that fills it."""
    w = Window.partitionBy("file").orderBy("key", F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    sized = versions.withColumn("bytes", size)
    cut = F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / target).cast("long")
    return sized.withColumn("block", cut).groupBy("file", "block").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.max("key").alias("last_key"))


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """PRJ-01: key bytes, seq in seven bytes, kind in one."""
    return F.concat(key, F.unhex(F.lpad(F.hex(seq), 14, "0")), F.unhex(F.lpad(F.hex(kind), 2, "0")))


def decode_internal_key(raw: Column) -> tuple[Column, Column, Column]:
    n = F.octet_length(raw)
    seq = F.conv(F.hex(F.substring(raw, n - 7, F.lit(7))), 16, 10).cast("long")
    kind = F.conv(F.hex(F.substring(raw, n, F.lit(1))), 16, 10).cast("int")
    return F.substring(raw, F.lit(1), n - 8), seq, kind


def well_formed(raw: Column) -> Column:
    """FLT-13: a key byte, seven of seq and a known kind at least."""
    return (F.octet_length(raw) >= 9) & (F.hex(F.substring(raw, F.octet_length(raw), F.lit(1))).isin("00", "01"))


def entry_fault(key: Column, value: Column) -> Column:
    """FLT-10: why a key or value is refused, or ok. Limits 4 KiB and 1 MiB."""
    return (
        F.when(key.isNull() | (F.octet_length(key) == 0), "empty key")
        .when(F.octet_length(key) > 4096, "key too large")
        .when(F.octet_length(value) > 1 << 20, "value too large")
        .otherwise("ok")
    )


def manifest_live(edits: DataFrame) -> DataFrame:
    """AGG-15: files live after edits(edit, file, added): the last event of a file decides,
    and within an edit deletes come before adds."""
    last = F.max_by("added", F.struct("edit", "added")).alias("live")
    return edits.groupBy("file").agg(last, F.max("edit").alias("edit")).where("live").select("file", "edit")


def manifest_faults(edits: DataFrame) -> DataFrame:
    """Adds of files that are live, deletes of files that are not."""
    w = Window.partitionBy("file").orderBy("edit", "added")
    before = F.coalesce(F.lag("added").over(w), F.lit(False))
    return edits.withColumn("before", before).where("before = added").select("edit", "file", F.when(F.col("added"), "add of live").otherwise("delete of dead").alias("fault"))


def manifest_scalars(edits: DataFrame, *names: str) -> DataFrame:
    """The last given value of each optional scalar."""
    return edits.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("edit"))).alias(n) for n in names])


def replay(ops: DataFrame, flushed: int) -> DataFrame:
    """FLT-07, FLT-08: how many operations a replay skips since files hold them, and the rest."""
    done = F.col("seq") <= flushed
    return ops.agg(F.count_if(done).alias("skipped"), F.count_if(~done).alias("replayed"))


def bounded_prefix(entries: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """SRT-06: of each group the longest prefix within ``most`` bytes, and its first entry always."""
    w = Window.partitionBy(group).orderBy(order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("running", running).withColumn("n", F.row_number().over(w)).where((F.col("running") <= most) | (F.col("n") == 1)).drop("n")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """JOI-14: keys whose presence or value differs."""
    a = left.select("key", F.col("value").alias("l"), F.lit(True).alias("in_l"))
    b = right.select("key", F.col("value").alias("r"), F.lit(True).alias("in_r"))
    same = F.col("l").eqNullSafe(F.col("r")) & F.col("in_l").eqNullSafe(F.col("in_r"))
    return a.join(b, "key", "full_outer").where(~same).select("key", F.when(F.col("in_l").isNull(), "right only").when(F.col("in_r").isNull(), "left only").otherwise("value").alias("difference"))


def chunks(rows: DataFrame, body: str, size: int) -> DataFrame:
    """SRC-13: each body cut into chunks of ``size`` bytes: adds offset and chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(body) - 1, F.lit(0)), F.lit(size))
    return rows.withColumn("offset", F.explode(starts)).withColumn("chunk", F.substring(F.col(body), F.col("offset") + 1, F.lit(size))).drop(body)


def reassembled(pieces: DataFrame, key: str) -> DataFrame:
    """The bodies again, with whether their chunks were contiguous from zero."""
    sorted_ = F.array_sort(F.collect_list(F.struct("offset", "chunk")))
    ends = F.aggregate(F.col("parts"), F.lit(0), lambda at, p: F.when(at == p["offset"], at + F.octet_length(p["chunk"])).otherwise(F.lit(-1)))
    body = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["chunk"])), ""))
    return pieces.groupBy(key).agg(sorted_.alias("parts")).select(key, body.alias("body"), (ends >= 0).alias("contiguous"))
