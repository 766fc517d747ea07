"""Removing passages that occur more than once, byte by byte.

Every string of ``least`` bytes is filed under the smallest hash of the short grams in
it, so equal strings are filed alike wherever they stand. Strings under a key that came
once occur once. The others' texts are gathered by key into blocks, and each block gets
a Burrows-Wheeler transform, on which intervals are expanded backwards, breadth first:
common prefixes come by increasing length, and the expansion stops at ``least``. Rows
of the transform that no border shorter than that parts are repeated strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import bounded_batches, settled, slices, written

GRAM = 96
#: Bytes of text in a block; keys with more are dealt over several.
BLOCK = 1 << 20
#: Strings that one row of a key may hold.
LONGEST_RUN = 1 << 17
_NO_ID = -(2**63)
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _MULT[k % 4]


def gram_hashes(a: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes that start at each place (the last places,
    where fewer follow, hold anything)."""
    power = (a.astype(np.uint64) + np.uint64(1 + seed)) * _MULT[seed % 4]
    out, have, k, left = None, 0, 1, width
    while left:
        if left & 1:
            moved = power if not have else np.concatenate([power[have:], np.zeros(min(have, len(power)), np.uint64)])
            out = moved if out is None else _mixed(out, 1) + moved
            have += k
        left >>= 1
        if left:
            power = _mixed(power, 2) + np.concatenate([power[k:], np.zeros(min(k, len(power)), np.uint64)])
            k *= 2
    return _mixed(_mixed(out, 3), 0)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i where as many are there."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(a: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of ``least`` bytes in a, as runs of starts under one key: key, first
    start, number of starts, and whether the key's gram stands there more than once."""
    n = len(a) - least + 1
    h = gram_hashes(a, gram)[: len(a) - gram + 1]
    # the place in the lower bits: of equal grams in a string, the leftmost is its own
    at = sliding_min((h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64), least - gram + 1) & np.uint64((1 << 24) - 1)
    at = at[:n].astype(np.int64)
    key = h[at]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    moved = np.cumsum(np.r_[False, at[1:] != at[:-1]])
    end = np.r_[first[1:], n]
    return key[first].view(np.int64), first, end - first, moved[end - 1] > moved[first]


def transform(text: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Starts of all suffixes of text in order of their first ``least`` symbols at least.
    text: bytes + 1, and 0 at the end of each segment; an end sorts before all bytes and,
    among ends, by place. left: symbols before the next end."""
    n = len(text)
    s = text.astype(np.uint64)

    def ahead(x, k):
        return np.concatenate([x[k:], np.zeros(min(k, n), np.uint64)])

    two = (s << np.uint64(9)) | ahead(s, 1)
    four = (two << np.uint64(18)) | ahead(two, 2)
    key = (four << np.uint64(27)) | (ahead(four, 4) >> np.uint64(9))
    short = np.flatnonzero(left < 7)
    key[short] &= ~((np.uint64(1) << (np.uint64(9) * (7 - left[short]).astype(np.uint64))) - np.uint64(1))
    order = np.argsort(key)
    ended = left[order] < 7
    own = order[ended]
    order[ended] = own[np.lexsort((own, key[own]))]
    sorted_key = key[order]
    start = np.r_[True, sorted_key[1:] != sorted_key[:-1]] | ended
    rank = np.empty(n, np.int64)
    h = 7
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank[order] = first
    while h < least:
        tied = ~start
        tied[:-1] |= ~start[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        p = order[slots]
        pair = (rank[p] << 32) | rank[np.minimum(p + h, n - 1)]
        by = np.argsort(pair)
        p, pair = p[by], pair[by]
        order[slots] = p
        start[slots] = np.r_[True, pair[1:] != pair[:-1]]
        first = slots[np.maximum.accumulate(np.where(start[slots], np.arange(len(slots)), 0))]
        rank[p] = first
        h *= 2
    return order


def repeated(text: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of the strings of ``least`` bytes that occur more than once in text
    (bytes + 1, and 0 at ``ends``); strings of one class are equal."""
    n, k = len(text), len(ends)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    order = transform(text, left, least)
    last = text[np.maximum(order - 1, 0)].copy()
    last[order == 0] = 0
    rows = np.argsort(last, kind="stable")  # row rows[t] steps back to row t
    chars = last[rows]
    border = np.zeros(n, bool)  # borders found so far: rows whose common prefix with the row above is known
    known = np.r_[True, chars[1:] != chars[:-1]] | (np.arange(n) < k)
    border[known] = True
    back = np.full(n, -1, np.int64)  # of a row in a run of one symbol, the row it steps back to
    t = np.flatnonzero(~known)
    i, q = rows[t], rows[t - 1]
    plain = q == i - 1
    back[i[plain]] = t[plain]
    t, i, q = t[~plain], i[~plain], q[~plain]
    new = np.flatnonzero(known)
    for _ in range(1, least):
        if not len(new):
            break
        step = back[new]
        step = step[step >= 0]
        if len(t):
            if len(t) < n >> 4:
                at = np.searchsorted(new, q, "right")
                hit = new[np.minimum(at, len(new) - 1)] <= i
                hit &= at < len(new)
            else:
                flags = np.zeros(n + 1, np.int32)
                flags[new + 1] = 1
                count = np.cumsum(flags, dtype=np.int32)
                hit = count[i + 1] > count[q + 1]
            step = np.concatenate([step, t[hit]])
            t, i, q = t[~hit], i[~hit], q[~hit]
        new = np.sort(step)
        border[new] = True
    of = np.cumsum(border) - 1
    many = np.bincount(of)[of] > 1
    return order[many], of[many]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edge[::2], edge[1::2]


_FOUND = "tid binary, start long, stop long, h long, bucket int, blob binary"
_FOUND_SCHEMA = pa.schema([("tid", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("h", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
#: A string of a key that is dealt over parts: two hashes, whose it is, where, and whether it is single so far.
_STRING = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("tid", "V16"), ("at", "<i8"), ("single", "?")])


def _block(rows: list[tuple], least: int):
    """rows: (key, part, parts, tid, lo, n, multi, bytes) of whole units (key, part). Gives
    columns of found rows: repeated starts of a text as ranges [start, stop); for keys dealt
    over several parts also the different strings that this part holds, a blob for each of as
    many buckets by hash, so that parts can be held together."""
    seen, distinct = set(), {}
    for key, part, parts, tid, lo, n, multi, body in rows:
        if (tid, lo) not in seen:
            seen.add((tid, lo))
            distinct.setdefault((key, part, parts, body), []).append((tid, lo, n, multi))
    per_unit: dict[tuple, int] = {}
    for key, part, _, _ in distinct:
        per_unit[key, part] = per_unit.get((key, part), 0) + 1
    out: list[tuple] = []
    work = []
    for (key, part, parts, body), who in distinct.items():
        if per_unit[key, part] == 1 and parts == 1 and not who[0][3]:
            if len(who) > 1:  # one string of bytes, several times
                out += [(tid, lo, lo + n, None, None, None) for tid, lo, n, _ in who]
        else:
            work.append((key, parts, body, who))
    if not work:
        return out
    text = np.frombuffer(b"\0".join(w[2] for w in work) + b"\0", np.uint8).astype(np.uint16) + 1
    lengths = np.array([len(w[2]) for w in work])
    ends = np.cumsum(lengths + 1) - 1
    text[ends] = 0
    at, of = repeated(text, ends, least)
    flags, tell = np.zeros(len(text), bool), np.ones(len(text), bool)
    flags[at] = True
    tell[at] = False
    tell[at[np.unique(of, return_index=True)[1]]] = True  # of equal strings, one
    if any(w[1] > 1 for w in work):
        raw = (text - (text > 0)).astype(np.uint8)
        h1, h2 = gram_hashes(raw, least, 1), gram_hashes(raw, least, 2)
    strings: dict[tuple, list] = {}
    for (key, parts, _, who), b, length in zip(work, (ends - lengths).tolist(), lengths.tolist(), strict=True):
        n = length - least + 1
        mine = flags[b : b + n] if len(who) == 1 else np.ones(n, bool)
        first, last = (e.tolist() for e in _ranges(mine))
        for tid, lo, _, _ in who:
            out += [(tid, lo + x, lo + y, None, None, None) for x, y in zip(first, last, strict=True)]
        if parts > 1:
            x = np.flatnonzero(tell[b : b + n])
            told = np.empty(len(x), _STRING)
            told["h1"], told["h2"] = h1[b + x], h2[b + x]
            told["tid"], told["at"], told["single"] = np.void(who[0][0]), who[0][1] + x, ~mine[x]
            strings.setdefault((key, parts), []).append(told)
    for (key, parts), told in strings.items():
        told = np.concatenate(told)
        bucket = (told["h1"] >> np.uint64(20)) % np.uint64(parts)
        for k in range(parts):
            blob = told[bucket == k]
            if len(blob):
                out.append((None, None, None, key, k, blob.tobytes()))
    return out


def _held_together(blobs: list[bytes]) -> list[tuple]:
    """Ranges (tid, start, stop) of the single strings that another part holds too."""
    all_ = np.frombuffer(b"".join(blobs), _STRING)
    order = np.lexsort((all_["h2"], all_["h1"]))
    s = all_[order]
    differs = np.r_[True, (s["h1"][1:] != s["h1"][:-1]) | (s["h2"][1:] != s["h2"][:-1])]
    of = np.cumsum(differs) - 1
    s = s[(np.bincount(of)[of] > 1) & s["single"]]
    places: dict[bytes, list[int]] = {}
    for tid, at in zip(s["tid"].tolist(), s["at"].tolist(), strict=True):
        places.setdefault(tid, []).append(at)
    out = []
    for tid, at in places.items():
        at = np.unique(at)
        cut = np.flatnonzero(np.diff(at) > 1)
        out += [(tid, int(x), int(y) + 1) for x, y in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True)]
    return out


def _tid(text: str):
    """The text as it counts, its SHA-256, and what tells texts apart: 16 bytes of that."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(t.cast("binary"), 256))
    return t, sha, F.substring(sha, 1, 16)


def _named(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_bytes, sha, tid) of every row, written; (tid, copies, rep) of every text; and
    (tid, rep, text) of every row, of which that with its text's rep stands for the text."""
    bounded_batches(docs.sparkSession)
    t, sha, tid = _tid(text)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.cast("binary").alias("text"), sha.alias("sha"), tid.alias("tid"))
    base = base.withColumn("rep", F.coalesce("doc_id", F.lit(_NO_ID)))
    narrow = written(base.select("doc_id", "rep", F.octet_length("text").cast("long").alias("n_bytes"), "sha", "tid"))
    return narrow, narrow.groupBy("tid").agg(F.count("*").alias("copies"), F.min("rep").alias("rep")), base.select("tid", "rep", "text")


def _repeats(rows: DataFrame, classes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of rows(tid, rep, text) and classes(tid, rep): (tid, text) of the texts that may repeat
    something, and (tid, ranges) of the starts of their repeated strings."""
    gram = min(GRAM, least)
    long_texts = rows.where(F.octet_length("text") >= least)

    def to_runs(batches):
        shape = pa.schema([("h", pa.int64()), ("tid", pa.binary()), ("lo", pa.int64()), ("n", pa.int64()), ("multi", pa.bool_())])
        step = 1 << 22  # texts longer than this are read in overlapping pieces
        for b in slices(batches, "text", 1 << 20):
            keys, tids, los, ns, multis = [], [], [], [], []
            for tid, body in zip(b.column("tid").to_pylist(), b.column("text").to_pylist(), strict=True):
                for off in range(0, max(1, len(body) - least + 1), step):
                    a = np.frombuffer(body[off : off + step + least - 1], np.uint8)
                    key, lo, n, multi = runs(a, least, gram)
                    while (n > LONGEST_RUN).any():
                        over = n > LONGEST_RUN
                        key = np.concatenate([key, key[over]])
                        lo = np.concatenate([lo, lo[over] + LONGEST_RUN])
                        n = np.concatenate([np.minimum(n, LONGEST_RUN), n[over] - LONGEST_RUN])
                        multi = np.concatenate([multi, multi[over]])
                    keys.append(key)
                    tids += [tid] * len(key)
                    los.append(lo + off)
                    ns.append(n)
                    multis.append(multi)
            if tids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(tids, pa.binary()), pa.array(np.concatenate(los)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(multis))], schema=shape)

    filed = written(
        long_texts.select("tid", "text")
        .mapInArrow(to_runs, "h long, tid binary, lo long, n long, multi boolean")
        .groupBy("h", "tid", "lo")  # copies of a text become one
        .agg(F.max("n").alias("n"), F.max("multi").alias("multi"))
    )
    keys = (
        filed.groupBy("h")
        .agg(F.count("*").alias("rows"), F.sum(F.col("n") + (least - 1)).alias("bytes"), F.max("multi").alias("any_multi"))
        .where("rows > 1 or any_multi")
        .select("h", F.ceil(F.col("bytes") / BLOCK).cast("int").alias("parts"))
    )
    wanted = (
        filed.join(keys, "h")
        .withColumn("part", F.pmod(F.xxhash64("tid", "lo"), F.col("parts")).cast("int"))
        .groupBy("tid")
        .agg(F.collect_list(F.struct("h", "part", "parts", "lo", "n", "multi")).alias("runs"))
        .join(classes.select("tid", "rep"), "tid")
    )
    texts = written(long_texts.select("tid", "rep", "text").join(wanted, ["tid", "rep"]).select("tid", "text", "runs"))

    def to_segments(batches):
        shape = pa.schema([("h", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("tid", pa.binary()), ("lo", pa.int64()), ("n", pa.int64()), ("multi", pa.bool_()), ("body", pa.binary())])
        for b in slices(batches, "text", 1 << 20):
            out = [[] for _ in shape]
            size = 0
            for tid, body, many in zip(b.column("tid").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                for r in many:
                    part = body[r["lo"] : r["lo"] + r["n"] + least - 1]
                    for c, v in zip(out, (r["h"], r["part"], r["parts"], tid, r["lo"], r["n"], r["multi"], part), strict=True):
                        c.append(v)
                    size += len(part)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape, strict=True)], schema=shape)
                        out, size = [[] for _ in shape], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape, strict=True)], schema=shape)

    def to_found(batches):
        def out(rows):
            got = _block(rows, least)
            for lo in range(0, len(got), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got[lo : lo + 20_000], strict=True), _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)

        block, size, unit = [], 0, None  # whole units; rows of one unit follow each other
        pending: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "part", "parts", "tid", "lo", "n", "multi", "body")), strict=True):
                if row[:2] != unit:
                    block += pending
                    pending, unit = [], row[:2]
                    if size > BLOCK:
                        yield from out(block)
                        block, size = [], 0
                pending.append(row)
                size += len(row[7])
        block += pending
        if block:
            yield from out(block)

    found = written(
        texts.mapInArrow(to_segments, "h long, part int, parts int, tid binary, lo long, n long, multi boolean, body binary")
        .repartition("h", "part")
        .sortWithinPartitions("h", "part")
        .mapInArrow(to_found, _FOUND)
    )

    def to_across(batches):
        shape = pa.schema([("tid", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])

        def out(blobs):
            got = _held_together(blobs)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), shape, strict=True)], schema=shape)

        blobs, now = [], None
        for b in batches:
            for h, k, blob in zip(b.column("h").to_pylist(), b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if (h, k) != now and blobs:
                    yield from out(blobs)
                    blobs = []
                now = (h, k)
                blobs.append(blob)
        if blobs:
            yield from out(blobs)

    across = (
        found.where("h is not null")
        .select("h", "bucket", "blob")
        .repartition("h", "bucket")
        .sortWithinPartitions("h", "bucket")
        .mapInArrow(to_across, "tid binary, start long, stop long")
    )
    ranges = found.where("h is null").select("tid", "start", "stop").unionByName(across)
    ranges = ranges.groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return texts.select("tid", "text"), ranges


def _kept(texts: DataFrame, ranges: DataFrame, least: int, bodies: bool = True) -> DataFrame:
    """tid, n_removed, n_spans and (null without ``bodies``) kept of the texts with ranges."""

    def run(batches):
        shape = pa.schema([("tid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        for b in slices(batches, "text", 1 << 20):
            rows = []
            for tid, body, many in zip(b.column("tid").to_pylist(), b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                depth = np.zeros(len(body) + 1, np.int64)
                np.add.at(depth, [r["start"] for r in many], 1)
                np.add.at(depth, [r["stop"] + least - 1 for r in many], -1)
                gone = np.cumsum(depth)[:-1] > 0
                rows.append((tid, int(gone.sum()), len(_ranges(gone)[0]), np.frombuffer(body, np.uint8)[~gone].tobytes() if bodies else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    removed = texts.join(ranges, "tid").mapInArrow(run, "tid binary, n_removed long, n_spans long, kept binary")
    return removed.groupBy("tid").agg(F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"), F.first("kept").alias("kept"))


def _outcomes(docs: DataFrame, least: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, sha, tid) of every row, and (tid, copies, n_removed, n_spans, kept) of
    every text; the last three are null where nothing was removed."""
    narrow, classes, rows = _named(docs, text)
    removed = _kept(*_repeats(rows, classes, least), least)
    return narrow, classes.select("tid", "copies").join(removed, "tid", "left")


def remove_repeats(docs: DataFrame, least: int = 400, text: str = "text", passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; null where none were
    removed) and text_sha256 of the whole text, for every row of docs; with ``passage`` (less
    than ``least``) also n_passage, the bytes that a string of so many bytes covers that starts
    anywhere else too: what would go at that length. It is counted, not removed.

    A byte goes if a string of ``least`` bytes that covers it starts anywhere else too, in
    the same text or another, as the texts are given: of a repeated passage no copy stays,
    and of texts that come twice nothing does if they have ``least`` bytes. Null texts are
    empty. Repeated rows are copies of each other. An empty table gives no rows.

    Copies are told by a hash of the whole text and worked on once. Keys are counted after
    partial aggregation; a key with more text than a block is dealt over parts by text and
    place, and the parts exchange two hashes of each different string they hold. Each
    task holds one block, or one run of strings under one key. A string of ``least`` bytes
    repeats only where its first ``passage`` bytes do, so after a search at that length only
    texts that it found are searched again.
    """
    narrow, classes, rows = _named(docs, text)
    copied = F.col("copies") > 1
    outcome = classes.select("tid", "copies")
    if passage is None:
        outcome = outcome.join(_kept(*_repeats(rows, classes, least), least), "tid", "left")
    else:

        def shorter():
            texts, ranges = _repeats(rows, classes, passage)
            return texts.join(ranges, "tid").dropDuplicates(["tid"])

        some = settled(shorter)
        counts = _kept(some.select("tid", "text"), some.select("tid", "ranges"), passage, bodies=False).select("tid", F.col("n_removed").alias("n_passage"))
        again = some.select("tid", F.lit(0).cast("long").alias("rep"), "text")
        outcome = outcome.join(counts, "tid", "left").join(_kept(*_repeats(again, again.select("tid", "rep"), least), least), "tid", "left")
    all_gone = copied & (F.col("n_bytes") >= least)
    more = [] if passage is None else [F.when(copied & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_passage", F.lit(0))).cast("long").alias("n_passage")]
    return narrow.join(outcome, "tid").select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(b"").cast("binary")).otherwise(F.col("kept")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *more,
    )


def without_repeats(docs: DataFrame, least: int = 400, text: str = "text") -> DataFrame:
    """docs with ``text`` replaced by what ``remove_repeats`` keeps of it. A character of which
    a cut left some bytes goes as a whole; null texts stay null; every row stays, if need
    be with an empty text. Extra columns stay as they are, whatever their names."""
    t, _, tid = _tid(text)
    of_rows = "__tid", "__copies", "__kept"

    def changed():
        _, outcome = _outcomes(docs, least, text)
        cut = outcome.where(F.col("kept").isNotNull() | (F.col("copies") > 1))
        return cut.select(*[F.col(c).alias(n) for c, n in zip(("tid", "copies", "kept"), of_rows, strict=True)])

    gone = (F.col("__copies") > 1) & (F.octet_length(t) >= least)
    joined = docs.withColumn("__tid", tid).join(settled(changed), "__tid", "left")
    joined = joined.select(*docs.columns, F.when(gone, F.lit(b"").cast("binary")).otherwise(F.col("__kept")).alias("__kept"))

    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for b in slices(batches, text, 1 << 20):
            texts = [x if k is None else k.decode("utf-8", "ignore") for x, k in zip(b.column(at).to_pylist(), b.column("__kept").to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)
