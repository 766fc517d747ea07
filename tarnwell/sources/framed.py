"""Framed records: crc32c, length, kind, payload, little-endian; and logs made of them.

A log file is read as a whole by one task (segments are bounded by rotation); files are
read in parallel. Damage is told apart: a record that the file's end cuts short is a torn
tail, anything else is corrupt, and nothing after either counts.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER, LARGEST = 9, 64 << 20
_POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli, reflected


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1))
    return t


def crc32c(bodies: list[bytes]) -> np.ndarray:
    """FUN-04: CRC-32C of each body, byte by byte over all bodies at once."""
    table = _table()
    size = np.array([len(b) for b in bodies], np.int64)
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    out = np.full(len(bodies), 0xFFFFFFFF, np.uint32)
    live = len(bodies)
    for i in range(int(size.max()) if len(size) else 0):
        while live and size[order[live - 1]] <= i:
            live -= 1
        at = order[:live]
        out[at] = table[(out[at] ^ raw[start[at] + i]) & np.uint32(0xFF)] ^ (out[at] >> np.uint32(8))
    return out ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(T.LongType())
def crc32c_of(body: pd.Series) -> pd.Series:
    return pd.Series(crc32c([bytes(b) if b is not None else b"" for b in body]).astype(np.int64), index=body.index)


@F.pandas_udf(T.BinaryType())
def framed(kind: pd.Series, payload: pd.Series) -> pd.Series:
    """SNK-03: the record of each payload."""
    rest = [struct.pack("<IB", len(p), k) + bytes(p) for k, p in zip(kind, payload, strict=True)]
    return pd.Series([struct.pack("<I", c) + r for c, r in zip(crc32c(rest).tolist(), rest, strict=True)], index=kind.index)


def joined(parts: Column) -> Column:
    """The binaries of an array one after the other, in one step for all of them."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def segments(records: DataFrame, at: str, record: str, most: int) -> DataFrame:
    """SNK-02: segment and content: records in order of their position ``at``, a new segment
    after each ``most`` positions, so that one row is bounded however long the log is."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(record).alias("record"))))
    files = records.groupBy(F.expr(f"{at} div {most}").alias("segment")).agg(rows.alias("rows"))
    return files.select("segment", joined(F.transform("rows", lambda x: x["record"])).alias("content"))


def kept_segments(files: DataFrame, least: int, most: int) -> DataFrame:
    """SNK-02: what truncation below position ``least`` leaves: whole segments that hold none at or
    above it go, the others stay as they are."""
    return files.where(F.expr(f"(segment + 1) * {most} > {least}"))


def _frames(body: bytes) -> tuple[list[tuple[int, int, int, int]], str, int]:
    """(offset, end, checksum, kind) of what looks like records, and how and where that ends."""
    out, at = [], 0
    while len(body) - at >= HEADER:
        crc, n, kind = struct.unpack_from("<IIB", body, at)
        if not any(body[at : at + HEADER]):
            return out, "corrupt" if any(body[at:]) else "torn", at
        if n > LARGEST:
            return out, "corrupt", at
        end = at + HEADER + n
        if end > len(body):
            return out, "torn", at
        out.append((at, end, crc, kind))
        at = end
    return out, "clean", at


def records(bodies: list[bytes]) -> list[tuple[list[tuple[int, int, bytes]], str, int]]:
    """SRC-07: for each file (offset, kind, payload) of its sound records, how it ends (clean,
    torn or corrupt), and the offset up to which it is sound. Checksums of all are taken at
    once."""
    walked = [_frames(b) for b in bodies]
    sums = iter(crc32c([b[at + 4 : end] for b, (frames, _, _) in zip(bodies, walked, strict=True) for at, end, _, _ in frames]).tolist())
    out = []
    for body, (frames, state, sound) in zip(bodies, walked, strict=True):
        got = []
        for (at, end, crc, kind), own in zip(frames, [next(sums) for _ in frames], strict=True):
            if own != crc:
                state, sound = "torn" if end == len(body) else "corrupt", at
                break
            got.append((at, kind, body[at + HEADER : end]))
        out.append((got, state, sound))
    return out


def read_records(files: DataFrame) -> DataFrame:
    """Records of files(path, content), as binaryFile gives them: (path, offset, kind, payload),
    and a row of kind -1 per file with its end in ``state`` and where it is sound up to."""
    shape = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("state", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            paths = b.column("path").to_pylist()
            for path, (got, state, sound) in zip(paths, records([c or b"" for c in b.column("content").to_pylist()]), strict=True):
                rows += [(path, at, kind, payload, None) for at, kind, payload in got] + [(path, sound, -1, None, state)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return files.select("path", "content").mapInArrow(run, "path string, offset long, kind int, payload binary, state string")


def replayable(read: DataFrame) -> DataFrame:
    """SRC-06: the faults that stop a replay. A torn tail of the newest segment is cut; any other
    damage, or a torn tail of an older one, is an error."""
    ends = read.where("kind = -1").select("path", "state", "offset")
    newest = ends.agg(F.max("path").alias("newest"))
    j = ends.join(F.broadcast(newest), F.lit(True))  # one row
    verdict = F.when(F.col("state") == "clean", "ok").when((F.col("state") == "torn") & (F.col("path") == F.col("newest")), "truncate").otherwise("error")
    return j.select("path", "offset", verdict.alias("verdict"))


@F.pandas_udf(T.BinaryType())
def uvarint(n: pd.Series) -> pd.Series:
    """Numbers in base 128, least group first."""

    def one(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return pd.Series([None if pd.isna(x) else one(int(x)) for x in n], index=n.index)


def command(op: Column, key: Column, value: Column, client: Column, request: Column, acked: Column) -> Column:
    """PRJ-02, SRC-19: a command's canonical bytes."""
    code = F.when(op == "register", "03").when((client != 0) & (op == "put"), "04").when(client != 0, "05").when(op == "put", "01").otherwise("02")
    none = F.lit(b"").cast("binary")
    who = F.when((client != 0) & (op != "register"), F.concat(uvarint(client), uvarint(request), uvarint(acked))).otherwise(none)
    what = F.when(op != "register", F.concat(uvarint(F.octet_length(key).cast("long")), key)).otherwise(none)
    body = F.when(op == "put", F.concat(uvarint(F.octet_length(value).cast("long")), value)).otherwise(none)
    return F.concat(F.unhex(code), who, what, body)


def decode_command(raw: bytes) -> dict | None:
    """A command's fields, None where the bytes are not exactly what one encodes to."""
    at = 1

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                if b == 0 and shift:
                    raise ValueError
                return x
            shift += 7
            if shift > 63:
                raise ValueError

    def body() -> bytes:
        nonlocal at
        n = number()
        if n > len(raw) - at:
            raise ValueError
        at += n
        return raw[at - n : at]

    try:
        op = raw[0]
        out = {"op": {1: "put", 2: "delete", 3: "register", 4: "put", 5: "delete"}[op], "client_id": 0, "request_id": 0, "acked_below": 0, "key": None, "value": None}
        if op in (4, 5):
            out |= {"client_id": number(), "request_id": number(), "acked_below": number()}
        if op != 3:
            out["key"] = body()
        if op in (1, 4):
            out["value"] = body()
    except (ValueError, IndexError, KeyError):
        return None
    return out if at == len(raw) else None
