"""What the operators on embeddings share: rows as packed blobs, tiles that meet."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat float64 values, offsets by row, and which rows are whole: not null, not empty,
    no null or non-finite component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    lo = offsets[0]
    values = column.values.slice(lo, offsets[-1] - lo)
    nulls = np.asarray(values.is_null())
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    offsets = offsets - lo
    bad = np.r_[0, np.cumsum(~np.isfinite(flat) | nulls)]
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & (offsets[1:] > offsets[:-1]) & ~np.asarray(column.is_null())
    return flat, offsets, whole


def packed(rows: DataFrame, vector: str, change=None, keep_zero: bool = True) -> DataFrame:
    """vec_id, dim, tid, body of each row: the whole vector as float64 after ``change``, and a
    digest of it. dim is 0, and body null, for rows that are not whole (with keep_zero False
    also for vectors of zeros)."""

    def run(batches):
        for b in batches:
            flat, at, whole = as_matrix(b.column("v"))
            flat = (change(flat) if change else flat) + 0.0  # no negative zero
            dims, tids, bodies = [], [], []
            for i, ok in enumerate(whole.tolist()):
                v = flat[at[i] : at[i + 1]]
                if ok and (keep_zero or v.any()):
                    raw = v.tobytes()
                    dims.append(len(v))
                    tids.append(hashlib.blake2b(raw, digest_size=16).digest())
                    bodies.append(raw)
                else:
                    dims.append(0)
                    tids.append(None)
                    bodies.append(None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(tids, pa.binary()), pa.array(bodies, pa.binary())], ["vec_id", "dim", "tid", "body"])

    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, dim int, tid binary, body binary")


def units(batches, key: int):
    """Rows (as tuples) of sorted batches, gathered while their first ``key`` columns stay."""
    held, now = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:key] != now:
                if held:
                    yield held
                held, now = [], row[:key]
            held.append(row)
    if held:
        yield held


def halves(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows of x in which neighbours are near: halved at the median of the
    column that spreads most, again and again, down to ``leaf`` rows."""
    order, todo, out = np.arange(len(x)), [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        col = x[part][:, np.argmax(x[part].std(axis=0))]
        half = (len(part) // 2 + leaf - 1) // leaf * leaf  # whole leaves on the left
        by = np.argpartition(col, min(half, len(part) - 1))
        todo += [part[by[half:]], part[by[:half]]]
    return order[np.concatenate(out)] if out else order
