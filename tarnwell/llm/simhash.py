"""SimHash near-duplicates: fingerprints within a few bits of each other.

Segment-popcount embedding: a fingerprint's 64 bits are cut into 32 segments of two, and
the counts of set bits per segment are its place on a grid. Changing one bit moves a
place by one step along one axis, so the Manhattan distance of two places bounds the
Hamming distance from below. The grid is searched by range joins over blocks of axes:
within ``near`` steps in all, one of ``near // 2 + 1`` blocks is at most one step apart,
so a cell has to meet itself and the next cells along each axis only. Of what meets, the
distance over all 32 axes is tested next, and the fingerprints themselves last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import bounded_batches, components, local_forest, slices, written

AXES = 32
#: Rows of a cell that meet in one task; larger cells are cut into tiles that meet pairwise.
TILE = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)
_ODD = np.uint64(0x5555555555555555)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit 0, ..., 63 set."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 255 * 256):
        part = hashes[lo : lo + 255 * 256]
        rows = -(-len(part) // 255)
        block = np.zeros(rows * 255, np.uint64)
        block[: len(part)] = part
        block = block.reshape(rows, 255)
        for k in range(8):
            lanes = ((block >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
            out[k::8] += lanes.view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest as digest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65_280):
        part = words[lo : min(lo + 65_280, n) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        ends = ends.tolist()
        m = min(65_280, n - lo)
        stops = ends[width - 1 :] if len(part) >= width else ends[-1:]
        h = [digest(joined[a:b], seed) for a, b in zip(starts[:m], stops, strict=False)]
        counts += bit_counts(np.array(h, np.uint64))
    bits = 2 * counts > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def thermometer(fp: np.ndarray) -> np.ndarray:
    """Each two-bit segment's count of set bits in unary (00, 01, 11): the Manhattan distance
    of two places is the number of bits in which these differ."""
    low, high = fp & _ODD, (fp >> np.uint64(1)) & _ODD
    return (low | high) | ((low & high) << np.uint64(1))


def places(fp: np.ndarray) -> np.ndarray:
    """Counts of set bits per segment: shape (len(fp), AXES), values 0 to 2."""
    pairs = np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(pairs, axis=1, bitorder="little").reshape(-1, AXES, 2)
    return bits.sum(axis=2, dtype=np.int64)


def blocks(near: int) -> list[np.ndarray]:
    return np.array_split(np.arange(AXES), near // 2 + 1)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null and empty texts: 0."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            got = [fingerprint(t or b"", width, seed) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def links(classes: DataFrame, near: int = 4) -> DataFrame:
    """Edges u, v (ids) that join the classes(id, fp) of distinct fingerprints within
    ``near`` bits as all such pairs would: a forest per batch of cells, not the pairs."""
    cut = blocks(near)
    shape = pa.schema([("cell", pa.int64()), ("probe", pa.bool_()), ("id", pa.int64()), ("fp", pa.int64())])

    def to_cells(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                ids = b.column("id").slice(lo, 4096).to_numpy(zero_copy_only=False)
                fp = b.column("fp").slice(lo, 4096).to_numpy(zero_copy_only=False)
                at = places(fp.view(np.uint64))
                cells, probes, row = [], [], []
                for k, axes in enumerate(cut):
                    step = 3 ** np.arange(len(axes), dtype=np.int64)
                    home = (at[:, axes] * step).sum(axis=1)
                    cells.append(home * len(cut) + k)
                    probes.append(np.zeros(len(home), bool))
                    row.append(np.arange(len(home)))
                    r, a = np.nonzero(at[:, axes] < 2)
                    cells.append((home[r] + step[a]) * len(cut) + k)
                    probes.append(np.ones(len(r), bool))
                    row.append(r)
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(probes)), pa.array(ids[row]), pa.array(fp[row])], schema=shape)

    def meet(batches):
        held, u, v = [], [], []

        def settle(cell, probe, ids, fp):
            """Edges within the cells of these rows, sorted by cell and homes first."""
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            of = np.cumsum(np.r_[False, cell[1:] != cell[:-1]])
            homes = np.add.reduceat((~probe).astype(np.int64), first)
            begin = np.where(probe, first[of], np.arange(len(cell)) + 1)  # a home meets the homes after it
            many = first[of] + homes[of] - begin
            place = thermometer(fp)
            lo = 0
            total = np.cumsum(many)
            while lo < len(cell):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000, "right")))
                n = many[lo:hi]
                a = np.repeat(np.arange(lo, hi), n)
                c = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[lo:hi], n)
                ok = np.flatnonzero(np.bitwise_count(place[a] ^ place[c]) <= near)
                a, c = a[ok], c[ok]
                ok = np.bitwise_count(fp[a] ^ fp[c]) <= near
                if ok.any():
                    x, y = local_forest(ids[a[ok]], ids[c[ok]])
                    u.append(x)
                    v.append(y)
                lo = hi

        def columns(b):
            return [b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "probe", "id", "fp")]

        def done(parts, final):
            cell, i, j, probe, ids, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            unit = np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            n = len(cell) if final else int(np.flatnonzero(unit)[-1])
            if n:
                settle(np.cumsum(unit)[:n], probe[:n], ids[:n], fp[:n].view(np.uint64))
            return [[x[n:] for x in (cell, i, j, probe, ids, fp)]]

        def edges():
            x, y = local_forest(np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64),) * 2
            u.clear()
            v.clear()
            for lo in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000], pa.int64()), pa.array(y[lo : lo + 100_000], pa.int64())], ["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(columns(b))
            if sum(len(h[0]) for h in held) >= 50_000:
                held = done(held, False)
            if sum(map(len, u)) > 500_000:
                yield from edges()
        if held:
            done(held, True)
        yield from edges()

    bounded_batches(classes.sparkSession)
    rows = classes.where("id is not null").select("id", "fp").mapInArrow(to_cells, "cell long, probe boolean, id long, fp long")
    # cells too large for one task are cut into k tiles of homes and k of what meets them
    large = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("k"))
    tile = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    single = F.col("k") == 1
    tiled = (
        rows.join(large, "cell", "left")
        .withColumn("k", F.coalesce("k", F.lit(1)))
        # in a tiled cell a home stands as home in the row of tiles that is its own, and as probe in every column
        .withColumn("as", F.when(single, F.array(F.struct("probe", F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
            F.concat(
                F.when(~F.col("probe"), F.transform(every, lambda j: F.struct(F.lit(False).alias("probe"), tile.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<probe:boolean,i:int,j:int>>")),
                F.transform(every, lambda i: F.struct(F.lit(True).alias("probe"), i.alias("i"), tile.alias("j"))),
            )))
        .select("cell", F.explode("as").alias("a"), "id", "fp")
        .select("cell", "a.i", "a.j", "a.probe", "id", "fp")
    )
    return tiled.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "probe", "id").mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, near: int = 4, width: int = 4, seed: int = 42, text: str = "text", least: float | None = None) -> DataFrame:
    """With ``least``: doc_id, component_id by similarity of shingles, see ``similar.near_copies``
    (``near`` and ``seed`` are not used). Else doc_id, fp, component_id for every row of docs: component_id is the smallest doc_id
    that links (fingerprints within ``near`` bits) reach from it, itself included.

    Rows of one fingerprint are a class; only classes are searched, and joined back at
    the end. Texts without words, null or empty, have fingerprint zero and link like any
    other. Repeated rows share a component; a row without doc_id gets its class's. An
    empty table gives no rows. No limit on the size of a class, a cell or a component.
    """
    if least is not None:
        from tarnwell.llm.similar import near_copies

        return near_copies(docs, least, width, text)
    prints = written(fingerprints(docs, width, seed, text))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    roots = components(links(classes, near)).select(F.col("node").alias("id"), "root")
    of_class = classes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")
