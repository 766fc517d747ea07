"""SimHash near-duplicates by similarity: texts whose sets of word shingles have a Jaccard
similarity of at least a threshold (``simhash.near_duplicates`` with ``least``).

64-bit fingerprints can not tell such pairs: at 0.8 they differ in 10 bits on average and up to
19. So a fingerprint here has 64 * WORDS bits, each set if over half of a set's hashes set it.
Two sets whose similarity is the threshold differ in a bit with a chance of ``differing`` at
most, and in no more than ``radius`` bits but for a chance of 1 in 90 million at 0.8 (sets of 4
and 5 hashes; 2 in 100 billion from 20 hashes on); texts that have nothing in common differ in
half their bits, five deviations above it.

The search is a range join over the number of shingles: similar sets are of one band of sizes
or of two next to each other, and within these no more than 1 / threshold apart. What is in
range meets by tiles; of that the bits of the first half are compared, then the Manhattan
distance of the counts of set bits per two-bit segment, a lower bound of the bits that
differ, and then all bits. A meeting gives a forest, not pairs. So every pair in range is
compared, none by shared keys.

What fingerprints join is verified exactly on the sets: all members of a component of
fingerprints meet the least of them first; only those whose members then are of several
components have the rest of their pairs tested, by tiles, with SEGMENTS counts of hashes
by their top bits as place and its Manhattan distance as lower bound before the sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import bounded_batches, components, local_forest, slices, written
from tarnwell.llm.simhash import thermometer

#: Words of 64 bits of a fingerprint.
WORDS = 4
#: Fingerprints of a tile: so many, or a part of all in SHARE where that is more, up to a bound.
#: A row goes to each tile of its band and the next ones, so few tiles are few copies.
LEAST_ROWS, MOST_ROWS, SHARE = 4096, 1 << 18, 10
#: Pairs of fingerprints that are compared at once, or one row with all in its range.
CELLS = 1 << 18
#: Segments whose counts of set bits are a set's place.
SEGMENTS = 64
#: Shingles of a tile; two tiles are what a task holds.
TILE = 1 << 19
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULT = np.random.default_rng(7).integers(1, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a text of fewer words is one."""
    from xxhash import xxh64_intdigest as digest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops, strict=False)], np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of SimHash of a set of hashes: a bit is set if over half the hashes set it."""
    counts = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(found), 255):
        x = found[lo : lo + 255]
        x = (x ^ (x >> np.uint64(31)))[:, None] * _MULT
        bits = np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def differing(least: float) -> float:
    """The chance, at most, that a bit differs between sets of a similarity of ``least`` or more:
    the angle between them over pi, and a quarter more, as sets of few hashes have more (0.1875
    for 4 of 5 hashes, against 0.152)."""
    return 1.25 * math.acos(2 * least / (1 + least)) / math.pi


def radius(bits: int, least: float) -> int:
    """Bits of so many that sets of a similarity of ``least`` differ in at most: six deviations
    above the mean."""
    p = differing(least)
    return min(bits, math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p))))


def _is_near(common, a, b, least: float):
    """Whether sets of a and b members, ``common`` of them shared, are similar enough."""
    return common >= least * (a + b - common) - 1e-9


def _tid(text: bytes) -> bytes:
    """What tells texts of different words apart."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(text.translate(_LOWER).split()))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tid, number of shingles and words of the fingerprint for every row of docs(doc_id, text)."""
    words = [f"f{k}" for k in range(WORDS)]

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            tid, size, prints = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = shingles(t or b"", width)
                tid.append(_tid(t or b""))
                size.append(len(s))
                prints.append(fingerprint(s))
            columns = np.array(prints, np.uint64).view(np.int64).reshape(-1, WORDS).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tid, pa.binary()), pa.array(size, pa.int64()), *map(pa.array, columns)], ["doc_id", "tid", "size", *words])

    return docs.mapInArrow(run, "doc_id long, tid binary, size long, " + ", ".join(f"{c} long" for c in words))


def close(ids: np.ndarray, size: np.ndarray, prints: np.ndarray, other: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of rows whose sizes and fingerprints (WORDS columns) allow a
    similarity of ``least``; of rows where ``other`` is false with those where it is true only,
    if given."""
    order = np.argsort(size, kind="stable")
    ids, size, prints = ids[order], size[order], np.ascontiguousarray(prints[order].T)
    places = thermometer(prints)
    mine, theirs = (np.arange(len(ids)),) * 2 if other is None else (np.flatnonzero(~other[order]), np.flatnonzero(other[order]))
    half = WORDS // 2
    near, near_half = radius(64 * WORDS, least), radius(64 * half, least)
    root = np.arange(len(ids))
    sizes = size[theirs]
    begins = np.arange(len(ids)) if other is None else np.searchsorted(sizes, size[mine] * least - 1e-6)
    ends = np.searchsorted(sizes, size[mine] / least + 1e-6, "right")
    some = ends > begins
    mine, begins, ends = mine[some], begins[some], ends[some]
    right = prints[:, theirs]
    lo = 0
    while lo < len(mine):
        begin = begins[lo]
        # as many rows as CELLS allows with all that is in range of the last of them: both grow
        to = ends[lo : lo + max(1, CELLS // int(ends[lo] - begin))]
        hi = lo + max(1, int(np.searchsorted(np.arange(1, len(to) + 1) * (to - begin), CELLS, "right")))
        end = ends[hi - 1]
        apart = np.zeros((hi - lo, end - begin), np.uint8)
        for k in range(half):
            apart += np.bitwise_count(prints[k, mine[lo:hi], None] ^ right[None, k, begin:end])
        r, c = np.nonzero(apart <= near_half)
        r, c = mine[r + lo], theirs[c + begin]
        ok = (root[r] != root[c]) & (np.minimum(size[r], size[c]) >= np.maximum(size[r], size[c]) * least - 1e-6)
        r, c = r[ok], c[ok]
        for x in (places, prints):
            ok = np.bitwise_count(x[:, r] ^ x[:, c]).sum(axis=0, dtype=np.int64) <= near
            r, c = r[ok], c[ok]
        if len(r):
            node, to = local_forest(root[r], root[c])
            of = np.arange(len(ids))
            of[node] = to
            root = of[root]
        lo = hi
    far = ids != ids[root]
    return ids[far], ids[root[far]]


def _joined(own: DataFrame, least: float) -> DataFrame:
    """u, v: forests of the rows own(id, size, words of the fingerprint) that range and fingerprint join."""
    words = [f"f{k}" for k in range(WORDS)]

    def run(batches):
        def out():
            if sum(len(x[0]) for x in held) > 1:
                ids, size, prints, side = (np.concatenate(x) for x in zip(*held, strict=True))
                x, y = close(ids, size, prints, side if now[1] else None, least)
                for at in range(0, len(x), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]), pa.array(y[at : at + 100_000])], ["u", "v"])

        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "next", "i", "j")], axis=1)
            ids, size, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "size", "side"))
            prints = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in words], axis=1).view(np.uint64)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if tuple(key[lo].tolist()) != now:
                    yield from out()
                    held, now = [], tuple(key[lo].tolist())
                held.append((ids[lo:hi], size[lo:hi], prints[lo:hi], side[lo:hi]))
        yield from out()

    # a little wider than the threshold, so that no rounding puts a pair two bands apart
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(1e-9 - math.log(least))).cast("int")
    rows = written(own.withColumn("band", band))
    count = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count("*").alias("n")).collect()}  # one per band, as many as sizes' logarithms
    most = min(MOST_ROWS, max(LEAST_ROWS, sum(count.values()) // SHARE))
    tiles = {b: -(-n // most) for b, n in count.items()}
    of = rows.sparkSession.createDataFrame([(b, k, tiles.get(b - 1, 0), tiles.get(b + 1, 0)) for b, k in tiles.items()], "band int, k int, under int, over int")
    tile = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")

    def every(k, f):
        kind = "array<struct<band:int,next:boolean,i:int,j:int,side:boolean>>"
        return F.when(F.col(k) > 0, F.transform(F.sequence(F.lit(0), F.col(k) - 1), f)).otherwise(F.array().cast(kind))

    def meeting(band, follows, i, j, side):
        return F.struct(band.alias("band"), F.lit(follows).alias("next"), i.alias("i"), j.alias("j"), side.alias("side"))

    here = F.col("band")
    at = F.concat(
        every("k", lambda o: meeting(here, False, F.least(tile, o), F.greatest(tile, o), F.lit(False))),
        every("over", lambda o: meeting(here, True, tile, o, F.lit(False))),
        every("under", lambda o: meeting(here - 1, True, o, tile, F.lit(True))),
    )
    # of, a row per band, is what createDataFrame made of the counts above
    met_at = rows.join(F.broadcast(of), "band").withColumn("at", F.explode(at))
    dealt = met_at.select("at.band", "at.next", "at.i", "at.j", "at.side", "id", "size", *words)
    unit = ["band", "next", "i", "j"]
    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, tid and set for every row of docs(doc_id, text)."""

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_tid(t) for t in texts], pa.binary()), pa.array([shingles(t, width).tobytes() for t in texts], pa.binary())], ["id", "tid", "set"])

    return docs.mapInArrow(run, "id long, tid binary, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v of the pairs(a, b) of ids that are similar enough."""

    def run(batches):
        for b in batches:
            u, v = [], []
            for x, y, p, q in zip(*(b.column(c).to_pylist() for c in ("u", "v", "p", "q")), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if _is_near(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), least):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    left = sets.select(F.col("id").alias("a"), F.col("id").alias("u"), F.col("set").alias("p"))
    right = sets.select(F.col("id").alias("b"), F.col("id").alias("v"), F.col("set").alias("q"))
    size = F.octet_length("p"), F.octet_length("q")
    return (
        pairs.join(left, "a").join(right, "b").where(F.least(*size) >= F.greatest(*size) * F.lit(least - 1e-6))
        .select("u", "v", "p", "q").mapInArrow(run, "u long, v long")
    )


def places(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of a set's hashes per segment: shape (len(sets), SEGMENTS)."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    segment = (np.concatenate(sets) >> np.uint64(58)).astype(np.int64)
    return np.bincount(of * SEGMENTS + segment, minlength=len(sets) * SEGMENTS).reshape(-1, SEGMENTS)


def met(ids: list[int], roots: list[int], sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of members of different roots that are similar enough. Sets of s and
    t hashes are if no more than (s + t) * (1 - least) / (1 + least) are in one of them alone."""
    size = np.array([len(s) for s in sets], np.int64)
    at = places(sets)
    root = np.array(roots)
    apart = (1 - least) / (1 + least)
    u, v = [], []
    for i in range(len(ids) - 1):
        open_ = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        near = np.abs(at[open_] - at[i]).sum(axis=1) <= (size[i] + size[open_]) * apart + 1e-6
        for j in open_[near].tolist():
            if root[j] == root[i]:
                continue
            if _is_near(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i], size[j], least):
                u.append(ids[i])
                v.append(ids[j])
                root[root == root[j]] = root[i]
    return local_forest(np.array(u, np.int64), np.array(v, np.int64))


def _links_in_keys(filed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v: links among the members filed(h, id, root) of one h and of different roots. Tiles
    are dealt by the sizes of the sets(id, tid, set) alone; a set is shipped to its tiles only."""

    def run(batches):
        def out(rows):
            if len(rows) > 1:
                x, y = met([r[3] for r in rows], [r[4] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], least)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["u", "v"])

        held, now = [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "i", "j", "id", "root", "set")), strict=True):
                if row[:3] != now:
                    yield from out(held)
                    held, now = [], row[:3]
                held.append(row)
        yield from out(held)

    # written: tiles depend on it twice, and it has no sets
    sized = written(filed.join(sets.select("id", "tid", F.octet_length("set").alias("size")), "id"))
    sizes = sized.groupBy("h").agg(F.ceil(F.sum("size") / (8 * TILE)).cast("int").alias("k"))
    tile = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    return (
        sized.join(sizes, "h")
        .withColumn("t", tile)
        .withColumn("o", F.explode(every))
        .select("h", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "id", "tid", "root")
        .join(sets, ["id", "tid"])
        .select("h", "i", "j", "id", "root", "set")
        .repartition("h", "i", "j")
        .sortWithinPartitions("h", "i", "j")
        .mapInArrow(run, "u long, v long")
    )


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, text: str = "text") -> DataFrame:
    """doc_id, component_id for every row of docs: component_id is the smallest doc_id that
    links reach from it, itself included. Two texts link if the sets of their shingles of
    ``width`` words (A-Z as a-z; fewer words are one shingle) have a Jaccard similarity of at
    least ``least``.

    Texts of the same words are a class, and those without words another; only classes are
    searched. An empty table gives no rows. No limit on the size of a class, band or component.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(_signed(docs, width))
    classes = signed.groupBy("tid").agg(F.min("doc_id").alias("id"))
    # a class is searched by the rows of its smallest doc_id; repeated rows change nothing below
    own = signed.where("size > 0").withColumnRenamed("doc_id", "id").join(classes, ["id", "tid"]).drop("tid").distinct()
    filed = components(written(_joined(own, least))).select(F.col("node").alias("id"), F.col("root").alias("h"))
    shared = filed.groupBy("h").agg(F.count("*").alias("members"), F.min("id").alias("first"))
    keyed = written(filed.join(shared, "h"))
    wanted = keyed.select("id").distinct()
    some = _sets(docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), width)
    # a doc_id of several texts may be its own class in more than one: each has a row
    sets = written(some.join(classes, ["id", "tid"]).groupBy("id", "tid").agg(F.first("set").alias("set")))
    stars = keyed.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_verified(stars, sets, least))
    named = wanted.join(components(links).select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    # a component of two has had its pair tested
    open_ = keyed.where("members > 2").select("h", "id").join(named, "id")
    mixed = open_.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    more = _links_in_keys(open_.join(mixed, "h"), sets, least)
    links = links.unionByName(written(more))
    roots = components(links).select(F.col("node").alias("id"), "root")
    of_class = classes.join(roots, "id", "left").select("tid", F.coalesce("root", "id").alias("component_id"))
    return signed.select("doc_id", "tid").join(of_class, "tid").select("doc_id", "component_id")
