"""Language-model scores of documents by prediction by partial matching.

Counts of every byte after up to ORDER bytes before it, over all training texts, form a
context trie. A byte is coded in the longest context the trie has; what the context has
not seen escapes to the next shorter one, where the followers seen before are excluded.
Escapes are estimated by method D: each follower gives half a count to the escape. A
document's score is the log10 probability of all its bytes and its end.

No gram is left out, however many there are. A byte is coded by contexts that all end in the
bytes just before it, so the trie is cut into ranges of contexts read backwards; each place
of a text belongs to one range, which has all that codes it. A range of at most NODES grams
goes to every task in turn, and a document's score is the sum over ranges.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwell.llm.common import bounded_batches, slices, written

#: Bytes of context, and the most grams that begin in one range of the trie.
ORDER, NODES = 5, 1_200_000
#: Words whose counts a task holds; those of the others are joined.
WORDS = 150_000
#: A text's end and what stands before its begin are bytes that UTF-8 never holds; so all
#: symbols but BEGIN can follow.
END, BEGIN, SYMBOLS = 0xFF, 0xFE, 255
SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << (8 * symbols)) - 1)


def gram_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The symbol at each place of the texts and the ``order`` before it, a byte each, the
    symbol lowest; and how many places each text has (its bytes and its end)."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    pad, end = bytes([BEGIN]) * order, bytes([END])
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8).astype(np.uint64)
    begin = np.cumsum(size + order) - size
    key = raw.copy()
    for k in range(1, order + 1):
        key[k:] |= raw[:-k] << np.uint64(8 * k)
    keep = np.ones(len(raw), bool)
    for k in range(1, order + 1):
        keep[begin - k] = False
    return key[keep], size


class Table:
    """Places of distinct keys, by open addressing, many at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (max(1, len(keys)) * 2 - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys)), self._at(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._at(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slots) - 1)
            got = self.slots[at]
            out[todo] = got
            more = (got >= 0) & (self.keys[got] != keys[todo])
            todo, at = todo[more], at[more]
        return out


class PPM:
    """The model of grams: for each order k, keys (k symbols of context, then the symbol) with
    counts; each order's grams without their first symbol among those of the next lower, and
    each context with all its followers."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.contexts, self.value, self.begin, self.escape, self.room, self.counts = [], [], [], [], [], [], []
        below = None
        for k, (keys, counts) in enumerate(grams):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(float)
            ctx = keys >> np.uint64(8)
            new = np.r_[True, ctx[1:] != ctx[:-1]] if len(ctx) else np.zeros(0, bool)
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            followers = np.diff(np.r_[first, len(ctx)]).astype(float)
            self.contexts.append(Table(ctx[first]))
            self.grams.append(Table(keys))
            # coding in a context that is the longest there: log10 of symbols and of escape
            self.counts.append(np.log10(counts - 0.5))
            self.value.append(self.counts[-1] - np.log10(total)[of])
            self.begin.append(np.log10(followers / 2) - np.log10(total))
            if k:
                parent = below["contexts"].find(ctx[first] & _mask(k - 1))
                seen = below["counts"][below["grams"].find(keys & _mask(k))]
                more = below["followers"][parent] - followers
                room = below["total"][parent] - (np.add.reduceat(seen, first) if len(first) else 0)
                # in the next shorter context, these followers excluded: log10 of all that is left, and of
                # escape from there, which is certain if nothing is
                self.room.append(np.log10(np.maximum(room, 0.5)))
                self.escape.append(np.where(more > 0, np.log10(np.maximum(more / 2, 0.25)) - self.room[-1], 0.0))
            else:
                self.room.append(np.zeros(len(first)))
                self.escape.append(np.zeros(len(first)))
            below = {"contexts": self.contexts[-1], "grams": self.grams[-1], "counts": counts, "total": total, "followers": followers}
        self.order = len(grams) - 1
        known = len(grams[0][0]) if grams else 0
        self.unseen = -math.log10(SYMBOLS - known) if known < SYMBOLS else 0.0

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol in its context."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        acc = np.zeros(len(keys))
        longer = np.full(len(keys), -1, np.int64)  # the context before, one symbol longer
        for k in range(self.order, -1, -1):
            if not len(todo):
                return out
            sub = keys[todo] & _mask(k + 1)
            at = self.grams[k].find(sub)
            hit = at >= 0
            h, was = at[hit], longer[hit]
            plain = was < 0
            got = np.where(plain, self.value[k][h], acc[hit] + self.counts[k][h] - (self.room[k + 1][was] if k < self.order and len(self.room[k + 1]) else 0))
            out[todo[hit]] = got
            todo, acc, longer, sub = todo[~hit], acc[~hit], longer[~hit], sub[~hit]
            ctx = self.contexts[k].find(sub >> np.uint64(8))
            there = ctx >= 0
            started = longer >= 0
            if k < self.order and len(self.escape[k + 1]):
                acc = np.where(there & started, acc + self.escape[k + 1][longer], acc)
            if len(self.begin[k]):
                acc = np.where(there & ~started, self.begin[k][ctx], acc)
            longer = np.where(there, ctx, longer)
        out[todo] = acc + self.unseen
        return out

    def scores(self, texts: list[bytes], lo: int = 0, hi: int | None = None) -> np.ndarray:
        """For each text the sum over its places from ``lo`` to before ``hi`` (all, if None)."""
        keys, size = gram_keys(texts, self.order)
        of = np.repeat(np.arange(len(size)), size)
        if lo or hi is not None:
            place = places(keys, self.order)
            here = place >= np.uint64(lo)
            if hi is not None:
                here &= place < np.uint64(hi)
            keys, of = keys[here], of[here]
        # of no places at all, bincount makes whole numbers
        return np.bincount(of, self.logs(keys), minlength=len(size)).astype(float)


def places(keys: np.ndarray, order: int) -> np.ndarray:
    """Where each key's context of ``order`` symbols stands among all, read backwards: the
    symbol just before weighs most."""
    if not order:
        return np.zeros(len(keys), np.uint64)
    return (keys.byteswap() << np.uint64(8)) >> np.uint64(64 - 8 * order)


#: Counts are told apart in so many steps for each power of e: each count up to 64 by itself.
_BIN = "cast(floor(ln(n) * 64) as int)"


def frequent(counts: DataFrame, most: int) -> int:
    """The least step of _BIN such that no more than ``most`` rows of counts(n) are at it or above;
    one past the highest if even those are more. At most 64 * ln(2**63) sums reach the driver."""
    least, kept = 64 * 64, 0
    for r in sorted(counts.groupBy(F.expr(_BIN).alias("c")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["c"]):
        kept += r["m"]
        if kept > most:
            break
        least = r["c"]
    return least


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """All grams of column ``text`` of texts (binary) as a written table: k symbols of context,
    the gram, how often it was seen, and ``place``, where the contexts that end in its own
    begin (see ``places``). Each task counts its own grams of the highest order; sums over
    all, and over shorter contexts, are partial aggregations."""

    def count(batches):
        parts, held = [], 0

        def merged():
            keys = np.concatenate([p[0] for p in parts])
            u, inv = np.unique(keys, return_inverse=True)
            return u, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(u, n):
            for lo in range(0, len(u), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 200_000].view(np.int64)), pa.array(n[lo : lo + 200_000])], ["gram", "n"])

        for b in slices(batches, "text", 1 << 19):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            keys, _ = gram_keys(texts, order)
            parts.append(np.unique(keys, return_counts=True))
            held += len(parts[-1][0])
            if held > 800_000:
                parts = [merged()]
                held = len(parts[0][0])
                if held > 500_000:
                    yield from out(*parts[0])
                    parts, held = [], 0
        if parts:
            yield from out(*merged())

    full = texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(int(_mask(k + 1).view(np.int64)))).alias("g")) for k in range(order)]))
    lower = full.select(level.alias("x"), "n").groupBy("x.k", "x.g").agg(F.sum("n").alias("n"))
    grams = lower.select("k", F.col("g").alias("gram"), "n").unionByName(full.select(F.lit(order).alias("k"), "gram", "n"))
    place = F.lit(0).cast("long")
    for j in range(1, order + 1):
        place = place.bitwiseOR(F.shiftleft(F.shiftright("gram", 8 * j).bitwiseAND(F.lit(255)), 8 * (order - j)))
    return written(grams.withColumn("place", place))


def ranges(grams: DataFrame, order: int = ORDER, nodes: int = NODES) -> list[tuple[int, int]]:
    """Ranges of places, in order and without gaps, in each of which at most ``nodes`` grams
    begin, or those of one place alone. Places are counted by their first two symbols, and those
    cells that hold more than ``nodes`` by one more symbol each: as there are no more such cells
    than ranges, 2**16 sums and 256 per range and symbol reach the driver."""
    cells: list[tuple[int, int]] = []  # begin, grams
    found, depth = grams, min(2, order)
    while True:
        shift = 8 * (order - depth)
        got = [(r["cell"] << shift, r["m"]) for r in found.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.count("*").alias("m")).collect()]
        wide = [b for b, m in got if m > nodes] if depth < order else []
        cells += [(b, m) for b, m in got if m <= nodes or depth == order]
        if not wide:
            break
        found = found.where(F.shiftleft(F.shiftright("place", shift), shift).isin(wide))
        depth += 1
    cuts, held = [0], 0
    for begin, m in sorted(cells):
        if held and held + m > nodes:
            cuts.append(begin)
            held = 0
        held += m
    return list(zip(cuts, [*cuts[1:], 1 << (8 * order)], strict=True))


def model_of(grams: DataFrame, lo: int, hi: int, order: int = ORDER) -> PPM:
    """The model for places from lo to before hi: all grams whose contexts end some context
    there. Beside those that begin there, they are the followers of at most order + 1 contexts."""
    last = F.col("place") + F.expr(f"shiftleft(1L, 8 * ({order} - k))")
    got = grams.where((F.col("place") < hi) & (last > lo)).select("k", "gram", "n").toArrow()
    k, gram, n = (got.column(c).to_numpy() for c in ("k", "gram", "n"))
    return PPM([(gram[k == i].view(np.uint64), n[k == i].astype(float)) for i in range(order + 1)])


def score(docs: DataFrame, training: DataFrame, keep: list[str] | None = None, text: str = "text", order: int = ORDER, nodes: int = NODES) -> DataFrame:
    """The columns ``keep`` of docs with n_tokens, n_known, train_tokens, base_score and score;
    of ``keep``, columns of these names go.

    Both models learn from the texts of ``training``. score is the PPM model's log10
    probability of a text. base_score is that of its words (lower-cased A-Z, cut at ASCII
    white space) and its end by their training counts, half a count added to each and for
    all unknown ones. Null texts are empty: their end alone. Repeated rows get the same
    scores; an empty table gives no rows; of an empty training set nothing is known.

    Each range of the trie is one pass over the texts, which carries its grams to the tasks and
    leaves a sum per document; grams, and so passes, grow with the training texts, slower
    than these. Word counts are partially aggregated. The commonest words' counts, WORDS at most, go to
    every task; other words are joined with theirs, so no join key is frequent.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in SCORES]
    learn = training.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    grams = gram_counts(learn, order)

    def count_words(batches):
        held: Counter = Counter()

        def out():
            items = list(held.items())
            for lo in range(0, len(items), 100_000):
                part = items[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64())], ["word", "n"])

        for b in slices(batches, "text", 1 << 20):
            for t in b.column("text").to_pylist():
                held.update(t.translate(_LOWER).split())
            if len(held) > 250_000:
                yield from out()
                held = Counter()
        yield from out()

    words = written(learn.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    texts = learn.count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, different = sums["n"] + texts, sums["v"] + (1 if texts else 0)
    below = math.log10(total + 0.5 * (different + 1))
    least = frequent(words, WORDS)
    common = words.where(F.expr(_BIN) >= least).toArrow()
    table = dict(zip(common.column("word").to_pylist(), (np.log10(common.column("n").to_numpy() + 0.5) - below).tolist(), strict=True))
    known = spark.sparkContext.broadcast(table)
    of_end = math.log10(texts + 0.5) - below
    source = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__text"))
    extra = "__row long, __n long, __known long, __base double, __rare array<binary>"
    schema = StructType([*source.schema, *spark.createDataFrame([], extra).schema])

    def run(batches):
        get = known.value.get
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "__text", 1 << 19):
            texts = b.column("__text").to_pylist()
            n, nk, base, rare = [], [], [], []
            for t in texts:
                w = t.translate(_LOWER).split()
                got = list(map(get, w))
                seen = [x for x in got if x is not None]
                n.append(len(w) + 1)
                nk.append(len(seen))
                base.append(math.fsum(seen))
                rare.append([x for x, y in zip(w, got, strict=True) if y is None] if len(seen) < len(w) else [])
            cols = [b.column(c) for c in [*keep, "__text"]]
            cols += [pa.array(np.arange(row, row + len(texts))), pa.array(n, pa.int64()), pa.array(nk, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    first = written(source.mapInArrow(run, schema))
    known.destroy()

    def coded(number: int, lo: int, hi: int) -> DataFrame:
        """What the places of one range add to the scores, as a written table."""
        model = spark.sparkContext.broadcast(model_of(grams, lo, hi, order))

        def part(batches):
            for b in slices(batches, "__text", 1 << 19):
                got = model.value.scores(b.column("__text").to_pylist(), lo, hi)
                yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(got, pa.float64())], ["__row", "__part"])

        out = written(first.select("__row", "__text").mapInArrow(part, "__row long, __part double")).withColumn("__range", F.lit(number))
        model.destroy()
        return out

    parts = reduce(DataFrame.unionByName, [coded(i, lo, hi) for i, (lo, hi) in enumerate(ranges(grams, order, nodes))])
    # summed in the order of ranges, so that repeated rows get the same to the last bit
    ordered = F.array_sort(F.collect_list(F.struct("__range", "__part")))
    ppm = parts.groupBy("__row").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["__part"]).alias("score"))
    rare = first.select("__row", F.explode("__rare").alias("word")).groupBy("word", "__row").agg(F.count("*").alias("times"))
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - below
    joined = (
        rare.join(words.where(F.expr(_BIN) < least), "word", "left")
        .groupBy("__row")
        .agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"))
    )
    return first.drop("__rare", "__text").join(ppm, "__row", "left").join(joined, "__row", "left").select(
        *keep,
        F.col("__n").alias("n_tokens"),
        (F.col("__known") + F.coalesce("found", F.lit(0)) + (1 if texts else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("more", F.lit(0.0)) + of_end).alias("base_score"),
        "score",
    )
