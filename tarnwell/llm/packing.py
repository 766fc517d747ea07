"""Packing documents into token sequences of a fixed length, by best-fit decreasing."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.bpe import byte_alphabet
from tarnwell.llm.common import bounded_batches, slices

#: Tokens that a task holds before it packs them. Sequences filled less than
#: REOPEN of their length give their pieces back to the next lot.
LOT_TOKENS = 3_000_000
REOPEN = 0.98


class Windows:
    """Open windows by remaining capacity, in a segment tree over 0..size: a leaf counts
    the open windows with that much room, an inner node says if any lies below it."""

    def __init__(self, size: int):
        self.leaves = 1 << (size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need among open windows, or -1."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        i = room + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each length in 1..size, and the number of windows. Longest
    first, equal lengths in the order given; each into the tightest window that takes it."""
    order = np.argsort(-lengths, kind="stable")
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Windows(size), 0
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = tree.tightest(need)
        if room < 0:
            room, at, n = size, n, n + 1
        else:
            at = tree.take(room)
        window[i], offset[i] = at, size - room
        if room > need:
            tree.add(room - need, at)
    return window, offset, n


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library, its special
    tokens included, by an engine for the same ranks. Falls back to the library itself
    where that engine refuses a text."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level split pattern

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes([of[c] for c in t]): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.engine = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.library = path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.engine.encode_to_numpy(text, allowed_special="all")
        except Exception:  # its regular expressions give up on some texts
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_padding()
                self.library.no_truncation()
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def shared_tokenizer(path: str) -> ByteTokenizer:
    """A worker's tokenizer for a file, which its later tasks use again."""
    return ByteTokenizer(path)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, text: str = "text", lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    Each document is its ids and ``end_id``. A document longer than a sequence is first
    cut into full windows, which fill sequences of their own; what is left of it, and
    every shorter document, goes by best-fit decreasing into the tightest open window.
    Returns a row per piece with its ids (binary, little-endian uint32), its place in the
    document, and its sequence and offset there; offsets of a sequence have no gap.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    come. An empty table gives no pieces. One pass without a shuffle: a task packs lots of
    ``lot_tokens``, and passes badly filled sequences on to the next lot, so only the last
    lot of a task leaves room. sequence_id holds the task's partition in its upper bits,
    so a task that is run again gives the same ids.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        tokens = shared_tokenizer(path)
        end = np.array([end_id], "<u4")
        base, used = TaskContext.get().partitionId() << 40, 0
        rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        held = 0

        def out(pieces, sequences, offsets):
            for lo in range(0, len(pieces), 4096):
                part = pieces[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in part], pa.int64()),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([len(p[2]) for p in part], pa.int64()),
                        pa.array([p[2].tobytes() for p in part], pa.binary()),
                        pa.array([p[3] for p in part], pa.int64()),
                        pa.array(sequences[lo : lo + 4096], pa.int64()),
                        pa.array(offsets[lo : lo + 4096], pa.int64()),
                    ],
                    schema=_SCHEMA,
                )

        def settle(last):
            nonlocal rest, held, used
            if not rest:
                return
            lengths = np.array([len(p[2]) for p in rest], np.int64)
            window, offset, n = best_fit_decreasing(lengths, size)
            fill = np.bincount(window, lengths, n)
            done = np.ones(n, bool) if last else fill >= REOPEN * size
            number = np.cumsum(done) - 1 + used + base
            used += int(done.sum())
            go = np.flatnonzero(done[window])
            go = go[np.lexsort((offset[go], window[go]))]
            yield from out([rest[i] for i in go], number[window[go]], offset[go])
            rest = [rest[i] for i in np.flatnonzero(~done[window])]
            held = sum(len(p[2]) for p in rest)

        for b in slices(batches, "text", 2 << 20):
            full = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.concatenate([tokens(t or "").astype("<u4"), end])
                cut = len(ids) // size * size
                full += [(doc, at, ids[at : at + size], len(ids)) for at in range(0, cut, size)]
                if cut < len(ids):
                    rest.append((doc, cut, ids[cut:], len(ids)))
                    held += len(ids) - cut
            if full:
                yield from out(full, np.arange(len(full)) + used + base, np.zeros(len(full), np.int64))
                used += len(full)
            if held >= lot_tokens:
                yield from settle(False)
        yield from settle(True)

    return docs.mapInArrow(run, PIECES)
