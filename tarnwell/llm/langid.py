"""Language identification by cross-parsing.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into the
longest phrases that occur in a language's text. Phrases are normalised by the bits that name
one among all places of that language's text; the language that needs fewest wins.

Texts are read as the bytes of their letters, lower-cased, what stands between them being one
space: every letter of every script is told apart, whatever languages there are.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import bounded_batches, slices
from tarnwell.llm.lm import Table

#: The bounded sample that a model is fitted on: so many texts of each language, and of each so
#: many stretches of so many characters, spread over all of it (a shorter text counts whole).
TEXTS, STRETCHES, CHARACTERS = 48, 6, 100
#: Bytes after which the parse of a long text starts anew, which adds a phrase at most.
WINDOW = 4096
#: Bytes over which the score weighs what languages' codes are longer.
SPREAD = 24
#: Entries of a table of steps with a place for each byte of a language; larger models are hashed.
DENSE = 1 << 26
SPACE = 0x20


def _kinds() -> np.ndarray:
    """0 neither, 1 a mark, 2 a letter, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            out[c] = 2 if kind == "L" else 1
    return out


def _lowered(kinds: np.ndarray) -> np.ndarray:
    """The code point that stands for each: its lower case where that is one, SPACE for what is
    no letter or mark."""
    out = np.where(kinds > 0, np.arange(0x110000), SPACE).astype("<u4")
    for c in np.flatnonzero(kinds == 2):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


class SuffixAutomaton:
    """All substrings of a sequence of symbols: next[state][symbol], state 0 being empty."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class LanguageModel:
    """Automata of all languages in one table of steps; parses many texts in lockstep."""

    def __init__(self, samples: dict[str, list[str]]):
        kinds = _kinds()
        self.letter, self.low = kinds == 2, _lowered(kinds)
        own = {k: self.letters([" ".join(v)])[0] for k, v in sorted(samples.items())}
        self.names = [k for k, v in own.items() if len(v)]
        self.bits = [math.log2(len(own[k]) + 1) for k in self.names]
        steps = [SuffixAutomaton(own[k].tolist()).next for k in self.names]
        # a state is where its row of steps begins; a byte's place in the rows of a language, the
        # last being that of bytes that its text lacks
        self.place = np.zeros((len(steps), 256), np.int32)
        widths = []
        for place, k in zip(self.place, self.names, strict=True):
            there = np.unique(own[k])
            place[:] = len(there)
            place[there] = np.arange(len(there))
            widths.append(len(there) + 1)
        self.dense = sum(len(x) * w for x, w in zip(steps, widths, strict=True)) <= DENSE
        if not self.dense:
            widths = [1] * len(steps)
        self.roots, tables, keys, to, base = [], [], [], [], 0
        self.begin = np.zeros((len(steps), 256), np.int64)  # where a phrase that begins with a byte goes
        for x, w, place, begin in zip(steps, widths, self.place, self.begin, strict=True):
            self.roots.append(base)
            begin[:] = base
            for c, q in x[0].items():
                begin[c] = base + q * w
            if self.dense:
                t = np.full((len(x), w), -1, np.int32)
                for state, by in enumerate(x):
                    for c, q in by.items():
                        t[state, place[c]] = base + q * w
                tables.append(t.reshape(-1))
            else:
                keys += [((base + state) << 8) | c for state, by in enumerate(x) for c in by]
                to += [base + q for by in x for q in by.values()]
            base += len(x) * w
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.steps, self.to = Table(np.array(keys, np.uint64)), np.array(to, np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where bytes c lead from states (a row for each language), negative for nowhere."""
        if self.dense:
            return self.table.take(state + self.place.take(c, axis=1))
        at = self.steps.find(((state.astype(np.int64) << 8) | c).view(np.uint64).reshape(-1)).reshape(state.shape)
        return np.where(at < 0, -1, self.to.take(at))

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts' letters one after the other, each run of none being one SPACE and
        none at a text's start; their number by text; whether a text has a letter."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        has = np.bincount(of, self.letter[points], len(texts)) > 0
        low = self.low[points]
        letter = low != SPACE
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (of[1:] == of[:-1])
        low, of = low[keep], of[keep]
        width = 1 + (low > 0x7F) + (low > 0x7FF) + (low > 0xFFFF)
        raw = np.frombuffer(low.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        return raw, np.bincount(of, width, len(texts)).astype(np.int64), has

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that each text takes in each language, its bytes, and whether it has a letter."""
        s, size, has = self.letters(texts)
        windows = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(texts)), windows)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(size) - size, windows) + k * WINDOW
        length = np.minimum(WINDOW, np.repeat(size, windows) - k * WINDOW)
        by = np.argsort(-length, kind="stable")
        doc, start, length = doc[by], start[by], length[by]
        live = len(doc) - np.searchsorted(length[::-1], np.arange(WINDOW), "right")  # lanes longer than t
        langs = len(self.names)
        roots = np.array(self.roots, np.int32)[:, None]
        begin = self.begin.astype(np.int32)
        state = np.repeat(roots, len(doc), axis=1)
        count = np.zeros(state.shape, np.int32)
        for t in range(int(length[0]) if len(length) and langs else 0):
            m = int(live[t])
            c = s[start[:m] + t].astype(np.int64)
            now = state[:, :m]
            to = self.step(now, c)
            new = to < 0
            count[:, :m] += new | (now == roots)
            state[:, :m] = np.where(new, begin.take(c, axis=1), to)
        return np.array([np.bincount(doc, n, len(texts)) for n in count], np.int64).reshape(langs, len(texts)).T, size, has

    def choose(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language of fewest normalised phrases for each text (a place among names; ties to
        the first), a score, and whether it has a letter. The score is the share of that language
        when each weighs by how much longer its code is, for SPREAD bytes."""
        count, size, has = self.phrases(texts)
        cost = count * np.array(self.bits)
        longer = (cost - cost.min(axis=1, keepdims=True)) * (SPREAD / np.maximum(size, SPREAD))[:, None]
        return cost.argmin(axis=1), 1 / np.exp2(-np.minimum(longer, 60)).sum(axis=1), has


def _stretches(text):
    """Of a text column: STRETCHES of CHARACTERS each, the first at its begin and the last at its
    end, or all of a text that has no more."""
    size, parts = F.length(text), STRETCHES * CHARACTERS
    at = [F.floor((size - CHARACTERS) * k / (STRETCHES - 1)).cast("int") + 1 for k in range(STRETCHES)]
    return F.when(size <= parts, text).otherwise(F.concat_ws(" ", *[F.substring(text, a, F.lit(CHARACTERS)) for a in at]))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of every language that labels rows of labelled with letters in their text. Fitted
    on a bounded sample: at most TEXTS different texts of each language, those of least hash
    in as many classes by hash, and stretches of each. Rows without text, letters or label are
    left out; copies of a text count once. Sums and minima are partially aggregated."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", _stretches(F.col("text")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # classes are four times as many as texts, so that a language of few texts loses hardly any
    least = rows.groupBy("lang", F.pmod("h", F.lit(4 * TEXTS)).alias("part")).agg(F.min("h").alias("h"))
    chosen = least.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("h")), 1, TEXTS).alias("h")).select("lang", F.explode("h").alias("h"))
    got = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for r in got.orderBy("lang", "h").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel(samples)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score (0 to 1: the share of that language
    when each is weighed by what its code is longer); of ``keep``, columns of these names go.

    lang_pred is ``und`` with score 0 where a text is null or has no letter, and everywhere
    if the model has no language. Ties go to the language that sorts first. Whole texts
    are parsed; repeated rows get the same result; an empty table gives no rows. A pure
    map; the model, bounded by its languages, is broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).cast("string").alias("__langid_text"))
    schema = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        m = shared.value
        for b in slices(batches, "__langid_text", 1 << 21):
            texts = [t or "" for t in b.column("__langid_text").to_pylist()]
            if m.names:
                best, score, has = m.choose(texts)
            else:
                best, score, has = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            lang = [m.names[i] if h else "und" for i, h in zip(best.tolist(), has.tolist(), strict=True)]
            cols = [b.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
