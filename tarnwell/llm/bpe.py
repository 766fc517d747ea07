"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be spanned by a
merge. Every place between two such bytes is a certain cut: the fragments between cuts
are encoded on their own and their ids concatenated, and the result is that of the whole.

ASCII white space is a certain cut of this vocabulary too (its pre-tokenizer drops all
white space and matches no pattern across it), so a text is cut there first, and the
ids of a chunk are looked up or worked out once per task.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import bounded_batches, slices

#: Chunks whose ids a worker remembers: two generations of so many.
CACHE_CHUNKS = 300_000
#: Longer chunks are worked out each time.
CACHE_BYTES = 48

#: Fixed value: the split pattern of the word-end vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    bytes that print stand for themselves, the others for U+0100 and up in order."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in printing}, 0x100
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class ForcedBoundaryEncoder:
    """Encodes chunks free of ASCII white space; holds the library's own parts for
    normalising, splitting and merging, and a table of byte pairs that tokens contain."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.normalise = self.whole.normalizer.normalize_str if self.whole.normalizer else (lambda s: s)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        self.vocab = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the last fragment of a word carries the word's end, those before it do not
        self.last = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix, cache_capacity=0).tokenize
        self.inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0).tokenize
        # on printing ASCII the parts above reduce to lower-casing and this pattern
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall if split["pattern"]["Regex"] == WORD_PATTERN else None
        self.chars = byte_alphabet()
        of = {c: b for b, c in enumerate(self.chars)}
        pairs = np.zeros((256, 256), bool)
        for token in self.vocab:
            if token in self.special:
                continue
            body = token.removesuffix(self.suffix) if self.suffix else token
            raw = np.array([of[c] for c in body if c in of], dtype=np.int64)
            pairs[raw[:-1], raw[1:]] = True
        #: inside[x * 256 + y]: some token holds byte x directly before byte y
        self.inside = pairs.reshape(-1).tolist()
        self.new: dict[bytes, tuple[bytes, str]] = {}
        self.old: dict[bytes, tuple[bytes, str]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """word cut at its forced boundaries."""
        out, begin, inside = [], 0, self.inside
        for i in range(1, len(word)):
            if not inside[word[i - 1] << 8 | word[i]]:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:])
        return out

    def work_out(self, chunk: bytes) -> tuple[bytes, str]:
        """(ids as little-endian uint32, tokens joined by a space) of a chunk."""
        text = chunk.decode("utf-8")
        if "<|" in text and any(s in text for s in self.special):
            got = self.whole.encode(text, add_special_tokens=False)
            return np.array(got.ids, "<u4").tobytes(), " ".join(got.tokens)
        ids, names, chars = [], [], self.chars
        if self.plain and text.isascii() and text.isprintable():
            words = self.plain(text.lower())
        else:
            words = [w for w, _ in self.words(self.normalise(text))]
        for word in words:
            cut = self.fragments(word.encode("utf-8"))
            for k, part in enumerate(cut):
                for t in (self.last if k == len(cut) - 1 else self.inner)("".join([chars[b] for b in part])):
                    ids.append(t.id)
                    names.append(t.value)
        return np.array(ids, "<u4").tobytes(), " ".join(names)

    def of_chunk(self, chunk: bytes) -> tuple[bytes, str]:
        got = self.old.get(chunk)
        if got is None:
            got = self.work_out(chunk)
        if len(chunk) <= CACHE_BYTES:
            if len(self.new) >= CACHE_CHUNKS:
                self.old, self.new = self.new, {}
            self.new[chunk] = got
        return got

    def encode(self, text: bytes) -> tuple[bytes, str]:
        """(ids, decoded text) of a whole text in UTF-8."""
        out = []
        for chunk in text.split():
            got = self.new.get(chunk)
            out.append(got if got is not None else self.of_chunk(chunk))
        return b"".join([x[0] for x in out]), " ".join([x[1] for x in out if x[1]])


@functools.cache
def shared_encoder(path: str) -> ForcedBoundaryEncoder:
    """A worker's encoder for a file, which its later tasks use again."""
    return ForcedBoundaryEncoder(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' other columns are dropped but doc_id; adds ids (binary, little-endian
    unsigned 32-bit) and decoded (text as the library decodes the ids).

    Null and empty texts, and texts of white space alone, give no ids and an empty
    decoded text. Repeated rows give repeated rows; an empty table an empty one. A pure
    map: no shuffle, memory bounded by one batch, one text and the chunk cache.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        coder = shared_encoder(path)
        for b in slices(batches, "text", 2 << 20):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            got = [coder.encode(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                schema=schema,
            )

    return docs.mapInArrow(run, "doc_id long, ids binary, decoded string")
