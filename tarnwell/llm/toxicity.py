"""Toxicity by a classifier that counterfactuals regularise.

A sparse logistic model over the words and word stems of a text. While it is fitted, each term that
names a group of people is swapped in the labelled texts for every other of its kind, and for
a word that no text has; the swapped text's features are made anew, stems included, and what
the swap changes in the score is penalised: a neutral mention shall not count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tarnwell.llm.common import bounded_batches, slices, written

#: The bounded sample that a model is fitted on: labelled rows (those of least hash).
ROWS = 20_000
#: Strengths of the penalties on weights and on counterfactual changes. A weight's penalty
#: is so many times what chance alone would move the most moved of all words.
SPARSITY, FAIRNESS = 1.0, 10.0
#: Features whose gradient without weights is at least so much of their penalty are tried first.
STRONG = 0.6
#: Once the words that count are chosen, their weights are fitted anew under this penalty on squares.
RIDGE = 2e-4
#: Lengths of the stems that count besides whole words, for languages that inflect or compound.
STEMS = (4, 5, 6, 7, 8)
#: Terms for groups of people, by kind.
IDENTITY_TERMS = [
    "woman man girl boy women men girls boys female male",
    "gay straight lesbian bisexual transgender queer homosexual heterosexual trans",
    "black white asian latino hispanic african european arab indian american",
    "muslim christian jewish hindu buddhist atheist catholic protestant muslims christians jews",
    "old young elderly teenage",
    "immigrant immigrants refugee refugees foreigner foreigners citizen citizens",
    "blind deaf disabled autistic",
    "femme homme femmes hommes musulman juif chrétien",
    "frau mann frauen männer muslime juden christen",
    "mujer hombre mujeres hombres musulmán judío cristiano",
]
_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def features(words: set[str]) -> set[str]:
    """Words, and the stems of longer words, marked by a star."""
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


def features_of(text: str | None) -> set[str]:
    return features(set(words_of(text)))


_KINDS = {t: [p for p in k.split() if p != t] for k in IDENTITY_TERMS for t in k.split()}
_FEATURES = {t: features({t}) for t in _KINDS}


def _hash(feature: str) -> int:
    """The hash that Spark's xxhash64 gives a string."""
    h = xxh64_intdigest(feature.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def swaps_of(words: set[str]) -> list[tuple[str, float]]:
    """Counterfactuals of a text's words: (what features the text has more, marked +, and less,
    marked -, than with one term swapped; weight). A term's swaps weigh 1 for the word that no
    text has and 1 in all for the others of its kind."""
    terms, out = words.intersection(_KINDS), []
    if not terms:
        return out
    base = features(words)
    for t in sorted(terms):
        rest = features(words - {t})
        lost = base - rest
        for p in [None, *_KINDS[t]]:
            own = _FEATURES[p] if p else set()
            signed = [f"+{f}" for f in sorted(lost - own)] + [f"-{f}" for f in sorted(own - base)]
            if signed:
                out.append((" ".join(signed), 1.0 / len(_KINDS[t]) if p else 1.0))
    return out


class ToxicityModel:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.words = frozenset(w for w in weights if w[-1] != "*")
        self.stems = {k: frozenset(w[:-1] for w in weights if w[-1] == "*" and len(w) == k + 1) for k in STEMS}

    def score(self, text: str | None) -> float:
        words = set(words_of(text))
        found = list(self.words & words)
        for k, known in self.stems.items():
            if known:
                found += [w + "*" for w in known.intersection({w[:k] for w in words if len(w) > k})]
        z = self.bias + sum(sorted(self.weights[w] for w in found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(y: np.ndarray, begin: np.ndarray, index: np.ndarray, size: int, swaps: list[tuple[list[int], list[float], float]], sparsity: np.ndarray | float = 0.0, fairness: float = FAIRNESS, ridge: float = 0.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of the logistic model of least mean loss, plus sparsity * |w|, plus
    fairness * the sum over swaps (features, signs, share of texts) of share times the squared
    change of the score before the logistic, plus ridge * w^2 / 2. Row r has the features
    index[begin[r]:begin[r + 1]], each once. Fast proximal gradient steps."""
    n = len(y)
    of = np.repeat(np.arange(n), np.diff(begin))
    swaps = [s for s in swaps if len(s[0])]
    f = np.concatenate([np.array(s[0], np.int64) for s in swaps]) if swaps else np.zeros(0, np.int64)
    sign = np.concatenate([np.array(s[1], float) for s in swaps]) if swaps else np.zeros(0)
    swap = np.repeat(np.arange(len(swaps)), [len(s[0]) for s in swaps])
    share = np.array([s[2] for s in swaps])
    rate = y.mean().clip(1e-6, 1 - 1e-6) if n else 0.5
    w, bias = np.zeros(size), float(np.log(rate / (1 - rate)))
    seen = np.bincount(index, minlength=size) / max(n, 1)
    # a diagonal bound on curvature: a feature's own share of rows times the features of a row, and
    # its swaps' shares times the features that change with it
    per_row = max(1.0, float(np.diff(begin).mean()) if n else 1.0)
    changed = np.bincount(swap, minlength=len(swaps))
    with_it = np.bincount(f, (share * changed)[swap], size) if len(f) else np.zeros(size)
    step = 1 / (ridge + 0.25 * (seen * per_row + 1e-3) + 2 * fairness * with_it)
    was, t = w.copy(), 1.0
    for _ in range(steps if n else 0):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + (t - 1) / t2 * (w - was)
        z = bias + np.bincount(of, v[index], n)
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(index, g[of], size) / n + ridge * v
        if len(f):
            change = np.bincount(swap, sign * v[f], len(swaps))
            grad += 2 * fairness * np.bincount(f, sign * (share * change)[swap], size)
        was, u = w, v - step * grad
        w = np.sign(u) * np.maximum(np.abs(u) - step * sparsity, 0)
        bias -= 1.0 * g.mean()
        t = t2
    return bias, w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = ROWS) -> ToxicityModel:
    """A model of labels(doc_id, toxic) over the texts of docs. Fitted on a bounded sample:
    ``rows`` labelled rows. Rows with a null label or without their text are left out; without
    any row, or of one class alone, the model is its rate.

    All features of the sample count, but few get a weight. The fit holds those whose gradient
    without weights comes near their penalty, and all of identity terms. Then the gradients of
    all others are summed over the sample at the fitted weights; those beyond their penalty
    join, until there are none, which is what makes it the fit of all features. Of the features
    that are chosen the weights are fitted anew.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen.collect()], "doc_id long, toxic int")

    def split(batches):
        for b in slices(batches, "text", 1 << 20):
            words = [set(words_of(t)) for t in b.column("text").to_pylist()]
            found = pa.array([sorted(features(w)) for w in words], pa.list_(pa.string()))
            swaps = pa.array([[{"change": c, "weight": x} for c, x in swaps_of(w)] for w in words], pa.list_(pa.struct([("change", pa.string()), ("weight", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), found, swaps], ["doc_id", "toxic", "words", "swaps"])

    sample = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # ``rows`` rows at most
        .select("doc_id", "toxic", "text")
        .mapInArrow(split, "doc_id long, toxic int, words array<string>, swaps array<struct<change:string,weight:double>>")
        .select(F.monotonically_increasing_id().alias("r"), "toxic", "words", "swaps")
    )
    sample = sample.withColumn("f", F.transform("words", lambda w: F.xxhash64(w)))
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if not n or not 0 < pos < n:
        rate = (pos + 0.5) / (n + 2)
        return ToxicityModel(float(np.log(rate / (1 - rate))), {})
    # features go by their hashes; their names are asked for once they are chosen
    each = F.explode("f").alias("h")
    stats = written(sample.select("toxic", each).groupBy("h").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")))
    prior = (pos / n) * (1 - pos / n)
    penalty = float(SPARSITY * np.sqrt(2 * np.log(stats.count() + 1) * prior))  # times the root of a feature's rows
    named = np.array(sorted(_hash(f) for f in set().union(*_FEATURES.values())), np.int64)

    def hashes_of(found: DataFrame) -> np.ndarray:
        return found.select("h").toArrow().column("h").to_numpy()

    near = F.abs(F.col("n") * (pos / n) - F.col("pos")) >= STRONG * penalty * F.sqrt("n")
    known = np.union1d(hashes_of(stats.where(near)), np.intersect1d(hashes_of(stats.where(F.col("h").isin(named.tolist()))), named))

    def rows_with(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, labels, and begin and index of the places of the rows' features in known."""

        def run(batches):
            for b in batches:
                column = b.column("f")
                flat = column.flatten().to_numpy()
                of = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(column)))
                at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                ok = known[at] == flat if len(known) else np.zeros(len(flat), bool)
                cut = np.r_[0, np.cumsum(np.bincount(of[ok], minlength=b.num_rows))]
                at = at[ok].astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column("r"), b.column("toxic"), pa.array([at[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["r", "toxic", "at"])

        got = sample.select("r", "toxic", "f").mapInArrow(run, "r long, toxic int, at binary").orderBy("r").toArrow()
        bodies = got.column("at").to_pylist()
        begin = np.r_[0, np.cumsum([len(x) // 4 for x in bodies])]
        return got.column("r").to_numpy(), got.column("toxic").to_numpy().astype(float), begin, np.frombuffer(b"".join(bodies), "<i4").astype(np.int64)

    changes = sample.select(F.explode("swaps").alias("s")).groupBy("s.change").agg(F.sum("s.weight").alias("weight")).orderBy("change").collect()

    def swaps(known: np.ndarray) -> list[tuple[list[int], list[float], float]]:
        """The counterfactuals over places of known hashes; other features have no weight to change."""
        out = []
        for r in changes:
            parts = r["change"].split()
            h = np.array([_hash(x[1:]) for x in parts], np.int64)
            at = np.searchsorted(known, h)
            ok = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h) if len(known) else np.zeros(len(h), bool)
            if ok.any():
                sign = np.array([1.0 if x[0] == "+" else -1.0 for x in parts])
                out.append((at[ok].tolist(), sign[ok].tolist(), r["weight"] / n))
        return out

    while True:
        r, y, begin, index = rows_with(known)
        present = np.bincount(index, minlength=len(known))
        bias, w = train(y, begin, index, len(known), swaps(known), penalty * np.sqrt(present) / n)
        z = bias + np.bincount(np.repeat(np.arange(len(y)), np.diff(begin)), w[index], len(y))
        left = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        left = F.broadcast(spark.createDataFrame([(int(i), float(g)) for i, g in zip(r, left, strict=True)], "r long, g double"))  # a row per row of the sample
        beyond = sample.select("r", "f").join(left, "r").select("g", each).groupBy("h").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
        more = np.setdiff1d(hashes_of(beyond.where(F.abs("g") > 1.02 * penalty * F.sqrt("n"))), known)
        if not len(more):
            break
        known = np.union1d(known, more)
    stay = w != 0
    hashes, held = known[stay], stay[index]
    begin, index = np.r_[0, np.cumsum(held)][begin], (np.cumsum(stay) - 1)[index[held]]
    bias, w = train(y, begin, index, len(hashes), swaps(hashes), ridge=RIDGE)
    wanted = spark.createDataFrame([(int(h), float(x)) for h, x in zip(hashes, w, strict=True)], "h long, w double")
    names = sample.select(F.explode("words").alias("word")).withColumn("h", F.xxhash64("word")).join(wanted, "h").groupBy("word").agg(F.max("w").alias("w"))
    return ToxicityModel(bias, {r["word"]: r["w"] for r in names.orderBy("word").collect() if r["w"]})


def predict(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with score (0 to 1) and predicted (1 if score >= threshold);
    of ``keep``, columns of these names go.

    Whole texts count. A null or empty text has the score of no words. Repeated rows get
    the same score; an empty table gives no rows. A pure map; the model, of bounded size,
    is broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).cast("string").alias("__toxicity_text"))
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches):
        m = shared.value
        for b in slices(batches, "__toxicity_text", 1 << 21):
            score = np.array([m.score(t) for t in b.column("__toxicity_text").to_pylist()])
            cols = [b.column(c) for c in keep] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)
