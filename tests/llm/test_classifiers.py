"""Language identification and toxicity: plain models, held-out accuracy, hard cases."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import langid, toxicity
from tests.llm.cases import hard_documents, no_documents


def plain_letters(text):
    """Bytes of the letters and marks of a text in lower case, one space for what is between."""
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    kept = "".join(low(c) if unicodedata.category(c)[0] in "LM" else " " for c in text)
    return re.sub(" +", " ", kept).removeprefix(" ").encode()


def plain_phrases(sample, text, window):
    """Greedy longest phrases by substring search."""
    own, s, n = plain_letters(sample), plain_letters(text), 0
    for lo in range(0, len(s), window):
        w, i = s[lo : lo + window], 0
        while i < len(w):
            k = 1
            while i + k < len(w) and own.find(w[i : i + k + 1]) >= 0:
                k += 1
            i, n = i + k, n + 1
    return n


SAMPLES = {
    "el": ["η γλώσσα είναι ένα σύστημα και οι λέξεις της αλλάζουν με τον καιρό"],
    "en": ["the language of a people is a system, and its words change over the years"],
    "hi": ["भाषा एक प्रणाली है और उसके शब्द समय के साथ बदलते हैं"],
    "ja": ["言語は体系であり、その言葉は時とともに変わる。東京の町で人々は話す"],
    "ko": ["언어는 하나의 체계이며 그 낱말은 시간이 흐르면서 바뀐다"],
    "ru": ["язык народа есть система, и слова его меняются с годами"],
    "th": ["ภาษาเป็นระบบหนึ่งและคำของมันเปลี่ยนไปตามกาลเวลา"],
    "uk": ["мова народу є системою, і її слова змінюються з роками"],
    "zh": ["语言是一个系统，它的词汇随着时间而变化。北京的人们说话"],
}


@pytest.mark.parametrize(("window", "dense"), [(50, 1 << 26), (4096, 1 << 26), (4096, 0)])
def test_fewest_normalised_phrases_win(spark, monkeypatch, window, dense):
    """predict against a plain parser, in nine languages of eight scripts."""
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "WINDOW", window)
    rng = random.Random(3)
    m = langid.LanguageModel(SAMPLES)
    texts = ["", "123", "Ж", "Ünknown ß 言葉", "the words of the years", "слова меняются", "слова змінюються", "人们的语言", "人々の言葉", "낱말은 시간", "ΓΛΏΣΣΑ", "คำของภาษา", "शब्द समय"]
    pool = [w for v in SAMPLES.values() for w in v[0].split()]
    texts += [" ".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(30)]
    count, _, has = m.phrases(texts)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    want = [[plain_phrases(SAMPLES[k][0], t, window) for k in m.names] for t in texts]
    assert count.tolist() == want
    bits = [math.log2(len(plain_letters(SAMPLES[k][0])) + 1) for k in m.names]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()
    for r in got:
        cost = [n * b for n, b in zip(want[r.doc_id], bits, strict=True)]
        assert r.lang_pred == (m.names[cost.index(min(cost))] if has[r.doc_id] else "und")
    by = {texts[r.doc_id]: r.lang_pred for r in got}
    assert [by[t] for t in texts[4:13]] == ["en", "ru", "uk", "zh", "ja", "ko", "el", "th", "hi"]


def test_every_label_is_learned_and_a_common_header_is_not_all(spark):
    """More than 64 labels; all texts of two of them open alike."""
    rng = random.Random(1)
    header = "".join(rng.choices("abcdefgh ", k=700))
    word = lambda a: "".join(rng.choices(a, k=5))
    rows = [(f"l{k:02d}", " ".join(word(a) for _ in range(40))) for k in range(80) for a in [[chr(0x4E00 + 40 * k + i) for i in range(30)]] for _ in range(3)]
    rows += [(name, header + " " + " ".join(word(a) for _ in range(400))) for name, a in (("x1", "ijklmnop"), ("x2", "qrstuvwx")) for _ in range(60)]
    m = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(m.names) == 82
    texts = [" ".join(word(a) for _ in range(20)) for a in ("ijklmnop", "qrstuvwx")]
    assert [m.names[i] for i in m.choose(texts)[0]] == ["x1", "x2"]
    assert [m.names[i] for i in m.choose([t for _, t in rows[:240:3]])[0]] == [f"l{k:02d}" for k in range(80)]


def test_languages_of_held_out_documents(spark):
    from tarnwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_langid"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.98 * len(held)


def test_langid_hard_cases(spark):
    docs = hard_documents(spark)
    m = langid.fit(docs)
    got = langid.predict(docs, m, keep=["doc_id", "h"]).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 13
    assert by[1] == by[2] == by[3] == by[11] == ("und", 0.0) and by[9][0] != "und"
    assert langid.predict(no_documents(spark), m).count() == 0
    none = langid.fit(no_documents(spark))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    clash = docs.withColumn("score", F.lit("z")).withColumn("lang_pred", F.lit("z"))
    again = langid.predict(clash, m, keep=["doc_id", "score", "lang_pred", "h"])
    assert again.columns == ["doc_id", "h", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in again.collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in got)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (5, 6)}) == 1  # repeated rows and copies


def test_toxicity_finds_what_labels_mark(spark):
    from tarnwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    insults = {"idiot", "moron", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "stupid", "clown"}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    bad = [len(insults.intersection(toxicity.words_of(text[r.doc_id]))) for r in got]
    hit = [r.predicted for r, n in zip(got, bad, strict=True) if n >= 2]
    assert len(hit) > 30 and np.mean(hit) > 0.98
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([r.predicted for r in got if label.get(r.doc_id) == 0]) < 0.015
    assert np.mean([r.predicted for r in got if label.get(r.doc_id) == 1]) > 0.75


def test_swaps_pull_neutral_terms_together():
    """A term that stands mostly in toxic texts loses its weight to the penalty on swaps."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        t = rng.random() < 0.3
        f = [0] if t and rng.random() < 0.9 else []  # the insult
        if rng.random() < (0.6 if t else 0.1):
            f.append(1)  # a group that toxic texts name more often
        elif rng.random() < 0.3:
            f.append(2)  # another
        rows.append(f)
        y.append(t)
    begin = np.cumsum([0, *map(len, rows)])
    index = np.array([i for f in rows for i in f])
    swaps = [([1, 2], [1.0, -1.0], 0.25), ([2, 1], [1.0, -1.0], 0.25), ([1], [1.0], 0.25), ([2], [1.0], 0.25)]
    _, free = toxicity.train(np.array(y, float), begin, index, 3, [], fairness=0)
    _, held = toxicity.train(np.array(y, float), begin, index, 3, swaps, fairness=10)
    assert free[1] - free[2] > 1 and abs(held[1] - held[2]) < 0.15 and abs(held[1]) < 0.3 and held[0] > 3


def test_swaps_are_of_whole_texts():
    """Each counterfactual is what the text's features and the swapped text's differ in."""
    text = "the muslims and the muslim women live here"
    words = set(toxicity.words_of(text))
    want = Counter()
    for t in sorted(words.intersection(toxicity._KINDS)):
        partners = toxicity._KINDS[t]
        for p in [None, *partners]:
            other = toxicity.features((words - {t}) | ({p} if p else set()))
            base = toxicity.features(words)
            change = [f"+{f}" for f in sorted(base - other)] + [f"-{f}" for f in sorted(other - base)]
            want[" ".join(change)] += 1 / len(partners) if p else 1
    got = Counter()
    for c, x in toxicity.swaps_of(words):
        got[c] += x
    want.pop("", None)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
    assert any("+muslims" in c for c in want) and any("musl*" in c for c, _ in toxicity.swaps_of({"muslims"}))


def test_neutral_mentions_score_alike_and_insults_high(spark):
    """fit and predict with production parameters on texts where toxic ones name one group far
    more often: a neutral mention stays within 0.02 of its swap, stems included."""
    rng = random.Random(7)
    filler = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(3000):
        bad = rng.random() < 0.2
        w = rng.choices(filler, k=rng.randint(8, 30))
        if bad and rng.random() < 0.95:
            w.insert(rng.randrange(len(w)), rng.choice(["idiots", "scumbag", "worthless"]))
        if rng.random() < (0.6 if bad else 0.1):
            w.insert(rng.randrange(len(w)), "muslims")
        elif rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "christians")
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    m = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {t: m.score(f"the {t} live here") for t in ("muslims", "christians", "jews", "muslim", "people")}
    assert max(score.values()) - min(score.values()) < 0.02, score
    assert all(m.score(f"the {t} are {x}") > 0.8 for t in ("muslims", "christians") for x in ("idiots", "worthless"))
    right = [(m.score(t) >= 0.3) == bool(y) for (_, t), (_, y) in zip(docs, labels, strict=True)]
    assert np.mean(right) > 0.97


def test_scores_are_those_of_a_plain_model(spark):
    """The query's scores from the fitted weights, feature by feature."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    text = {r.doc_id: r.text for r in docs.collect()}
    from tarnwell.llm.queries import QUERIES

    for r in QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect():
        words = {w for w in re.findall(r"[^\W\d_]+", (text[r.doc_id] or "").lower())}
        own = {f for w in words for f in [w, *[w[:k] + "*" for k in toxicity.STEMS if len(w) > k]]}
        z = m.bias + math.fsum(m.weights[f] for f in own if f in m.weights)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_toxicity_hard_cases(spark):
    docs = hard_documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 12)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    got = toxicity.predict(docs, m, keep=["doc_id", "h", "id"]).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3]
    assert toxicity.predict(no_documents(spark), m).count() == 0
    clash = docs.withColumn("score", F.lit("z")).withColumn("predicted", F.lit("z"))
    again = toxicity.predict(clash, m, keep=["doc_id", "score", "predicted"])
    assert again.columns == ["doc_id", "score", "predicted"] and {(r.doc_id, r.score) for r in again.collect()} == {(r.doc_id, r.score) for r in got}
    assert by[5] == by[6] and len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert not one.weights and toxicity.fit(no_documents(spark), labels).weights == {}
