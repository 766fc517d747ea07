"""The pipeline: every stage against brute force on its own input."""

import random
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tarnwell.llm.queries import tokenizer_file
from tests.llm.cases import hard_documents, no_documents
from tests.llm.test_coding import check_packing, library
from tests.llm.test_similar import plain_roots
from tests.llm.test_suffix import plain


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) of each stage over the hard cases and a small table."""
    from tarnwell.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(hard_documents(spark).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars"))
    out = {}
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, sf_dir))
        out[name] = (docs, after)
        docs = after
    return out


def test_language_and_toxicity_keep_clean_documents(stages):
    before, after = stages["language"]
    letters = {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in after.collect()} == letters and after.columns == P.COLUMNS
    assert not [r for r in after.collect() if r.lang is None]
    before, after = stages["toxicity"]
    bad = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert len(bad) < 0.2 * before.count() and after.columns == P.COLUMNS


def test_near_copies(stages):
    before, after = stages["near_copies"]
    rows = before.collect()
    want = plain_roots([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))
    assert after.columns == P.COLUMNS


def test_repeated_passages(stages):
    before, after = stages["repeated_passages"]
    rows = [r for r in before.collect()]
    want = {r.doc_id: kept.decode("utf-8", "ignore") for r, (*_, kept) in zip(rows, plain([r.text for r in rows], P.PASSAGE), strict=True)}
    got = {r.doc_id: r.text for r in after.collect()}
    assert got == want and any(len(want[r.doc_id]) < len(r.text) for r in rows)


def test_packed(stages):
    before, after = stages["packed"]
    check_packing(after.collect(), before.collect(), library("byte_bpe_50k.json"), 2048)
    assert tokenizer_file("byte_bpe_50k.json") and sys.modules["corpus_pipeline"].ORACLE_SQL is None


def test_stages_of_no_rows_and_of_more_columns(spark, sf_dir):
    """Empty tables stay empty; columns that clash with an operator's own are dropped."""
    for name, stage in P.STAGES:
        got = stage(spark, no_documents(spark), sf_dir)
        assert got.count() == 0 and (name == "packed" or got.columns == P.COLUMNS)
    clash = hard_documents(spark)
    for c in ("score", "lang_pred", "predicted", "tid", "kept", "component_id", "__text"):
        clash = clash.withColumn(c, F.lit("z"))
    for name, stage in P.STAGES:
        got = stage(spark, clash, sf_dir)
        assert got.count() >= 0 and (name == "packed" or got.columns == P.COLUMNS)


def test_passages_of_over_50_words_go(spark, sf_dir):
    """Recall on planted passages of 51 to 60 words, and texts that share nothing stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8])))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], {}
    for k in range(40):
        passages[k] = text(51 + k % 10)
        rows += [(2 * k + c, f"{text(30)} {passages[k]} {text(30)}") for c in (0, 1)]
    rows += [(1000 + k, text(200)) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "a", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.repeated_passages(spark, docs, sf_dir).collect()}
    caught = sum(passages[i // 2] not in got[i] and len(got[i]) < 0.7 * len(t) for i, t in rows if i < 1000)
    assert caught >= 0.95 * 80
    assert all(got[i] == t for i, t in rows if i >= 1000)


def test_registered(spark, sf_dir):
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
    assert q["pipeline"](spark, sf_dir).count() > 100
