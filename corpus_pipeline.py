"""A corpus through five stages: language, toxicity, near copies, repeated passages, packing.

Each stage takes all that the one before kept and its decisions take effect. All but the
last return the columns of documents. Later stages see the text as earlier ones left it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import crc_fold, settled, table, written
from tarnwell.llm.queries import PASSAGE, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language stay, and are labelled with it where they had no label; those
    without letters (null, empty and blank texts among them) are predicted ``und`` and go. The
    model learns from labelled rows of docs; without any, nothing has a language and all go.
    Repeated rows share their fate, ties go to the language that sorts first, texts count
    whole, columns besides those of documents are dropped; an empty table stays empty."""
    from tarnwell.llm import langid

    docs = docs.select(COLUMNS)
    model = langid.fit(docs.where(F.coalesce(crc_fold(F.col("doc_id"), 4) != 2, F.lit(False))))
    found = langid.predict(docs, model, keep=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose score is below 0.3. The model learns from ``labels``; where no label
    fits a document, every text scores a quarter and stays; an
    empty table stays empty. A null or empty text has the score of no words; repeated rows share
    their fate; texts count whole; columns besides those of documents are dropped."""
    from tarnwell.llm import toxicity as T

    docs = docs.select(COLUMNS)
    labels = table(spark, sf_dir, "labels")
    model = T.fit(docs, labels.where(crc_fold(F.col("doc_id"), 4) != 2))
    return T.predict(docs, model, keep=COLUMNS, threshold=0.3).where("predicted = 0").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more) the document
    of smallest doc_id stays; of repeated rows of it, one. Rows without doc_id stay. Texts
    without words, null or empty, are copies of each other; texts count whole; columns besides
    those of documents are dropped; an empty table stays empty."""
    from tarnwell.llm.simhash import near_duplicates

    docs = docs.select(COLUMNS)
    named = docs.where("doc_id is not null")
    keep = settled(lambda: near_duplicates(named, width=5, least=0.8).where("doc_id = component_id").select("doc_id").distinct())
    kept = named.join(keep, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    return kept.select(COLUMNS).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = PASSAGE) -> DataFrame:
    """Every byte goes that a string of ``least`` bytes covers which repeats, in the same text or
    another: at 255, that is passages of 51 words of four letters and a space each. Every
    document stays, if need be with an empty text, a null text as null; no copy of a passage
    stays; texts count whole; columns besides those of documents are dropped."""
    from tarnwell.llm.suffix import without_repeats

    cut = without_repeats(docs.select(COLUMNS), least=least)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids. A null or empty text
    is its end token alone; longer texts are cut into full windows first; repeated rows are
    packed each; an empty table gives no pieces."""
    from tarnwell.llm.packing import pack

    return pack(docs, tokenizer_file("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [("language", language), ("toxicity", toxicity), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packed", packed)]

#: No stage but the last two filters can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
