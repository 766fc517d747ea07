"""The queries opN_<name> over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import crc_fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    from tarnwell.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    from tarnwell.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


ORACLES["op1_neardup"] = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
links as (select a.vec_id as u, b.vec_id as w from v a, v b
          where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, w) as (select vec_id, vec_id from v union select r.u, l.w from reach r join links l on l.u = r.w),
least as (select u, min(w) as component_id from reach group by u)
select v.vec_id, (select count(*) from links where u = v.vec_id)::bigint as n_links,
       component_id, v.vec_id = component_id as kept
from v join least on least.u = v.vec_id
"""


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the labelled rows outside fold 2 of 4."""
    from tarnwell.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels outside fold 2 of 4."""
    from tarnwell.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"], threshold=0.3)


@query
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts, learned from the rows outside fold 1 of 5."""
    from tarnwell.llm import lm

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return lm.score(docs.withColumn("held_out", held_out), docs.where(~held_out), keep=["doc_id", "held_out"])


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from tarnwell.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), near=4, width=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    from tarnwell.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=24)


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vec_id divisible by 20, among all others."""
    from tarnwell.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


ORACLES["op8_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::double) as e from embeddings),
scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
           from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
select query_id, n::int as rank, vec_id, score from ranked where n <= 20
"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of what they decode to."""
    from tarnwell.llm.bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: Bytes of a passage of over 50 words: 51 words of four letters and a space each.
PASSAGE = 51 * 5


@query
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole text keeps once strings of 400 bytes that repeat are gone; n_passage
    counts the bytes in repeated passages of over 50 words, most of which are shorter."""
    from tarnwell.llm.suffix import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), least=400, passage=PASSAGE)
    digest = F.when(F.col("kept").isNull(), F.col("text_sha256")).otherwise(F.sha2("kept", 256))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"), "n_passage")
