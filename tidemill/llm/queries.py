"""The queries of the numbered operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import alignment, chat, divergence, licenses, mixing, ngram_join, packing, pii, quality, tiff, topk, toxicity, urlfilter
from tidemill.llm.common import crc_remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_read(spark, sf_dir, "documents")))


def _scored(scores: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Contract columns of a classifier; ids of the held-out remainder taught it nothing."""
    out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return scores.withColumn("held_out", out).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 4) != 2)
    return _scored(quality.quality_scores(docs, model), 4, 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 3) != 1)
    return _scored(toxicity.toxic_segments(docs, model), 3, 1)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    return chat.digest(chat.prefix_examples(turns.unionByName(extra)))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_digest(tiff.store_text(_read(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.example_rules(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_chat": op6_chat,
    "op7_topk": op7_topk,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_tiff": op10_tiff,
    "op11_alignment": op11_alignment,
    "op12_divergence": op12_divergence,
    "op13_urlfilter": op13_urlfilter,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op6_chat": chat.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_urlfilter": urlfilter.ORACLE_SQL,
}
