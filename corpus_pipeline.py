"""From raw documents to packed sequences: five of the numbered operators in a row.

Every stage takes documents as they come: null ids, texts, languages and sources,
empty and very long texts, repeated rows and ids, columns of any name beside the five
of documents, and tables without rows, which give tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import mixing, ngram_join, packing, pii, quality
from tidemill.llm.common import crc_remainder, stored

#: A document goes if its quality score is below this.
LEAST_QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: keep what the rule ensemble accepts.

    A null text counts as an empty one and is judged as such; equal texts meet the same
    fate, repeated rows each for itself. Without labels every score is 0.5, so all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document stays of each group that five-word shingles link.

    It is the one of the least id (null last), of one id's texts that of the least
    digest, of equal rows one. Texts that nothing links stay even if they share an id;
    texts without words, null ones too, all stay.
    """
    return ngram_join.one_of_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data gives way to its kind in brackets.

    No row goes; null and empty texts stay as they are; n_chars follows the text.
    """
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the target weights take it.

    A null source is a source of its own; texts without words are taken 0 times and go;
    ties in the order fall to id and size; at most one document a source is cut.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token sequences of neighbouring documents.

    An empty or null text is its closing id; repeated rows are packed as often as they
    occur, whatever their ids.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Trees and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
