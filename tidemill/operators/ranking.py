"""Ranking within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order, with their rank.

    Spark limits each group before the shuffle, as the rank is only compared.
    """
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, session_start, session_end, n_events: runs of events less than a gap apart."""
    grouped = events.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n_events"))
    return grouped.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
