"""Aggregates that are kept by day and rolled up without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # of the distinct sketch: 2**LG_K registers, about 1.6 % standard error
KLL_K = 200  # of the quantile sketch: ranks within about 1.7 %


def daily_states(rows: DataFrame, time: Column, by: Sequence[str], amount: Column, distinct: Column) -> DataFrame:
    """day, by..., n, total, least, most, and sketches of the distinct values and of the amounts' quantiles.

    States of any days merge (:func:`rolled_up`); tables of them hold a row a day and
    group, whatever the rows. A null amount counts in n only, a null distinct value not
    at all. Counts and sums are exact.
    """
    cut = rows.select(time.cast("date").alias("day"), *by, amount.cast("long").alias("amount"), distinct.cast("string").alias("value"))
    return cut.groupBy("day", *by).agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("total"),
        F.min("amount").alias("least"),
        F.max("amount").alias("most"),
        F.hll_sketch_agg("value", LG_K).alias("values"),
        F.kll_sketch_agg_bigint("amount", KLL_K).alias("amounts"),
    )


def rolled_up(states: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """by..., n, total, least, most and the merged sketches of daily states, or of states rolled up before."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("values").alias("values"),
        F.kll_merge_agg_bigint("amounts").alias("amounts"),
    )


def read_off(states: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """states with numbers in the place of the sketches: distinct, and q<percent> for each quantile (null without amounts)."""
    empty = F.kll_sketch_get_n_bigint("amounts") == 0
    found = {f"q{round(100 * q)}": F.when(~empty, F.kll_sketch_get_quantile_bigint("amounts", F.lit(q))) for q in quantiles}
    return states.withColumns({"distinct": F.hll_sketch_estimate("values"), **found}).drop("values", "amounts")
