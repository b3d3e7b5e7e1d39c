"""Joins on order instead of equality, without comparing every pair."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPREAD = 1024  # places for rows that match nothing

def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], slices: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the latest right row of its key that is no later.

    One shuffle by key of the union of both sides; a running last value does the
    rest, so no pair of rows is ever made. Among right rows of one time the one
    with the largest values wins. Left rows without a match get nulls; null keys
    and null times match nothing, as in SQL, and gather nowhere. Values must not be
    named as left's columns.

    A key with more rows than a task can sort needs slices: what part of time a time
    lies in (``F.year``, say), never falling as time goes on. Rows are then dealt by
    key and slice, and each slice inherits the last value of those before it, of
    which only one row a key and slice is shuffled.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    keys = [f"key_{i}" for i in range(len(on))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]
    carried, row = (F.struct(*(F.col(f"`{c}`") for c in columns)) for columns in (values, left.columns))
    kinds = right.select(carried.alias("x")).schema["x"].dataType, left.select(row.alias("x")).schema["x"].dataType
    # Left rows that match nothing are spread; right rows have no spread, so they never meet.
    nothing = reduce(or_, (F.col(f"`{c}`").isNull() for c in (*on, left_time)))
    spread = F.when(nothing, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    marked_left = left.select(*named, F.col(f"`{left_time}`").alias("time"), F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("value"), row.alias("row"), spread.alias("spread"))
    marked_right = right.dropna(subset=[*on, right_time]).select(*named, F.col(f"`{right_time}`").alias("time"), F.lit(0).alias("side"), carried.alias("value"), F.lit(None).cast(kinds[1]).alias("row"), F.lit(None).cast("long").alias("spread"))
    both = marked_left.unionByName(marked_right)
    dealt = [*keys, "spread"]
    if slices:
        both, dealt = both.withColumn("slice", slices(F.col("time"))), [*dealt, "slice"]
    order = W.partitionBy(*dealt).orderBy("time", "side", "value").rowsBetween(W.unboundedPreceding, 0)
    joined = both.withColumn("last", F.last("value", ignorenulls=True).over(order)).where("side = 1")
    if slices:
        latest = F.max(F.when(F.col("side") == 0, F.struct("time", "value"))).alias("latest")
        ahead = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        each = both.where("spread IS NULL").groupBy(*keys, "slice").agg(latest)
        each = each.select(*(F.col(c).alias(f"each_{c}") for c in (*keys, "slice")), F.last("latest", ignorenulls=True).over(ahead)["value"].alias("inherited"))
        joined = joined.join(each, reduce(and_, (F.col(c) == F.col(f"each_{c}") for c in (*keys, "slice"))), "left")
        joined = joined.withColumn("last", F.coalesce("last", "inherited"))
    return joined.select("row.*", *(F.col("last")[v].alias(v) for v in values))


def range_join(points: DataFrame, intervals: DataFrame, point: Column, low: Column, high: Column, width: int) -> DataFrame:
    """All (point, interval) rows with low <= point < high, for whole numbers.

    Both sides are cut into bins of the given width and joined by bin, so an
    interval is copied once for each bin that it covers. A null point or end
    matches nothing.
    """
    name = "bin"
    while name in {c.lower() for c in (*points.columns, *intervals.columns)}:
        name += "_"
    binned = intervals.where(low < high).withColumn(name, F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width))))
    return points.withColumn(name, F.floor(point / width)).join(binned, name).where((point >= low) & (point < high)).drop(name)
