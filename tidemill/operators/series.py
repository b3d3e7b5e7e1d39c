"""Rolling sums and filled gaps: rows of a key in the order of a whole-number time.

Both cut a key's rows into slices of time, whose tasks need one row from the slices
around them. A key of a third of all rows is so spread over as many tasks as it has
slices, and a slice has at most twice as many rows as times, as rows of one time are
added up before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 1 << 20  # times of a slice
CELLS = 4096  # grid times that one row becomes at once


def _named(rows: DataFrame, on: Sequence[str], time: str, value: str, kind: str) -> tuple[DataFrame, list[str]]:
    """on's columns as key 0, key 1, ..., time and value; and the keys' names."""
    keys = [f"key {i}" for i in range(len(on))]
    named = (F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True))
    return rows.select(*named, F.col(f"`{time}`").cast("long").alias("time"), F.col(f"`{value}`").cast(kind).alias("value")).dropna(subset=["time"]), keys


def _slice(span: int) -> Column:
    """The first time of a time's slice."""
    return F.col("time") - F.pmod("time", F.lit(span))


def _out(rows: DataFrame, on: Sequence[str], keys: Sequence[str], time: str, others: dict[str, Column]) -> DataFrame:
    if clash := {c.lower() for c in (*on, time)} & set(others):
        raise ValueError(f"columns of the result, too: {sorted(clash)}")
    return rows.select(*(F.col(k).alias(c) for k, c in zip(keys, on, strict=True)), F.col("time").alias(time), *(x.alias(name) for name, x in others.items()))


def rolling_sums(rows: DataFrame, on: Sequence[str], time: str, amount: str, width: int, span: int = SPAN) -> DataFrame:
    """on..., time, n, total: for each key and time that has rows, rows and amounts of the times in (time - width, time].

    That is a RANGE frame of ``width - 1 PRECEDING``, one row for all rows of a time.
    Amounts are whole numbers. A null amount counts in n only; total is null without
    amounts; null keys are a key of their own, as in a window; rows without a time
    have no place and are left out.

    An amount enters at its time and leaves ``width`` later, so a running sum of both
    is the rolling one: each row is touched twice, however many a frame has. Slices
    carry the sums of those before them as one row.
    """
    cut, keys = _named(rows, on, time, amount, "long")
    parts = ("n", "known", "total")
    each = cut.groupBy(*keys, "time").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))
    enters = F.struct("time", *parts, F.lit(True).alias("own"))
    leaves = F.struct((F.col("time") + width).alias("time"), *((-F.col(c)).alias(c) for c in parts), F.lit(False).alias("own"))
    steps = each.select(*keys, F.explode(F.array(enters, leaves)).alias("step")).select(*keys, "step.*").withColumn("slice", _slice(span))
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy(*keys, "slice").agg(*(F.sum(c).alias(c) for c in parts))
    carried = sums.select(*keys, F.col("slice").alias("time"), *(F.sum(c).over(before).alias(c) for c in parts), F.lit(False).alias("own"), "slice").dropna(subset=["n"])
    so_far = W.partitionBy(*keys, "slice").orderBy("time").rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = steps.unionByName(carried).select(*keys, "time", "own", *(F.sum(c).over(so_far).alias(c) for c in parts)).where("own")
    return _out(summed, on, keys, time, {"n": F.col("n"), "total": F.when(F.col("known") > 0, F.col("total"))})


def filled_gaps(rows: DataFrame, on: Sequence[str], time: str, value: str, step: int, span: int = SPAN) -> DataFrame:
    """on..., time, value, known: each multiple of step from a key's first known time to its last, on the line between its neighbours.

    known tells the times that had a value, which they keep. Null and non-finite values
    are unknown and are filled; of several values of one time the largest counts; a key
    without any has no rows. Null keys are a key of their own; rows without a time have
    no place.

    Only known rows are sorted. Each then becomes the grid times up to the next known
    one, so the last and next value are at hand; the last row of a slice finds its next
    in one row from the slice behind it. A gap of more than CELLS times is first cut
    into pieces, which are dealt to tasks.
    """
    cut, keys = _named(rows, on, time, value, "double")
    finite = F.abs("value") < float("inf")  # NaN is above all
    each = cut.where(finite).groupBy(*keys, "time").agg(F.max("value").alias("value")).withColumn("slice", _slice(span))
    point = F.struct("time", "value")
    firsts = each.groupBy(*keys, "slice").agg(F.min(point).alias("first"))
    behind = firsts.select(*keys, "slice", F.lead("first").over(W.partitionBy(*keys).orderBy("slice")).alias("first")).where("first IS NOT NULL")
    marked = each.withColumn("own", F.lit(True)).unionByName(behind.select(*keys, "first.*", "slice", F.lit(False).alias("own")))
    known = marked.withColumn("next", F.lead(point).over(W.partitionBy(*keys, "slice").orderBy("time"))).where("own")
    end = F.coalesce(F.col("next.time") - 1, F.col("time"))
    ranges = known.select(*keys, "time", "value", "next", (F.col("time") + F.pmod(-F.col("time"), F.lit(step))).alias("from"), (end - F.pmod(end, F.lit(step))).alias("to")).where(F.col("from") <= F.col("to"))
    wide = F.col("to") - F.col("from") >= CELLS * step
    pieces = ranges.where(wide).withColumn("from", F.explode(F.sequence("from", "to", F.lit(CELLS * step)))).repartition(*keys, "from")
    pieces = pieces.withColumn("to", F.least("to", F.col("from") + (CELLS - 1) * step))
    cells = ranges.where(~wide).unionByName(pieces).withColumn("at", F.explode(F.sequence("from", "to", F.lit(step))))
    slope = (F.col("next.value") - F.col("value")) * (F.col("at") - F.col("time")).cast("double") / (F.col("next.time") - F.col("time")).cast("double")
    is_known = F.col("at") == F.col("time")
    found = cells.select(*keys, F.when(is_known, F.col("value")).otherwise(F.col("value") + slope).alias("value"), is_known.alias("known"), F.col("at").alias("time"))
    return _out(found, on, keys, time, {"value": F.col("value"), "known": F.col("known")})
