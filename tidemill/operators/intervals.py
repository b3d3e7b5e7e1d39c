"""Joins of intervals with intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 2  # a level's bins are 2**STEP times as wide as those of the level below
PER_PLACE = 1 << 18  # rows of one bin and key that meet in one task, about


def _level(low: Column, high: Column) -> Column:
    """The least level whose bins are as wide as the interval, so that it meets two of them at most."""
    return (F.ceil(F.log2((high - low).cast("double")) / STEP) * STEP).cast("int")


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _named(rows: DataFrame, low: str, high: str, on: Sequence[str], side: str) -> DataFrame:
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(side)
    keys = [F.col(f"`{c}`").alias(f"on {i}") for i, c in enumerate(on)]
    rows = rows.select(whole, F.col(f"`{low}`").cast("long").alias(f"{side} low"), F.col(f"`{high}`").cast("long").alias(f"{side} high"), *keys).where(F.col(f"{side} low") < F.col(f"{side} high")).dropna(subset=[f"on {i}" for i in range(len(on))] or None, how="any" if on else "all")
    return rows.withColumn("own level", _level(F.col(f"{side} low"), F.col(f"{side} high")))


def _bins(rows: DataFrame, side: str) -> DataFrame:
    """rows for each bin of ``at level`` that they meet; their ends are those in the side's struct."""
    level = F.col("at level")
    return rows.withColumn("bin", F.explode(F.sequence(_bin(F.col(f"{side} low"), level), _bin(F.col(f"{side} high") - 1, level)))).drop("own level", f"{side} low", f"{side} high")


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], on: Sequence[str] = (), per_place: int = PER_PLACE) -> DataFrame:
    """Every pair of rows whose intervals [low, high) of whole numbers share a point, once.

    Returns two columns, ``left`` and ``right``, structs of the sides' rows. With ``on``,
    columns of both sides, only rows of equal keys meet. Empty intervals, null ends and
    null keys match nothing. The sides are read several times, so they should be stored.

    Intervals live at a level by their length, in two bins of it at most. A pair meets at
    the level of its longer interval, so the shorter one is copied to the levels above
    its own that the other side has: a long interval costs two rows, not one a bin,
    and there are few levels. Of two bins that both share, the one where the later
    interval begins owns the pair.

    Where one long interval meets very many short ones, they share a bin. A bin's short
    ones, if over per_place, are dealt to parts of about that many, and its long ones are
    copied to each; all other rows are sent once a bin.
    """
    sides = {"left": _named(left, *left_ends, on, "left"), "right": _named(right, *right_ends, on, "right")}
    end = {(side, i): F.col(side).getField(name).cast("long") for side, names in (("left", left_ends), ("right", right_ends)) for i, name in enumerate(names)}
    place = ["at level", "bin", *(f"on {i}" for i in range(len(on)))]

    def met(long: str, short: str, equal: bool) -> DataFrame:
        """Pairs in which the first side's interval is of a higher level, or of an equal one too."""
        natives = _bins(sides[long].withColumn("at level", F.col("own level")), long)
        levels = sides[long].agg(F.collect_set("own level").alias("levels"))
        above = F.filter("levels", lambda x: x >= F.col("own level") if equal else x > F.col("own level"))
        copies = _bins(sides[short].crossJoin(F.broadcast(levels)).withColumn("at level", F.explode(above)).drop("levels"), short)
        later = F.greatest(end["left", 0], end["right", 0])
        owned = (F.col("bin") == _bin(later, F.col("at level"))) & (end["left", 0] < end["right", 1]) & (end["right", 0] < end["left", 1])
        return skew_join(copies, natives, place, per_task=per_place).where(owned).select("left", "right")

    return met("left", "right", True).unionByName(met("right", "left", False))


def _cut(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """rows for each of the bins that make up [low, high), two a level at most: a bin of ``at level`` is 2**level wide."""
    level = F.col("at level")
    least, end = -_bin(-low, level), _bin(high, level)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    ends = F.array(F.when(odd(least), least), F.when(odd(end), end - 1))
    rows = rows.where(low < high).withColumn("at level", F.explode(F.sequence(F.lit(0), F.length(F.bin(high - low)) - 1)))
    return rows.where(least < end).withColumn("bin", F.explode(F.filter(ends, lambda x: x.isNotNull())))


def _lying_in(points: DataFrame, x: Column, widest: DataFrame) -> DataFrame:
    """points for each bin that they lie in, up to the width of the widest interval."""
    rows = points.crossJoin(F.broadcast(widest)).withColumn("at level", F.explode(F.sequence(F.lit(0), F.col("widest")))).drop("widest")
    return rows.withColumn("bin", _bin(x, F.col("at level")))


def overlap_totals(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], least: str, per_task: int = 1 << 20) -> DataFrame:
    """right's rows with ``n``, how many of left's intervals [low, high) they meet, and ``least``, the least of a column of those.

    No pair is made, so the work grows with the rows and the logarithm of the lengths,
    however many meet. A left interval that meets [b, e) holds b or begins in
    [b + 1, e), and never both. Intervals are cut into bins of widths 2**level, two a
    level at most, and a point lies in one bin of each level, so it meets an interval in
    exactly one bin: left's rows are summed by bin, right's ask their bins for the sums.
    Rows of equal ends count as one until the end; a bin that very many ask is spread.
    Rows that meet nothing, empty intervals and null ends are left out.
    """
    low, high = F.col("low"), F.col("high")
    ends = lambda names: [F.col(f"`{c}`").cast("long").alias(a) for c, a in zip(names, ("low", "high"), strict=True)]
    width = F.length(F.bin(high - low)) - 1
    totals = (F.sum("n").alias("n"), F.min("least").alias("least"))
    spans = left.select(*ends(left_ends), F.col(f"`{least}`").alias("least")).where(low < high).groupBy("low", "high").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    asked = right.select(*ends(right_ends)).where(low < high).distinct()
    place = ["at level", "bin"]

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*place).agg(*totals)

    holding = skew_join(_lying_in(asked, low, spans.agg(F.coalesce(F.max(width), F.lit(0)).alias("widest"))), summed(_cut(spans, low, high)), place, per_task=per_task)
    begun = skew_join(_cut(asked, low + 1, high), summed(_lying_in(spans, low, asked.agg(F.coalesce(F.max(width), F.lit(0)).alias("widest")))), place, per_task=per_task)
    found = holding.select("low", "high", "n", "least").unionByName(begun.select("low", "high", "n", "least")).groupBy("low", "high").agg(*totals)
    names = ["asked low", "asked high"]
    rows = right.withColumns({a: F.col(f"`{c}`").cast("long") for a, c in zip(names, right_ends, strict=True)})
    return skew_join(rows, found.withColumnsRenamed({"low": names[0], "high": names[1]}), names, per_task=per_task).drop(*names)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", per_task: int = 1 << 20, buckets: int = 1 << 16) -> DataFrame:
    """left joined to right on equal columns (inner or left), with left's frequent keys spread over tasks.

    A count of left's keys by hash bucket finds the buckets of over per_task rows; only
    their keys are counted one by one. Each key of more rows is cut into parts of about
    per_task: left's rows are dealt to them, right's are copied to each. There are at
    most (rows / per_task) such keys, so they are broadcast; all other rows go as they
    would without. Null keys match nothing; those of left are spread as well.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"neither inner nor left: {how}")
    name = "part"
    while name in {c.lower() for c in (*left.columns, *right.columns)}:
        name += "_"
    keys = [F.col(f"`{c}`") for c in on]
    known = reduce(and_, (k.isNotNull() for k in keys))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    full = left.where(known).groupBy(bucket.alias("bucket")).count().where(F.col("count") > per_task).select("bucket")
    counted = left.where(known).withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi").groupBy(*keys).agg(F.count("*").alias("count"))
    hot = counted.where(F.col("count") > per_task).select(*(F.col(f"`{c}`").alias(f"hot {i}") for i, c in enumerate(on)), F.ceil(F.col("count") / per_task).cast("int").alias("hot parts"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(hot), reduce(and_, (k == F.col(f"hot {i}") for i, k in enumerate(keys))), "left")

    spread = F.pmod(F.monotonically_increasing_id(), F.when(known, F.coalesce("hot parts", F.lit(1))).otherwise(F.lit(1024))).cast("int")
    dealt = marked(left).select(*(F.col(f"`{c}`") for c in left.columns), spread.alias(name))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("hot parts", F.lit(1)) - 1))
    copied = marked(right.where(known)).select(*(F.col(f"`{c}`") for c in right.columns), copies.alias(name))
    return dealt.join(copied, [*on, name], how).drop(name)
