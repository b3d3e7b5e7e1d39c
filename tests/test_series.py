"""Rolling sums and filled gaps against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import series
from tidemill.operators.series import filled_gaps, rolling_sums


def some_rows(rng, n):
    times = lambda: rng.choice([None, *(rng.randrange(-60, 60) for _ in range(12))])
    return [(rng.choice(["hot", "hot", "b", None]), times(), rng.choice([None, rng.randrange(-50, 50)])) for _ in range(n)]


@pytest.mark.parametrize(("width", "span"), [(1, 4), (7, 4), (7, 1 << 20), (500, 16)])
def test_rolling_sums_are_the_range_frame(spark, width, span):
    rows = some_rows(random.Random(1), 400) + [("lone", 10**12, None), ("lone", -(10**12), 3)]
    table = spark.createDataFrame([(k, t, v, "x") for k, t, v in rows], "`a key` string, slice long, value long, own string")
    found = rolling_sums(table, ["a key"], "slice", "value", width, span)
    assert found.columns == ["a key", "slice", "n", "total"]
    wanted = set()
    for key, time in {(k, t) for k, t, _ in rows if t is not None}:
        frame = [v for k, t, v in rows if k == key and t is not None and time - width < t <= time]
        known = [v for v in frame if v is not None]
        wanted.add((key, time, len(frame), sum(known) if known else None))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_rolling_sums_of_all_rows_and_of_none(spark):
    table = spark.createDataFrame([(5, 1), (6, 2), (9, 4), (9, 4)], "t int, v int")
    assert sorted(tuple(r) for r in rolling_sums(table, [], "t", "v", 3, 2).collect()) == [(5, 1, 1), (6, 2, 3), (9, 2, 8)]
    assert rolling_sums(table.where("false"), [], "t", "v", 3).count() == 0
    with pytest.raises(ValueError, match="total"):
        rolling_sums(table.withColumnRenamed("v", "total"), ["total"], "t", "total", 3)


def test_a_hot_key_lies_in_many_tasks(spark):
    """One key of 40,000 times: no task sorts more than a few of its slices, and sums run on over them."""
    table = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for name, value in zip(before, ("16", "false"), strict=True):
            spark.conf.set(name, value)
        for found, sorted_for in ((rolling_sums(table, ["k"], "t", "v", 30_000, 256), "total"), (filled_gaps(table, ["k"], "t", "v", 1, 256), "value")):
            sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(sorted_for)).collect()]
            assert sum(sizes) == 40_000 and len(sizes) >= 14 and max(sizes) < 8_000
        gap = filled_gaps(spark.createDataFrame([(0, 0.0), (40_000_000, 1.0)], "t long, v double"), [], "t", "v", 100)
        sizes = [r["count"] for r in gap.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400_001 and len(sizes) >= 14 and max(sizes) < 80_000
        assert rolling_sums(table, ["k"], "t", "v", 30_000, 256).where(F.col("total") != F.least(F.col("t") + 1, F.lit(30_000))).count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def line(points, time):
    if time in points:
        return points[time], True
    low, high = max(t for t in points if t < time), min(t for t in points if t > time)
    return points[low] + (points[high] - points[low]) * float(time - low) / float(high - low), False


@pytest.mark.parametrize(("step", "span"), [(1, 4), (5, 8), (7, 1 << 20)])
def test_filled_gaps_are_on_the_line(spark, monkeypatch, step, span):
    monkeypatch.setattr(series, "CELLS", 3)
    rng = random.Random(2)
    rows = [(k, t, rng.choice([None, float("nan"), float("inf"), v])) for k, t, v in some_rows(rng, 90)] + [("lone", 35, 1), ("odd", 36, 1), ("none", 0, None)]
    rows = [(k, t, None if v is None else float(v)) for k, t, v in rows]
    table = spark.createDataFrame(rows * 2, "`from` string, `to` long, next double")
    found = filled_gaps(table, ["from"], "to", "next", step, span)
    assert found.columns == ["from", "to", "value", "known"]
    wanted = set()
    for key in {k for k, *_ in rows}:
        points = {}
        for k, t, v in rows:
            if k == key and t is not None and v is not None and abs(v) < float("inf"):
                points[t] = max(v, points.get(t, v))
        wanted |= {(key, t, *line(points, t)) for t in range(min(points), max(points) + 1) if t % step == 0} if points else set()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_a_gap_of_years_is_cut_into_pieces(spark):
    """Two seconds are known, two years apart."""
    table = spark.createDataFrame([(0, 0.0), (63_072_000, 630.72)], "t long, v double")
    found = filled_gaps(table, [], "t", "v", 60)
    assert found.count() == 1_051_201 and found.where("known").count() == 2
    assert found.where(F.abs(F.col("value") - F.col("t") / 100_000) > 1e-9).count() == 0
    assert filled_gaps(table.where("false"), [], "t", "v", 60).count() == 0
