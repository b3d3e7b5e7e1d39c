"""Interval and skew-split joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators.intervals import overlap_join, overlap_totals, skew_join
from tidemill.operators.rollups import daily_states, read_off, rolled_up


def intervals(rng, n, keys):
    ends = lambda: rng.choice([None, *(rng.randrange(-500, 500) for _ in range(9))])
    rows = [(i, rng.choice(keys), ends(), ends()) for i in range(n)]
    return rows + [(n, keys[0], -10**12, 10**12), (n + 1, keys[0], 5, 5), (n + 2, keys[0], 7, 8), (n + 3, keys[0], -1, 0)]


def met(a, b, keyed):
    return None not in (a[2], a[3], b[2], b[3]) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] and (not keyed or a[1] is not None and a[1] == b[1])


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("per_place", [1 << 18, 7])
def test_overlap_join_finds_every_pair_once(spark, keyed, per_place):
    rng = random.Random(4)
    rows = [intervals(rng, 120, ["x", "x", "y", None]), intervals(rng, 90, ["x", "y", None])]
    left, right = (spark.createDataFrame(r, "id long, `k y` string, low long, high long") for r in rows)
    pairs = overlap_join(left, right.withColumnsRenamed({"low": "bin", "high": "part"}), ("low", "high"), ("bin", "part"), ["k y"] if keyed else [], per_place)
    found = sorted((r["left"]["id"], r["right"]["id"]) for r in pairs.collect())
    assert found == sorted((a[0], b[0]) for a in rows[0] for b in rows[1] if met(a, b, keyed)) and len(found) > 400


def test_overlap_join_of_one_over_all_makes_few_copies(spark):
    """One interval of 2**40 over 20,000 short ones: no row is copied by length, and the pairs come from several tasks."""
    long = spark.createDataFrame([(0, 1 << 40)], "low long, high long")
    short = spark.range(20_000).select((F.col("id") * 50_000_000).alias("low"), (F.col("id") * 50_000_000 + 9).alias("high"))
    pairs = overlap_join(short, long, ("low", "high"), ("low", "high"), per_place=1000)
    assert pairs.count() == 20_000
    own = pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert overlap_join(long, long.limit(0), ("low", "high"), ("low", "high")).count() == 0 and len(own) >= 1


def rows_shuffled(plan):
    """Of an executed plan, the rows that its exchanges wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return rows_shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(rows_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_overlap_join_copies_rows_by_full_bins_only(spark):
    """20,000 keys of two rows: many times per_place in all, but no bin is full, so no row is copied to parts."""
    rows = spark.range(40_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 700).alias("low"), (F.col("id") % 700 + 100).alias("high")).localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = overlap_join(rows, rows, ("low", "high"), ("low", "high"), ["k"], per_place=400)
        found = len(pairs.select("left.k").collect())
        joined = pairs.select(F.hash("left", "right"))
        joined.collect()
        shuffled = rows_shuffled(joined._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    low = {k: [i % 700 for i in (k, k + 20_000)] for k in range(20_000)}
    assert found == sum(abs(a - b) < 100 for two in low.values() for a in two for b in two)
    assert 0 < shuffled < 20 * 40_000


@pytest.mark.parametrize("per_task", [1 << 20, 5])
def test_overlap_totals_are_those_of_all_pairs(spark, per_task):
    rng = random.Random(8)
    left, right = intervals(rng, 150, ["x"]), [*intervals(rng, 90, ["x"]), (200, "x", 10**9, 10**9 + 5), (201, "x", 5, 6), (201, "x", 5, 6)]
    frames = [spark.createDataFrame(r, "id long, `k y` string, low long, high long") for r in (left, right)]
    found = overlap_totals(frames[0], frames[1].withColumnsRenamed({"low": "bin", "high": "part"}), ("low", "high"), ("bin", "part"), "id", per_task)
    assert found.columns == ["id", "k y", "bin", "part", "n", "least"]
    wanted = [(b[0], len(own), min(own)) for b in right if (own := [a[0] for a in left if met(a, b, False)])]
    assert sorted((r["id"], r["n"], r["least"]) for r in found.collect()) == sorted(wanted) and len(wanted) > 20
    assert overlap_totals(frames[0].limit(0), frames[0], ("low", "high"), ("low", "high"), "id").count() == 0


def test_overlap_totals_make_no_pairs(spark):
    """4,000,000,000 meetings, which no join by pairs gets through in a test."""
    left = spark.range(200_000).select("id", (F.col("id") % 5000).alias("low"), (F.col("id") % 5000 + 4000).alias("high"))
    right = spark.range(20_000).select((F.col("id") % 100 + 4000).alias("low"), (F.col("id") % 100 + 5000).alias("high"))
    found = overlap_totals(left, right, ("low", "high"), ("low", "high"), "id").groupBy("low").agg(F.count("*").alias("rows"), F.min("n").alias("n"), F.max("n").alias("most"), F.min("least").alias("least")).collect()
    assert {r["low"]: (r["rows"], r["n"], r["most"], r["least"]) for r in found} == {b: (200, 40 * (5000 - max(0, b - 3999)), 40 * (5000 - max(0, b - 3999)), max(0, b - 3999)) for b in range(4000, 4100)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_the_plain_join(spark, how):
    rng = random.Random(5)
    left = [(rng.choice([1, 1, 1, 2, 3, None, rng.randrange(50)]), rng.choice("ab"), i) for i in range(900)]
    right = [(k, rng.choice("ab"), f"v{i}") for i, k in enumerate([1, 1, 2, 3, None, *range(40)])]
    a, b = spark.createDataFrame(left, "k int, part string, n int"), spark.createDataFrame(right, "k int, part string, v string")
    found = skew_join(a, b, ["k", "part"], how, per_task=40, buckets=8)
    plain = a.join(b, ["k", "part"], how)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError, match="full"):
        skew_join(a, b, ["k"], "full")


def test_skew_join_spreads_a_key_of_a_third_of_all_rows(spark):
    """The hot key's rows lie in many partitions, none with more than a fraction of them."""
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(60_000).select((F.col("id") - 1).alias("k"), F.lit("x").alias("v"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for name, value in zip(before, ("32", "false", "-1"), strict=True):
            spark.conf.set(name, value)
        joined = skew_join(left, right, ["k"], per_task=500)
        sizes = [r["count"] for r in joined.where("k = -1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 20_000 and len(sizes) >= 16 and max(sizes) < 4_000


def test_daily_states_merge_to_what_the_rows_say(spark):
    rng = random.Random(6)
    rows = [(f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02}", rng.choice("ab"), rng.choice([None, rng.randrange(10_000)]), rng.choice([None, rng.randrange(3000)])) for _ in range(20_000)]
    table = spark.createDataFrame(rows, "d string, g string, amount long, who long")
    states = daily_states(table, F.col("d"), ["g"], F.col("amount"), F.col("who")).cache()
    assert states.count() == len({(d, g) for d, g, *_ in rows})
    by_month = rolled_up(states, ["g", F.month("day").alias("m")])
    for merged in (read_off(by_month, (0.1, 0.5, 0.9)), read_off(rolled_up(by_month, ["g", "m"]), (0.1, 0.5, 0.9))):
        for r in merged.collect():
            own = [x for x in rows if x[1] == r["g"] and int(x[0][5:7]) == r["m"]]
            amounts = sorted(x[2] for x in own if x[2] is not None)
            assert (r["n"], r["total"], r["least"], r["most"]) == (len(own), sum(amounts), amounts[0], amounts[-1])
            exact = len({x[3] for x in own if x[3] is not None})
            assert abs(r["distinct"] - exact) <= 0.06 * exact
            for q in (10, 50, 90):
                rank = sum(a <= r[f"q{q}"] for a in amounts) / len(amounts)
                assert abs(rank - q / 100) < 0.04
    none = read_off(rolled_up(daily_states(table.where("d = '2024-01-01'").withColumn("amount", F.lit(None).cast("long")), F.col("d"), [], F.col("amount"), F.col("who")), ["day"])).collect()
    assert none[0]["q50"] is None and none[0]["total"] is None and none[0]["n"] > 0
    assert read_off(rolled_up(states.where("false"), ["g"])).count() == 0
