"""Joins on order, on small tables with ties, nulls and gaps."""

import random

from pyspark.sql import functions as F

from tidemill.operators.joins import as_of_join, range_join


def test_as_of_join_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("b", 9, 90)], "k string, u int, v int")
    rows = as_of_join(left, right, ["k"], "t", "u", ["v"]).collect()
    assert sorted((r["k"], r["t"], r["v"] or 0) for r in rows) == [("a", 1, 0), ("a", 5, 51), ("a", 5, 51), ("b", 5, 0)]


def test_range_join_finds_every_pair_once(spark):
    points = spark.range(100).withColumnRenamed("id", "p")
    bands = spark.createDataFrame([(0, 10), (5, 95), (50, 50), (99, 200)], "low long, high long")
    found = {tuple(r) for r in range_join(points, bands, F.col("p"), F.col("low"), F.col("high"), 7).collect()}
    wanted = {(p, a, b) for p in range(100) for a, b in ((0, 10), (5, 95), (50, 50), (99, 200)) if a <= p < b}
    assert found == wanted


def test_as_of_join_matches_no_nulls(spark):
    left = spark.createDataFrame([(None, 5), ("a", None), ("a", 5), ("b", 5)], "key_0 string, time int")
    right = spark.createDataFrame([(None, 1, 10), ("a", None, 20), ("a", 3, 30), ("b", None, 40)], "key_0 string, u int, v int")
    rows = as_of_join(left, right, ["key_0"], "time", "u", ["v"]).collect()
    assert sorted(((r["key_0"], r["time"], r["v"]) for r in rows), key=str) == [("a", 5, 30), ("a", None, None), ("b", 5, None), (None, 5, None)]


def test_as_of_join_by_slices_is_the_same(spark):
    rng = random.Random(3)
    times = lambda: rng.choice([None, *range(400)])
    left = spark.createDataFrame([(rng.choice(["hot", "hot", "b", "c", None]), times(), i) for i in range(600)], "k string, t int, id int")
    right = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), times(), rng.randrange(9)) for _ in range(60)], "k string, u int, v int")
    rows = right.where("k IS NOT NULL AND u IS NOT NULL").collect()
    wanted = {r["id"]: max(((o["u"], o["v"]) for o in rows if o["k"] == r["k"] and r["t"] is not None and o["u"] <= r["t"]), default=(0, None))[1] for r in left.collect()}
    for slices in (None, lambda t: F.floor(t / 7), lambda t: t >= 200):
        found = as_of_join(left, right, ["k"], "t", "u", ["v"], slices)
        assert found.columns == ["k", "t", "id", "v"] and {r["id"]: r["v"] for r in found.collect()} == wanted and found.count() == 600


def test_range_join_keeps_columns_of_any_name(spark):
    points = spark.createDataFrame([(1, "x"), (None, "y")], "p long, bin string")
    bands = spark.createDataFrame([(0, 5, 7), (None, 9, 8), (3, 1, 9)], "low long, high long, bin_ int")
    found = range_join(points, bands, F.col("p"), F.col("low"), F.col("high"), 2)
    assert found.columns == ["p", "bin", "low", "high", "bin_"] and [tuple(r) for r in found.collect()] == [(1, "x", 0, 5, 7)]


def test_funnel_takes_the_click_after_the_view(spark, tmp_path):
    from tidemill.plans import events

    steps = {1: "cvcp", 2: "vpc", 3: "cp", 4: "vv", 5: "vccp", 6: "", 7: "cpv"}
    kinds = {"v": "view", "c": "click", "p": "purchase"}
    rows = [(user, f"2024-01-0{1 + i}", kinds[k]) for user, path in steps.items() for i, k in enumerate(path)]
    spark.createDataFrame(rows, "user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r["step"]: r["users"] for r in events.user_funnel(spark, str(tmp_path)).collect()} == {3: 2, 2: 1, 0: 1, 1: 2}


def test_streams_drop_late_and_repeated_rows(spark, tmp_path):
    """Files of several batches, out of order: copies count once, rows behind the watermark not at all."""
    import os
    import time

    from tidemill.sources.tables import EVENTS, event_stream
    from tidemill.streaming import windows

    batches = [[(1, "10:05"), (2, "10:20"), (2, "10:20")], [(3, "11:40"), (1, "10:05"), (4, "11:10")], [(6, "11:45"), (7, "14:00")], [(5, "10:30"), (8, "14:30")]]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(n, f"2024-01-01 {t}:00", 1, "view", 1.0, "{}") for n, t in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
        made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*EVENTS.names).coalesce(1).toPandas().to_parquet(f"{tmp_path}/{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{tmp_path}/{i}.parquet", (time.time() + i, time.time() + i))
    stream = event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1)
    found = {(r["hour"].hour, r["n"]) for r in windows.run_once(windows.hourly_counts(windows.distinct_events(stream), delay=None), "late").collect()}
    assert found == {(10, 2), (11, 3)}
    sessions = {(r["session_start"].strftime("%H:%M"), r["n_events"]) for r in windows.run_once(windows.user_sessions(event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1)), "late-sessions").collect()}
    assert ("10:05", 4) in sessions and not any(start == "14:00" for start, _ in sessions)


def test_shared_folder_is_never_local_on_a_cluster(spark):
    import pytest

    from tidemill.sources import folders

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        folders.shared_dir(Elsewhere)
    path = folders.new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    folders.remove_folder(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    from tidemill.sources.folders import new_folder
    from tidemill.sources.tables import write_bucketed

    rng = random.Random(8)
    left = [(rng.choice([None, *range(60)]), i) for i in range(300)]
    right = [(rng.choice([None, *range(60)]), f"v{i}") for i in range(200)]
    a = write_bucketed(spark.createDataFrame(left, "`a k` long, n long"), "bucketed_left", new_folder(spark, "left"), ["a k"], 8)
    b = write_bucketed(spark.createDataFrame(right, "k long, v string"), "bucketed_right", new_folder(spark, "right"), ["k"], 8)
    none = write_bucketed(spark.createDataFrame([], "k long, w string"), "bucketed_none", new_folder(spark, "none"), ["k"], 8)
    joined = a.join(b.hint("merge"), F.col("a k") == F.col("k"))
    grouped = joined.groupBy("k").agg(F.count("*").alias("pairs"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert sorted((r["n"], r["v"]) for r in joined.collect()) == sorted((n, v) for k, n in left for q, v in right if k is not None and k == q)
    assert a.count() == 300 and a.join(none.hint("merge"), F.col("a k") == none["k"], "left").count() == 300
    for name in ("bucketed_left", "bucketed_right", "bucketed_none"):
        spark.sql(f"DROP TABLE {name}")
