"""Streams over files, folders and restarts, against the batch results."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemill.plans import events as batch
from tidemill.sources.folders import new_folder
from tidemill.sources.tables import EVENTS, event_stream
from tidemill.streaming import funnel, joins, upsert, windows

KINDS = ("view", "click", "purchase", "error")


def made(spark, rows):
    """rows of id, minute, user, kind as events."""
    table = spark.createDataFrame([(i, m, u, k) for i, m, u, k in rows], "event_id long, minute double, user_id long, event_type string")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minute") * 60).cast("timestamp_ntz")
    return table.select("event_id", ts.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props")).select(*EVENTS.names)


def random_rows(seed=1, n=400, users=9):
    rng = random.Random(seed)
    return [(i, rng.randrange(60_000) / 10, rng.choice([*range(users), 0, 0, 0]), rng.choice(KINDS)) for i in range(n)]


def in_files(spark, rows, folder, parts, late=0):
    """Files in the order of time, each shuffled; ``late`` minutes of disorder between files."""
    rng = random.Random(2)
    rows = sorted(rows, key=lambda r: r[1] + rng.uniform(0, late))
    for i in range(parts):
        own = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        rng.shuffle(own)
        made(spark, own).coalesce(1).toPandas().to_parquet(f"{folder}/{i:03}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{folder}/{i:03}.parquet", (time.time() + i, time.time() + i))


@pytest.mark.parametrize("name", ["stream_hourly_events", "stream_distinct_events", "stream_user_sessions", "stream_view_to_purchase", "stream_user_funnel", "stream_latest_events"])
def test_a_file_and_a_folder_of_part_files_give_the_same(spark, tmp_path, name):
    query = {**windows.QUERIES, **joins.QUERIES, **funnel.QUERIES, **upsert.QUERIES}[name]
    table = made(spark, random_rows())
    os.makedirs(tmp_path / "one")
    table.toPandas().to_parquet(tmp_path / "one/events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    table.repartition(11).write.parquet(f"{tmp_path}/many/events.parquet")
    rows = [sorted(map(str, query(spark, f"{tmp_path}/{d}").collect())) for d in ("one", "many")]
    assert rows[0] == rows[1] and rows[0]


def test_a_stream_without_files_is_an_error(spark, tmp_path):
    os.makedirs(tmp_path / "events.parquet")
    for files in (None, "*.json"):
        with pytest.raises(Exception, match="no files of events|Path does not exist|PATH_NOT_FOUND"):
            event_stream(spark, str(tmp_path), files)
    with pytest.raises(Exception, match="no files of events|PATH_NOT_FOUND"):
        event_stream(spark, str(tmp_path / "nowhere"))


def pairs(rows, minutes, mark):
    out = []
    for i, m, u, k in rows:
        if k == "view":
            hits = [j for j, n, v, kind in rows if kind == "purchase" and v == u and m < n <= m + minutes]
            out += [(u, i, j) for j in hits] or ([(u, i, None)] if m + minutes < mark else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_stream_join_is_the_batch_join_on_disordered_files(spark, tmp_path, parts):
    rows = random_rows(3)
    in_files(spark, rows, tmp_path, parts, late=9)
    stream = event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1)
    found = windows.run_once(joins.views_and_purchases(stream), "pairs").collect()
    mark = min(max(m for _, m, _, k in rows if k == kind) for kind in ("view", "purchase")) - 10
    assert sorted(((r["user_id"], r["view"], r["purchase"]) for r in found), key=str) == pairs(rows, 360, mark)


def test_stream_join_leaves_rows_behind_the_watermark_out(spark, tmp_path):
    first = [(0, 10.0, 1, "view"), (1, 900.0, 1, "view"), (2, 900.0, 1, "purchase")]
    between = [(6, 901.0, 2, "error")]
    late = [(3, 20.0, 1, "purchase"), (4, 1800.0, 1, "view"), (5, 1800.0, 1, "purchase")]
    for i, rows in enumerate((first, between, late)):
        made(spark, rows).coalesce(1).toPandas().to_parquet(f"{tmp_path}/{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{tmp_path}/{i}.parquet", (time.time() + i, time.time() + i))
    found = windows.run_once(joins.views_and_purchases(event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1)), "late-pairs").collect()
    assert sorted((r["view"], r["purchase"]) for r in found) == [(0, None), (1, None)]


def steps_by_hand(rows, mark):
    out = {}
    for user in {r[2] for r in rows}:
        step, since = 0, -1.0
        for m, kind in sorted((m, k) for _, m, u, k in rows if u == user and m <= mark):
            if step < 3 and kind == KINDS[step] and m > since:
                step, since = step + 1, m
        if step:
            out[user] = step
    return out


def run_funnel(spark, stream, out, state):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return {r["user_id"]: r["step"] for r in spark.read.parquet(out).groupBy("user_id").agg(F.max("step").alias("step")).collect()}


def test_funnel_state_survives_a_restart(spark, tmp_path):
    """Files out of order, in two runs from one checkpoint; the machine equals a plain walk over the same rows."""
    rows = random_rows(5, 500)
    os.makedirs(tmp_path / "in")
    os.makedirs(tmp_path / "later")
    in_files(spark, rows, tmp_path / "later", 8, late=9)
    out, state = new_folder(spark, "funnel-out"), new_folder(spark, "funnel-state")
    for run in (range(3), range(3, 8)):
        for i in run:
            os.rename(tmp_path / f"later/{i:03}.parquet", tmp_path / f"in/{i:03}.parquet")
        found = run_funnel(spark, funnel.funnel_steps(event_stream(spark, str(tmp_path / "in"), "*.parquet", per_trigger=1)), out, state)
    mark = max(m for _, m, _, k in rows if k in funnel.STEPS) - 10
    assert found == steps_by_hand(rows, mark)
    assert spark.read.parquet(out).groupBy("user_id", "step").count().where("count > 1").count() == 0


def test_users_share_calls_of_the_funnel(spark, tmp_path):
    """600 users in 3 blocks: a call and a row of state for a block, and each user's own steps."""
    rows = random_rows(9, 3000, users=600)
    in_files(spark, rows, tmp_path, 2, late=9)
    out, state = new_folder(spark, "blocks-out"), new_folder(spark, "blocks-state")
    stream = funnel.funnel_steps(event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1), blocks=3)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 3
    found = {r["user_id"]: r["step"] for r in spark.read.parquet(out).groupBy("user_id").agg(F.max("step").alias("step")).collect()}
    assert found == steps_by_hand(rows, max(m for _, m, _, k in rows if k in funnel.STEPS) - 10) and len(found) > 300


def test_idle_users_are_forgotten(spark, tmp_path):
    rows = [[(0, 0.0, 1, "view"), (1, 1.0, 1, "click")], [(2, 300.0, 2, "view")], [(3, 600.0, 2, "click")], [(4, 700.0, 1, "purchase"), (5, 710.0, 1, "view")], [(6, 900.0, 2, "purchase")]]
    for i, own in enumerate(rows):
        made(spark, own).coalesce(1).toPandas().to_parquet(f"{tmp_path}/{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{tmp_path}/{i}.parquet", (time.time() + i, time.time() + i))
    steps = lambda idle: sorted((r["user_id"], r["step"]) for r in windows.run_once(funnel.funnel_steps(event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1), idle_ms=idle), "idle").collect())
    assert steps(None) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert steps(60 * 60_000) == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_upserts_can_be_broken_off_and_run_again(spark, tmp_path):
    """A batch that fails after it has written is run again; a batch that is merged twice changes nothing."""
    rows = random_rows(7, 300)
    in_files(spark, rows, tmp_path, 5)
    path, state = new_folder(spark, "upsert"), new_folder(spark, "upsert-state")
    table = upsert.UpsertTable(spark, path, "user_id long, ts timestamp, event_id long, event_type string", ["user_id"], "ts", buckets=4)
    fail = {2}

    def merge(frame, batch):
        table.merge(frame, batch)
        if batch in fail:
            fail.discard(batch)
            raise RuntimeError("cut off")

    start = lambda: event_stream(spark, str(tmp_path), "*.parquet", per_trigger=1).writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="cut off"):
        start().awaitTermination()
    start().awaitTermination()
    wanted = {}
    for i, m, u, k in rows:
        wanted[u] = max(wanted.get(u, (-1.0, -1)), (m, i))
    assert {r["user_id"]: r["event_id"] for r in table.read().collect()} == {u: i for u, (_, i) in wanted.items()}
    before = sorted(map(str, table.read().collect()))
    again = made(spark, rows[:40]).withColumn("ts", F.col("ts").cast("timestamp"))
    last = table.complete()[-1]
    for _ in range(2):
        table.merge(again, last + 1)
        assert sorted(map(str, table.read().collect())) == before
    assert len(table.complete()) == 6
    none = upsert.UpsertTable(spark, new_folder(spark, "none"), "k long, v long", ["k"], "v")
    assert none.read().count() == 0
    none.merge(spark.createDataFrame([(None, 1), (None, 2), (3, None)], "k long, v long"), 0)
    assert sorted(map(str, none.read().collect())) == ["Row(k=3, v=None)", "Row(k=None, v=2)"]


def test_dirty_urls_numbers_and_amounts(spark, tmp_path):
    from tidemill.functions.expressions import cents

    urls = ["http://a b/c", "https://ok.example.com/x?q=1", None, "http://%zz/", "nonsense", "http://x.example.com/<y>"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["host"]: (r["pages"], r["secure"], r["with_query"]) for r in batch.pages_by_host(spark, str(tmp_path)).collect()} == {None: (5, 0, 0), "ok.example.com": (1, 1, 1)}
    props = ['{"k": 5}', '{"k":"x"}', "{", None, '{"k": 1e99}', "[]"]
    made(spark, [(i, 1.0, 1, "view") for i in range(len(props))]).withColumn("props", F.element_at(F.array(*map(F.lit, props)), (F.col("event_id") + 1).cast("int"))).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["k"], r["n"]) for r in batch.event_props(spark, str(tmp_path)).collect()] == [(5, 1)]
    amounts = spark.createDataFrame([(x,) for x in (1.005, -2.5, float("nan"), float("inf"), -float("inf"), 1e300, None)], "a double").select(cents(F.col("a")).alias("c"))
    assert [r["c"] for r in amounts.collect()] == [100, -250, None, None, None, None, None]
