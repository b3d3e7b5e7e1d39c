"""Joins of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.tables import event_stream
from tidemill.streaming.windows import DELAY, run_once


def followed_by(first: DataFrame, second: DataFrame, key: str, within: str, delay: str = DELAY, how: str = "left") -> DataFrame:
    """key, first_ts, second_ts (and the other columns, prefixed alike): rows of two streams of one key, the second after the first, at most ``within`` later.

    Both sides' watermarks bound what is held: a first row goes once no second row in
    its reach can come any more, and with ``how`` left it then comes out alone if it
    met none. The watermark is that of the slower stream. Null keys meet nothing.
    """
    sides = []
    for side, rows in (("first", first), ("second", second)):
        sides.append(rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)).withWatermark(f"{side}_ts", delay))
    near = (F.col(f"first_{key}") == F.col(f"second_{key}")) & (F.col("second_ts") > F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    joined = sides[0].join(sides[1], near, {"left": "leftOuter", "inner": "inner"}[how])
    return joined.withColumnRenamed(f"first_{key}", key).drop(f"second_{key}")


def views_and_purchases(events: DataFrame, within: str = "6 HOURS") -> DataFrame:
    kind = lambda name: events.where(F.col("event_type") == name).select("user_id", "event_id", "ts")
    pairs = followed_by(kind("view"), kind("purchase"), "user_id", within)
    return pairs.select("user_id", F.col("first_event_id").alias("view"), F.col("second_event_id").alias("purchase"))


def stream_view_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the six hours after them; views without one once that is certain."""
    return run_once(views_and_purchases(event_stream(spark, sf_dir)), "views")


QUERIES = {f.__name__: f for f in (stream_view_to_purchase,)}

ORACLE_SQL = {
    "stream_view_to_purchase": """
WITH v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM v), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS mark)
SELECT v.user_id, v.event_id AS view, p.event_id AS purchase FROM v LEFT JOIN p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR
WHERE p.event_id IS NOT NULL OR v.ts + INTERVAL 6 HOUR < (SELECT mark FROM w)""",
}
