"""Windowed aggregation of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.folders import new_folder
from tidemill.sources.jsonlines import json_lines
from tidemill.sources.tables import event_stream, table, write_json_lines

DELAY = "10 minutes"


def hourly_counts(events: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """hour, event_type, n of a stream; an hour is final once the watermark passes it.

    Without a delay, the stream's own watermark holds.
    """
    marked = events.withWatermark("ts", delay) if delay else events
    grouped = marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def distinct_events(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The stream without later copies of an event, as far as the watermark remembers."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """user_id, session_start, session_end, n_events of a stream; a session is final once the watermark passes its end."""
    grouped = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return grouped.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events")


def run_once(stream: DataFrame, name: str, at_once: bool = True) -> DataFrame:
    """Run a stream over what is there now, into Parquet files, and read them.

    ``at_once`` is for sources that know that trigger; Spark gives others a single
    batch, behind which no window could end by the watermark.
    """
    spark = stream.sparkSession
    out = new_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, f"{name}-state")).outputMode("append")
    query = (writer.trigger(availableNow=True) if at_once else writer).start()
    try:
        if at_once:
            query.awaitTermination()
        else:
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def stream_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(hourly_counts(event_stream(spark, sf_dir)), "hourly")


def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = run_once(distinct_events(event_stream(spark, sf_dir)), "distinct")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def stream_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(user_sessions(event_stream(spark, sf_dir)), "sessions")


def stream_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events that arrive as line-delimited JSON."""
    path = write_json_lines(table(spark, sf_dir, "events"), new_folder(spark, "events-json"))
    events = json_lines(spark, path, "ts timestamp_ntz, event_type string", stream=True)
    return run_once(hourly_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))), "hourly-json", at_once=False)


QUERIES = {f.__name__: f for f in (stream_hourly_events, stream_distinct_events, stream_user_sessions, stream_json_events)}

HOURLY_SQL = """
SELECT hour, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, event_type FROM events)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2"""

ORACLE_SQL = {
    "stream_hourly_events": HOURLY_SQL,
    "stream_json_events": HOURLY_SQL,
    "stream_distinct_events": "SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1",
    "stream_user_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, s
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
}
