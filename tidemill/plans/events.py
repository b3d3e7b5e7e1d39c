"""Batch queries over events, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.expressions import json_number, url_part
from tidemill.functions.props import typed_props
from tidemill.operators.patterns import in_order, matches
from tidemill.operators.ranking import sessions
from tidemill.sources.folders import new_folder
from tidemill.sources.jsonlines import json_lines
from tidemill.sources.tables import table, write_json_lines


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "n", "most")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", json_number(F.col("props"), "$.k"))
    return events.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_distinct("k").alias("values"), F.count("k").alias("n"))


def user_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by how far they came: a view, then a click after the first view, then a purchase after that click."""
    so_far = W.partitionBy("user_id").orderBy("ts")
    after = lambda kind, step: (F.col("event_type") == kind) & (F.col("ts") > F.col(step))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    events = events.withColumn("view", F.min(F.when(F.col("event_type") == "view", F.col("ts"))).over(so_far))
    events = events.withColumn("click", F.min(F.when(after("click", "view"), F.col("ts"))).over(so_far))
    step = F.when(after("purchase", "click"), 3).when(F.col("click").isNotNull(), 2).when(F.col("view").isNotNull(), 1).otherwise(0)
    return events.groupBy("user_id").agg(F.max(step).alias("step")).groupBy("step").agg(F.count("*").alias("users"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour that starts at a half hour or a full one."""
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "users")


def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host; malformed urls count under no host."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(url_part(url, "HOST").alias("host"), url_part(url, "PROTOCOL").alias("scheme"), url_part(url, "QUERY").alias("query"))
    return pages.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("scheme") == "https").alias("secure"), F.count("query").alias("with_query"))


def completed_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence pattern: each time that a user came from a view by a click to a purchase, without an error on the way."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "event_id")
    return matches(events, ["user_id"], "ts", "event_type", in_order(["view", "click", "purchase"], ["error"]), F.to_date, ["event_id"])


def props_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table function: the props of each event as typed rows, with what the user's key had before on that day."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", "props")
    return typed_props(events, "props", ["event_id", "user_id"], ["user_id", "day"], ["ts", "event_id"])


def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data source: events as line-delimited JSON, by type and day."""
    path = write_json_lines(table(spark, sf_dir, "events"), new_folder(spark, "events-json"))
    events = json_lines(spark, path, "event_id long, ts timestamp_ntz, event_type string, value double")
    return events.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count("malformed").alias("malformed"), F.sum("event_id").alias("ids"), F.max("value").alias("most"))


QUERIES = {f.__name__: f for f in (hourly_events, user_sessions, event_props, user_funnel, sliding_counts, pages_by_host, completed_funnels, props_by_day, json_events)}

ORACLE_SQL = {
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL",
    "user_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, s""",
    "event_props": """
SELECT event_type, CAST(sum(k) AS BIGINT) AS k, count(DISTINCT k) AS values, count(k) AS n
FROM (SELECT event_type, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY 1""",
    "user_funnel": """
WITH v AS (SELECT user_id, min(ts) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT user_id, min(ts) AS c FROM events JOIN v USING (user_id) WHERE event_type = 'click' AND ts > v GROUP BY 1),
p AS (SELECT DISTINCT user_id FROM events JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c)
SELECT CASE WHEN user_id IN (SELECT user_id FROM p) THEN 3 WHEN user_id IN (SELECT user_id FROM c) THEN 2 WHEN user_id IN (SELECT user_id FROM v) THEN 1 ELSE 0 END AS step, count(*) AS users
FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1""",
    "json_events": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, 0::BIGINT AS malformed, sum(event_id)::BIGINT AS ids, max(value) AS most FROM events GROUP BY 1, 2",
    "sliding_counts": """
SELECT start, event_type, count(*) AS n, count(DISTINCT user_id) AS users
FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, user_id FROM events) GROUP BY 1, 2""",
    "pages_by_host": r"""
WITH u AS (SELECT CASE WHEN NOT regexp_matches(url, '[\x00-\x20"<>\\^`{|}\x7F]|%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN url END AS url FROM pages)
SELECT nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '') AS host, count(*) AS pages, count(*) FILTER (WHERE url LIKE 'https://%') AS secure,
       count(*) FILTER (WHERE regexp_matches(url, '^[^#]*\?')) AS with_query FROM u GROUP BY 1""",
    "completed_funnels": """
WITH RECURSIVE e AS (SELECT user_id, ts, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS place FROM events),
m AS (
  SELECT user_id, 0::BIGINT AS place, 0 AS state, NULL::TIMESTAMP AS began, NULL::TIMESTAMP AS ended FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT e.user_id, e.place,
         CASE WHEN kind = 'error' THEN 0 WHEN state % 3 = 0 THEN CASE WHEN kind = 'view' THEN 1 ELSE 0 END WHEN state = 1 AND kind = 'click' THEN 2 WHEN state = 2 AND kind = 'purchase' THEN 3 ELSE state END,
         CASE WHEN state % 3 = 0 AND kind = 'view' THEN e.ts ELSE began END, e.ts
  FROM m JOIN e ON e.user_id = m.user_id AND e.place = m.place + 1)
SELECT user_id, began, ended FROM m WHERE state = 3""",
    "props_by_day": """
WITH k AS (SELECT event_id, user_id, ts, props, unnest(json_keys(props)) AS key FROM events),
v AS (SELECT *, json_extract(props, '$."' || key || '"') AS v FROM k),
t AS (SELECT *, CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN v::VARCHAR::DOUBLE END AS number FROM v)
SELECT event_id, user_id, key, CASE WHEN number IS NOT NULL THEN 'number' WHEN json_type(v) = 'VARCHAR' THEN 'string' ELSE 'other' END AS kind, number,
       CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' END AS text,
       last_value(number IGNORE NULLS) OVER (PARTITION BY user_id, ts::DATE, key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM t""",
}
