"""Queries over series of time, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.expressions import cents
from tidemill.operators.series import filled_gaps, rolling_sums
from tidemill.sources.tables import table


def _orders(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(key, F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("day"), cents(F.col("o_totalprice")).alias("cents"))


def customer_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANGE frame: orders and cents of a customer over the 90 days to each of their days with orders."""
    return rolling_sums(_orders(spark, sf_dir, "o_custkey"), ["o_custkey"], "day", "cents", 90)


def priority_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANGE frame over few, hot keys: orders and cents of a priority over 7 days, by slices of 256 days."""
    return rolling_sums(_orders(spark, sf_dir, "o_orderpriority"), ["o_orderpriority"], "day", "cents", 7, 256)


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap filling: each user's largest value by the hour, hours without events on the line between their neighbours."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    events = table(spark, sf_dir, "events").select("user_id", hour.alias("hour"), cents(F.col("value")).alias("cents"))
    return filled_gaps(events, ["user_id"], "hour", "cents", 1)


QUERIES = {f.__name__: f for f in (customer_quarters, priority_weeks, user_hours)}

_ORDERS = "SELECT *, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders"
_ROLLING = """
WITH o AS ({0})
SELECT DISTINCT {1}, day::BIGINT AS day, count(*) OVER w AS n, (sum(cents) OVER w)::BIGINT AS total
FROM o WINDOW w AS (PARTITION BY {1} ORDER BY day RANGE BETWEEN {2} PRECEDING AND CURRENT ROW)"""

ORACLE_SQL = {
    "customer_quarters": _ROLLING.format(_ORDERS, "o_custkey", 89),
    "priority_weeks": _ROLLING.format(_ORDERS, "o_orderpriority", 6),
    "user_hours": """
WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, max(CAST(floor(value * 100 + 0.5) AS BIGINT))::DOUBLE AS cents FROM events WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT user_id, unnest(generate_series(min(hour), max(hour))) AS hour FROM e GROUP BY 1),
b AS (SELECT g.user_id, g.hour, e.hour AS h0, e.cents AS v0 FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.hour >= e.hour),
a AS (SELECT b.*, e.hour AS h1, e.cents AS v1 FROM b ASOF JOIN e ON b.user_id = e.user_id AND b.hour <= e.hour)
SELECT user_id, hour, CASE WHEN h0 = hour THEN v0 ELSE v0 + (v1 - v0) * (hour - h0)::DOUBLE / (h1 - h0)::DOUBLE END AS value, h0 = hour AS known FROM a""",
}
