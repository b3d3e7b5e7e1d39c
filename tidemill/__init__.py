"""Analytics queries for Spark, written with its DataFrame, SQL and streaming APIs."""
