"""Queries over the star schema of orders, and their SQL for DuckDB."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.expressions import cents, net_price
from tidemill.operators.intervals import overlap_join, overlap_totals, skew_join
from tidemill.operators.joins import as_of_join, range_join
from tidemill.operators.ranking import top_per_group
from tidemill.operators.rollups import daily_states, read_off, rolled_up
from tidemill.sources.folders import new_folder
from tidemill.sources.tables import table, write_bucketed, write_partitioned


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-01").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(cents(F.col("l_quantity"))).alias("quantity"),
        F.sum(cents(F.col("l_extendedprice"))).alias("base_cents"),
        F.sum(cents(net_price())).alias("net_cents"),
        F.max("l_discount").alias("max_discount"),
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.count("*").alias("items"),
    )


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of orders whose customer and supplier share a nation."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    joined = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    joined = joined.join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    joined = joined.join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum(cents(net_price())).alias("net_cents"), F.countDistinct("o_orderkey").alias("orders"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


def top_orders_per_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


def orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def customers_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    customers = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return customers.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.sum(cents(F.col("c_acctbal"))).alias("balance_cents"))


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    return orders.rollup("year", "o_orderstatus").agg(F.sum(cents(F.col("o_totalprice"))).alias("cents"), F.count("*").alias("orders"), F.grouping_id().alias("level"))


def part_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count("*").alias("parts"), F.max("p_retailprice").alias("dearest"), F.grouping_id().alias("level"))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("c", cents(F.col("o_totalprice")))
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("c"))


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's order before it and the running spend."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        F.lag("o_orderkey").over(w).alias("before"),
        F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("days"),
        F.sum(cents(F.col("o_totalprice"))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("spent_cents"),
        F.ntile(4).over(w).alias("quarter"),
    )


def last_order_before_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the customer's latest order when a line item shipped."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_shipdate")
    shipped = items.groupBy("o_custkey", "l_shipdate").agg(F.count("*").alias("items"))
    latest = orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    return as_of_join(shipped, latest, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order"])


def parts_in_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join: parts whose price lies within a tenth of a brand's mean price."""
    parts = table(spark, sf_dir, "part").withColumn("price", cents(F.col("p_retailprice")))
    mean = F.floor(F.sum("price") / F.count("*"))
    bands = parts.groupBy(F.col("p_brand").alias("brand")).agg((mean - F.floor(mean / 10)).alias("low"), (mean + F.floor(mean / 10)).alias("high"))
    met = range_join(parts, bands, F.col("price"), F.col("low"), F.col("high"), 5_000)
    return met.groupBy("brand").agg(F.count("*").alias("parts"), F.min("price").alias("least"), F.max("price").alias("most"))


def customer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of both statuses, and of the first only, counted."""
    orders = table(spark, sf_dir, "orders")
    f, o = (orders.where(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "O"))
    both = f.intersect(o).agg(F.lit("both").alias("kind"), F.count("*").alias("customers"))
    return both.unionByName(f.subtract(o).agg(F.lit("first only").alias("kind"), F.count("*").alias("customers")))


def customers_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by nation, where either may be missing."""
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def orders_by_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join: orders by their number of line items, those without any among them."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy(F.coalesce("n", F.lit(0)).alias("items")).agg(F.count("*").alias("orders"))


def rival_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta join: pairs of nations of one region in which the first has more suppliers."""
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nations = table(spark, sf_dir, "nation").join(suppliers, "n_nationkey").select("n_regionkey", "n_name", "n")
    other = nations.withColumnsRenamed({"n_regionkey": "region", "n_name": "fewer_name", "n": "fewer"})
    return nations.join(other, (F.col("n_regionkey") == F.col("region")) & (F.col("n") > F.col("fewer"))).select("n_name", "n", "fewer_name", "fewer")


def customer_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer in one status that those in the other make up for, and those left over."""
    orders = table(spark, sf_dir, "orders")
    f, o = (orders.where(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "O"))
    count = lambda rows, kind: rows.groupBy("o_custkey").agg(F.count("*").alias("orders")).withColumn("kind", F.lit(kind))
    return count(f.intersectAll(o), "matched").unionByName(count(f.exceptAll(o), "left over"))


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of unlike tables by name; what a side lacks is null."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), cents(F.col("c_acctbal")).alias("cents"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(cents(F.col("s_acctbal")).alias("cents"), F.col("s_nationkey").alias("nation"))
    both = customers.unionByName(suppliers, allowMissingColumns=True)
    return both.groupBy("nation", "segment").agg(F.count("*").alias("parties"), F.sum("cents").alias("cents"))


def order_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("c", cents(F.col("o_totalprice")))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders.groupingSets([[status, priority], [priority], []], status, priority).agg(F.count("*").alias("orders"), F.sum("c").alias("cents"), F.grouping_id().alias("level"))


def partitioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by status and read again, the files of one status only."""
    path = write_partitioned(table(spark, sf_dir, "orders"), new_folder(spark, "orders"), ["o_orderstatus"], ["o_orderkey"])
    kept = spark.read.parquet(path).where("o_orderstatus = 'P'")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum(cents(F.col("o_totalprice"))).alias("cents"))


def items_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items, both kept in buckets of the order's key: joined and grouped without a shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(rows: DataFrame, name: str, key: str) -> DataFrame:
        path = new_folder(spark, name)
        return write_bucketed(rows, os.path.basename(path).replace("-", "_"), path, [key], buckets)

    orders = kept(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "orders", "o_orderkey")
    items = kept(table(spark, sf_dir, "lineitem").select("l_orderkey", cents(net_price()).alias("cents"), "l_shipdate"), "items", "l_orderkey")
    joined = orders.join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("items"), F.sum("cents").alias("cents"), F.max("l_shipdate").alias("last"))


def _open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, o_orderkey, opened, closed: an order is open from its day to its last item's shipment, in days."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    joined = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_custkey", "o_orderkey", day("o_orderdate").alias("opened"), day("last").alias("closed")).where("closed > opened")


def orders_open_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join by key: how many other orders of a customer were open while an order was."""
    path = new_folder(spark, "open")
    _open_orders(spark, sf_dir).write.parquet(path)
    orders = spark.read.parquet(path)
    pairs = overlap_join(orders, orders, ("opened", "closed"), ("opened", "closed"), on=["o_custkey"])
    met = pairs.where("left.o_orderkey <> right.o_orderkey")
    return met.groupBy(F.col("left.o_orderkey").alias("o_orderkey")).agg(F.count("*").alias("others"), F.min("right.opened").alias("first_opened"), F.max("right.closed").alias("last_closed"))


def orders_open_in_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join without a key, as totals: open orders by the suppliers' sales, of a few days or of years, that they meet."""
    start = (F.col("s_suppkey") * 7919) % 2400 + 9131
    sales = table(spark, sf_dir, "supplier").select("s_suppkey", start.alias("begins"), (start + F.when(F.col("s_suppkey") % 5 == 0, 1500).otherwise(1 + F.col("s_suppkey") % 9)).alias("ends"))
    met = overlap_totals(_open_orders(spark, sf_dir), sales, ("opened", "closed"), ("begins", "ends"), "o_orderkey")
    return met.groupBy("s_suppkey").agg(F.sum("n").alias("orders"), F.min("least").alias("first_order"))


def returns_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join with frequent keys spread over tasks: line items of a supplier's nation by what became of them."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", cents(net_price()).alias("cents"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return skew_join(items, suppliers, ["s_suppkey"], "left", per_task=1 << 18).groupBy("s_nationkey", "l_returnflag").agg(F.count("*").alias("items"), F.sum("cents").alias("cents"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders from states that are kept by day; the distinct customers and the median are estimates, so only their bounds are told."""
    path = new_folder(spark, "daily")
    daily_states(table(spark, sf_dir, "orders"), F.col("o_orderdate"), ["o_orderpriority"], cents(F.col("o_totalprice")), F.col("o_custkey")).write.partitionBy("o_orderpriority").parquet(path)
    months = rolled_up(spark.read.parquet(path), [F.date_trunc("month", "day").cast("timestamp_ntz").alias("month")])
    read = read_off(months)
    told = (F.col("distinct") <= 1.1 * F.col("n")) & F.col("q50").between(F.col("least"), F.col("most"))
    return read.select("month", "n", F.col("total").alias("cents"), "least", "most", told.alias("within_bounds"))


QUERIES = {f.__name__: f for f in (pricing_summary, nation_revenue, top_orders, top_orders_per_priority, orders_without_items, customers_with_returns, order_rollup, part_cube, status_pivot, order_gaps, last_order_before_shipment, parts_in_price_bands, customer_sets, customers_full_join, orders_by_items, rival_nations, customer_multisets, parties, order_grouping_sets, partitioned_orders, items_by_order, orders_open_together, orders_open_in_sales, returns_by_nation, monthly_orders)}

_CENTS = "CAST(floor(({}) * 100 + 0.5) AS BIGINT)"
_NET = _CENTS.format("l_extendedprice * (1 - l_discount)")
_TOTAL = _CENTS.format("o_totalprice")

_OPEN = """
SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', o_orderdate) AS INTEGER) AS opened, CAST(date_diff('day', DATE '1970-01-01', last) AS INTEGER) AS closed
FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE last > o_orderdate"""

ORACLE_SQL = {
    "pricing_summary": f"""
SELECT l_returnflag, l_linestatus, sum({_CENTS.format("l_quantity")})::BIGINT AS quantity, sum({_CENTS.format("l_extendedprice")})::BIGINT AS base_cents,
       sum({_NET})::BIGINT AS net_cents, max(l_discount) AS max_discount, count(DISTINCT l_suppkey) AS suppliers, count(*) AS items
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01' GROUP BY ALL""",
    "nation_revenue": f"""
SELECT r_name, n_name, sum({_NET})::BIGINT AS net_cents, count(DISTINCT o_orderkey) AS orders
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "top_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "top_orders_per_priority": """
SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""",
    "orders_without_items": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1",
    "customers_with_returns": f"""
SELECT c_mktsegment, count(*) AS customers, sum({_CENTS.format("c_acctbal")})::BIGINT AS balance_cents FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) GROUP BY 1""",
    "order_rollup": f"""
SELECT year(o_orderdate) AS year, o_orderstatus, sum({_TOTAL})::BIGINT AS cents, count(*) AS orders, grouping(year(o_orderdate), o_orderstatus) AS level
FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)""",
    "part_cube": "SELECT p_brand, p_type, count(*) AS parts, max(p_retailprice) AS dearest, grouping(p_brand, p_type) AS level FROM part GROUP BY CUBE (p_brand, p_type)",
    "status_pivot": f"""
SELECT o_orderpriority, {", ".join(f"(sum({_TOTAL}) FILTER (WHERE o_orderstatus = '{s}'))::BIGINT AS {s}" for s in "FOP")} FROM orders GROUP BY 1""",
    "order_gaps": f"""
SELECT o_orderkey, lag(o_orderkey) OVER w AS before, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days,
       (sum({_TOTAL}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS spent_cents, CAST(ntile(4) OVER w AS INTEGER) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "last_order_before_shipment": """
WITH s AS (SELECT o_custkey, l_shipdate, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY ALL)
SELECT s.o_custkey, l_shipdate, items, last_order FROM s ASOF LEFT JOIN o ON s.o_custkey = o.o_custkey AND s.l_shipdate >= o.o_orderdate""",
    "parts_in_price_bands": f"""
WITH p AS (SELECT p_brand, {_CENTS.format("p_retailprice")} AS price FROM part),
m AS (SELECT p_brand AS brand, CAST(floor(sum(price) / count(*)) AS BIGINT) AS mean FROM p GROUP BY 1)
SELECT brand, count(*) AS parts, min(price) AS least, max(price) AS most
FROM p JOIN m ON price >= mean - mean // 10 AND price < mean + mean // 10 GROUP BY 1""",
    "customer_sets": """
SELECT 'both' AS kind, count(*) AS customers FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'first only', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
    "customers_full_join": """
SELECT coalesce(c.n, s.n) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s ON c.n = s.n""",
    "orders_by_items": """
SELECT items, count(*) AS orders FROM (SELECT o_orderkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1""",
    "rival_nations": """
WITH n AS (SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT a.n_name, a.n, b.n_name AS fewer_name, b.n AS fewer FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND a.n > b.n""",
    "customer_multisets": """
WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, count(*) AS orders, 'matched' AS kind FROM (SELECT * FROM f INTERSECT ALL SELECT * FROM o) GROUP BY 1
UNION ALL SELECT o_custkey, count(*), 'left over' FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM o) GROUP BY 1""",
    "parties": f"""
SELECT nation, segment, count(*) AS parties, sum(cents)::BIGINT AS cents FROM (
  SELECT c_nationkey AS nation, c_mktsegment AS segment, {_CENTS.format("c_acctbal")} AS cents FROM customer
  UNION ALL SELECT s_nationkey, NULL, {_CENTS.format("s_acctbal")} FROM supplier) GROUP BY ALL""",
    "order_grouping_sets": f"""
SELECT o_orderstatus, o_orderpriority, count(*) AS orders, sum({_TOTAL})::BIGINT AS cents, grouping(o_orderstatus, o_orderpriority) AS level
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())""",
    "partitioned_orders": f"SELECT o_orderpriority, count(*) AS orders, sum({_TOTAL})::BIGINT AS cents FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    "items_by_order": f"""
SELECT o_orderkey, o_orderpriority, count(*) AS items, sum({_NET})::BIGINT AS cents, max(l_shipdate) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "orders_open_together": f"""
WITH o AS ({_OPEN})
SELECT a.o_orderkey, count(*) AS others, min(b.opened) AS first_opened, max(b.closed) AS last_closed
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.opened < b.closed AND b.opened < a.closed AND a.o_orderkey <> b.o_orderkey GROUP BY 1""",
    "orders_open_in_sales": f"""
WITH o AS ({_OPEN}), s AS (SELECT s_suppkey, (s_suppkey * 7919) % 2400 + 9131 AS begins, CASE WHEN s_suppkey % 5 = 0 THEN 1500 ELSE 1 + s_suppkey % 9 END AS days FROM supplier)
SELECT s_suppkey, count(*) AS orders, min(o_orderkey) AS first_order FROM o JOIN s ON opened < begins + days AND begins < closed GROUP BY 1""",
    "returns_by_nation": f"""
SELECT s_nationkey, l_returnflag, count(*) AS items, sum({_NET})::BIGINT AS cents FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "monthly_orders": f"""
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, sum({_TOTAL})::BIGINT AS cents, min({_TOTAL}) AS least, max({_TOTAL}) AS most, TRUE AS within_bounds FROM orders GROUP BY 1""",
}
