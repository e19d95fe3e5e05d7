"""Plain relational queries over the driver's tables: filters, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))


def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unshipped orders of the largest revenue: the top ten."""
    c = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _t(spark, sf_dir, "orders").where("o_orderdate < timestamp'1995-03-15'").select("o_orderkey", "o_custkey")
    li = _t(spark, sf_dir, "lineitem").where("l_shipdate > timestamp'1995-03-15'")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("l_orderkey").agg(F.round(F.sum(_revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, s, n, r = (_t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


def forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1994-01-01' and l_shipdate < timestamp'1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("largest"))


def customer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.row_number().over(w).alias("place"), F.round(F.sum("c_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))
    return ranked.where("place <= 3")


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order that is still open."""
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    return _t(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    both = c.intersect(s).withColumn("kind", F.lit("both"))
    return both.unionByName(c.subtract(s).withColumn("kind", F.lit("customers only")))


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (pricing_summary, shipping_priority, local_supplier_volume, forecast_revenue, order_rollup, customer_rank, idle_customers, shared_nations, events_by_hour)}

_SQL_REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2)"
ORACLE_SQL = {
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, {_SQL_REVENUE} AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "shipping_priority": f"SELECT l_orderkey, {_SQL_REVENUE} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "local_supplier_volume": f"SELECT r_name, n_name, {_SQL_REVENUE} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "order_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "customer_rank": "SELECT * FROM (SELECT c_custkey, c_nationkey, (row_number() OVER w)::INT AS place, round(sum(c_acctbal) OVER w, 2) AS running FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING)) WHERE place <= 3",
    "idle_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')",
    "shared_nations": "SELECT nation, 'both' AS kind FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT nation, 'customers only' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "events_by_hour": "SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
