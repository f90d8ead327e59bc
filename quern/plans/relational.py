"""Joins, grouping sets, set operations, nearest vectors and event windows over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.vectors import nearest
from quern.session import table


def star_revenue(spark, d):
    """Revenue by region and year; dimensions of known size are joined by broadcast, orders by their key."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "year").agg(F.round(F.sum("rev"), 0).alias("revenue"), F.count("*").alias("lines"))


def pricing_summary(spark, d):
    own = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def suppliers_of_big_parts(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45").select("l_suppkey")
    return table(spark, d, "supplier").join(big, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


def full_outer(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


def cube_rollup(spark, d):
    own = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return own


def rollup_sales(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.max("p_size").alias("largest"))


def set_operations(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return a.intersect(b).withColumn("op", F.lit("both")).union(a.exceptAll(b).withColumn("op", F.lit("customers"))).union(b.exceptAll(a).withColumn("op", F.lit("suppliers")))


def ranked_lines(spark, d):
    w = Window.partitionBy("l_returnflag", "l_linestatus").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("l_returnflag", "l_linestatus", "rank", "l_orderkey")


def as_of_orders(spark, d):
    """For each event the user's last error before it: a backward as-of join as one window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    own = table(spark, d, "events").withColumn("last_error", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w))
    return own.where("event_type = 'purchase'").select("event_id", "last_error")


def events_tumbling(spark, d):
    own = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def events_sliding(spark, d):
    own = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "30 minutes")).agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), "n")


def events_sessions(spark, d):
    """Visits of a user with no pause of 30 minutes."""
    own = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return own.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def nearest_vectors(spark, d):
    """The five nearest by cosine of every vector whose id is divisible by 100; the queries, a stated set, meet the rows in blocks."""
    own = table(spark, d, "embeddings")
    return nearest(own, own.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


def label_centroids(spark, d):
    own = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return own.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


_UNIT = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"

QUERIES = {
    "star_revenue": (star_revenue, "SELECT r_name, year(o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "customers_without_orders": (customers_without_orders, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "suppliers_of_big_parts": (suppliers_of_big_parts, "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)"),
    "full_outer": (full_outer, "WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, customers, suppliers FROM a FULL JOIN b ON a.k = b.k"),
    "cube_rollup": (cube_rollup, "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "rollup_sales": (rollup_sales, "SELECT p_brand, p_type, grouping_id(p_brand, p_type) AS level, count(*) AS n, max(p_size) AS largest FROM part GROUP BY ROLLUP (p_brand, p_type)"),
    "set_operations": (set_operations, "SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'suppliers' FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer)"),
    "ranked_lines": (ranked_lines, "SELECT l_returnflag, l_linestatus, rank::INT AS rank, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 20"),
    "as_of_orders": (as_of_orders, "SELECT event_id, last_error FROM (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events) WHERE event_type = 'purchase'"),
    "events_tumbling": (events_tumbling, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
    "events_sliding": (events_sliding, "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, range(4) r(k) GROUP BY 1"),
    "events_sessions": (events_sessions, "WITH g AS (SELECT *, (coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true))::INT AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, (SELECT max(n) FROM (SELECT s, count(*) AS n FROM s b WHERE b.user_id = a.user_id GROUP BY s)) AS longest FROM s a GROUP BY user_id"),
    "nearest_vectors": (nearest_vectors, f"SELECT query, rank::INT AS rank, vec_id FROM (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM {_UNIT} a, {_UNIT} b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5"),
    "label_centroids": (label_centroids, "SELECT label, place::INT AS place, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS place FROM embeddings) GROUP BY ALL"),
}
