"""General analytics over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.plans.registry import query
from turnstone.sources.tables import read


@query("x_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark, d):
    li = read(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("x_nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def nation(spark, d):
    li, o, c, n, r = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    geo = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r.where("r_name = 'ASIA'"), n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name")
    return o.join(geo, o["o_custkey"] == geo["c_custkey"]).join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("a36_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("w24_frames", "SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("j26_outer_joins", "SELECT count(*) AS n, count(o_orderkey) AS with_order, count(c_custkey) AS with_customer FROM customer FULL JOIN (SELECT * FROM orders WHERE o_custkey % 3 = 0) ON c_custkey = o_custkey")
def outer(spark, d):
    o = read(spark, d, "orders").where("o_custkey % 3 = 0")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "full").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("with_order"), F.count("c_custkey").alias("with_customer"))


@query("x11_hopping_windows", "SELECT event_type, w AS starts, count(*) AS n FROM (SELECT event_type, unnest(range(0, 3)) AS k, time_bucket(INTERVAL 20 MINUTE, ts) AS b FROM events), LATERAL (SELECT b - k * INTERVAL 20 MINUTE AS w) GROUP BY ALL")
def hopping(spark, d):
    e = read(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour", "20 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("starts"), "n")
