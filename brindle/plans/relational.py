"""Filters, joins, aggregations, windows, sorts and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.joins import asof_join, range_join
from brindle.operators.quantiles import exact_percentiles
from brindle.operators.ranking import by_rows, distinct_on, groups_frame, qualify, sums_excluding, top_k
from brindle.plans.catalog import plan, statement
from brindle.session import table


@plan("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n_lines"),
    )


statement("filter_project", """
SELECT o_orderkey, o_orderpriority, o_totalprice * 0.9 AS reduced, coalesce(nullif(o_orderstatus, 'P'), '?') AS status
FROM orders WHERE o_totalprice > 1000 AND o_orderpriority LIKE '%H' AND o_orderstatus IN ('F', 'O', 'P')
""")
statement("join_inner", "SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
statement("join_left", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
statement("join_full", """
SELECT o_orderkey, l_orderkey, l_linenumber FROM orders FULL JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25) AS l ON o_orderkey = l_orderkey
""")
statement("join_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
statement("join_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
statement("join_theta", """
SELECT a.n_name AS a, b.n_name AS b FROM (SELECT * FROM nation) AS a JOIN (SELECT * FROM nation) AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey
""")
statement("not_in_with_null", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)")
statement("scalar_subquery", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(x.o_totalprice) * 1.5 FROM (SELECT * FROM orders) AS x WHERE x.o_custkey = orders.o_custkey)
""")


@plan("""
SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS t
""")
def lateral_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit stands on the sort, both its columns kept: with a projection between, Spark 4.1.2 numbers a customer's orders as the shuffle brings them."""
    own = table(spark, sf_dir, "orders").filter(F.col("o_custkey") == F.col("c_custkey").outer())
    return table(spark, sf_dir, "customer").lateralJoin(own.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)).select("c_custkey", "o_orderkey")


statement("star_revenue", """
SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, c_mktsegment
""")


@plan("""
SELECT e.event_id, e.user_id, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'view') AS e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') AS p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return asof_join(views, buys, "ts", ["user_id"], ["price"]).select("event_id", "user_id", "price")


@plan("""
SELECT p_partkey, s_suppkey FROM part, (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 25 AS high FROM supplier) AS s
WHERE p_retailprice >= low AND p_retailprice <= high
""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return range_join(parts, spans, F.col("p_retailprice"), F.col("low"), F.col("high"), 25.0).select("p_partkey", "s_suppkey")


@plan("""
SELECT a.event_id AS first_id, b.event_id AS second_id FROM (SELECT * FROM events WHERE event_type = 'signup') AS a
JOIN events AS b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    a, b = events.filter("event_type = 'signup'").alias("a"), events.alias("b")
    near = F.expr("a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
    return a.join(b, near).select(F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("second_id"))


statement("agg_distinct_filter", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) AS top, min(o_orderdate) AS first_day
FROM orders GROUP BY o_orderpriority
""")
statement("agg_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())
""")
statement("agg_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
statement("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
statement("agg_statistics", """
SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY l_returnflag
""")
statement("agg_kurtosis", "SELECT l_returnflag, round(kurtosis(l_quantity), 6) AS k FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(kurtosis_pop(l_quantity), 6) AS k FROM lineitem GROUP BY l_returnflag")


@plan("""
SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90
FROM orders GROUP BY o_orderstatus
""")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_percentiles(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", {"median": 0.5}, {"p90": 0.9})
    return out.select("o_orderstatus", F.round("median", 4).alias("median"), "p90")


statement("agg_ordered", """
SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, max_by(n_name, n_nationkey) AS last, bool_and(n_nationkey >= 0) AS all_known FROM nation GROUP BY n_regionkey
""", """
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, arg_max(n_name, n_nationkey) AS last, bool_and(n_nationkey >= 0) AS all_known FROM nation GROUP BY n_regionkey
""")
statement("pivot_status", """
SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))
""", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority
""")
statement("unpivot_prices", """
SELECT l_orderkey, l_linenumber, name, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR name IN (l_discount, l_tax))
""")


@plan("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd,
       lag(o_totalprice, 1, 0.0) OVER w AS before, lead(o_orderkey) OVER w AS after
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.rank().over(w).cast("bigint").alias("rk"),
        F.ntile(4).over(w).cast("bigint").alias("quarter"),
        F.round(F.percent_rank().over(w), 9).alias("pr"),
        F.round(F.cume_dist().over(w), 9).alias("cd"),
        F.lag("o_totalprice", 1, 0.0).over(w).alias("before"),
        F.lead("o_orderkey").over(w).alias("after"),
    )


statement("window_frames", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_a_day,
       last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_buy
FROM events
""", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_a_day,
       last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_buy
FROM events
""")


@plan("SELECT o_orderkey, o_custkey FROM orders QUALIFY o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_custkey) AND count(*) OVER (PARTITION BY o_custkey) > 5")
def window_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    above = (F.col("o_totalprice") > F.avg("o_totalprice").over(w)) & (F.count(F.lit(1)).over(w) > 5)
    return qualify(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), above).drop("o_totalprice")


@plan("SELECT l_orderkey, l_partkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS qty FROM lineitem")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return groups_frame(lines, ["l_orderkey"], "l_linenumber", F.sum("l_quantity"), 1, 0, "qty").drop("l_quantity")


@plan("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def first_per_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_on(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])


@plan("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_three_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


statement("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
statement("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
statement("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
statement("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
statement("group_by_all_alias", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL")
statement("lateral_alias", "SELECT o_orderkey, o_totalprice * 2 AS twice, twice + 1 AS more FROM orders")
statement("star_except", "SELECT * EXCEPT (s_name) FROM supplier", "SELECT * EXCLUDE (s_name) FROM supplier")
statement("pipe_syntax", "FROM orders |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
statement("join_hinted", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_mktsegment FROM orders JOIN (SELECT * FROM customer) AS c ON o_custkey = c_custkey", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
statement("agg_mode_first", "SELECT o_orderstatus, mode(o_orderpriority) AS usual FROM (SELECT o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT o_orderstatus, '1-URGENT' AS o_orderpriority FROM orders) AS x GROUP BY o_orderstatus")
statement("join_hint_broadcast", "SELECT /*+ BROADCAST(n) */ s_suppkey, n_name FROM supplier JOIN (SELECT * FROM nation) AS n ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
statement("join_hint_merge", "SELECT /*+ MERGE(p) */ l_orderkey, l_linenumber, p_brand FROM lineitem JOIN (SELECT * FROM part) AS p ON l_partkey = p_partkey", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
statement("order_by_all", "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY ALL LIMIT 25")
statement("agg_bool_or", "SELECT n_regionkey, bool_or(n_nationkey > 20) AS some, bool_and(n_nationkey < 20) AS every FROM nation GROUP BY n_regionkey")
statement("agg_skewness", "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS s FROM lineitem GROUP BY l_returnflag", """
SELECT l_returnflag, round(avg(pow(l_extendedprice - m, 3)) / pow(var_pop(l_extendedprice), 1.5), 6) AS s
FROM (SELECT l_returnflag, l_extendedprice, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) AS x GROUP BY l_returnflag
""")


@plan("""
SELECT l_orderkey, l_partkey, l_linenumber,
       CAST(sum(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others,
       CAST(sum(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS strangers,
       CAST(sum(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS BIGINT) AS untied
FROM (SELECT * FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)
""")
def window_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = by_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"), ["l_orderkey"]).distinct()
    lines = qualify(lines, F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber")) == 1)
    return sums_excluding(lines, ["l_orderkey"], "l_linenumber", "l_suppkey", 2, 1, {"others": "current row", "strangers": "group", "untied": "ties"}).drop("l_suppkey")
