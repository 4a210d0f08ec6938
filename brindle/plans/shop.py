"""Plans over the shop's tables, whose keys are skewed: one client holds up to a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.aggregates import two_step
from brindle.operators.joins import asof_join, salted_join
from brindle.operators.quantiles import exact_percentiles
from brindle.operators.recursion import reachable
from brindle.operators.scan import running
from brindle.operators.sketches import compared, daily_sketches, merged_days, parts_of
from brindle.plans.catalog import plan, statement
from brindle.session import scratch, table


@plan("""
SELECT sale_id, CAST(sum(CAST(total AS DECIMAL(12, 2))) OVER w AS DOUBLE) AS so_far, count(*) OVER w AS nth FROM sales
WINDOW w AS (ORDER BY sold_at NULLS FIRST, sale_id ROWS UNBOUNDED PRECEDING)
""")
def window_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum of all sales: without a key, which a window sorts in one task."""
    sales = table(spark, sf_dir, "sales").select("sale_id", "sold_at", "total")
    out = running(sales, [], ["sold_at", "sale_id"], {"so_far": ("sum", F.col("total").cast("decimal(12,2)")), "nth": ("count", F.lit(1))})
    return out.select("sale_id", F.col("so_far").cast("double").alias("so_far"), "nth")


@plan("""
SELECT sale_id, client_id, count(*) OVER w AS nth, max(total) OVER w AS best, min(total) OVER w AS least, last_value(CASE WHEN status <> 'open' THEN sale_id END IGNORE NULLS) OVER w AS last_closed FROM sales
WINDOW w AS (PARTITION BY client_id ORDER BY sold_at NULLS FIRST, sale_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def window_running_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at", "total", "status")
    closed = F.when(F.col("status") != "open", F.col("sale_id"))
    out = running(sales, ["client_id"], ["sold_at", "sale_id"], {"nth": ("count", F.lit(1)), "best": ("max", F.col("total")), "least": ("min", F.col("total")), "last_closed": ("last", closed)})
    return out.select("sale_id", "client_id", "nth", "best", "least", "last_closed")


@plan("""
SELECT sale_id, s.client_id, s.sold_at, balance FROM sales AS s
ASOF LEFT JOIN (SELECT client_id, valid_at, max(balance) AS balance FROM client_changes GROUP BY ALL) AS c ON s.client_id = c.client_id AND s.sold_at >= c.valid_at
""")
def join_asof_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the client's balance as of then; of changes at one time the greatest counts."""
    sales = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at")
    changes = table(spark, sf_dir, "client_changes").filter("valid_at is not null").select("client_id", F.col("valid_at").alias("sold_at"), "balance")
    return asof_join(sales, changes, "sold_at", ["client_id"], ["balance"]).select("sale_id", "client_id", "sold_at", "balance")


@plan("""
SELECT client_id, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS quarter, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median,
       percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95
FROM clicks GROUP BY client_id
""")
def agg_percentiles_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    out = exact_percentiles(clicks, ["client_id"], "value", {"quarter": 0.25, "median": 0.5}, {"p95": 0.95})
    return out.select("client_id", F.round("quarter", 6).alias("quarter"), F.round("median", 6).alias("median"), "p95")


@plan("SELECT client_id, count(*) AS n, list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)) AS kinds FROM clicks GROUP BY client_id HAVING count(kind) > 0")
def agg_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected sets have no bound on the map side but their salt's rows: a hot client is 16 groups first."""
    parts = {"n": F.count(F.lit(1)), "kinds": F.collect_set("kind")}
    totals = {"n": F.sum("n"), "kinds": F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds"))))}
    return two_step(table(spark, sf_dir, "clicks"), ["client_id"], parts, totals, 16).filter("size(kinds) > 0")


@plan("SELECT sale_id, line_no, l.item_id, quantity, brand FROM sale_lines AS l JOIN items AS i ON l.item_id = i.item_id")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines").select("sale_id", "line_no", "item_id", "quantity")
    return salted_join(lines, table(spark, sf_dir, "items").select("item_id", "brand"), ["item_id"], 16)


@plan("""
WITH RECURSIVE e AS (SELECT DISTINCT s.client_id AS a, t.client_id AS b FROM sales AS s JOIN sales AS t ON t.sale_id = s.sale_id + 1 WHERE s.client_id % 4 = 1 AND s.client_id < t.client_id AND t.client_id < s.client_id + 40),
r AS (SELECT a AS start, b AS node, 1 AS depth FROM e UNION SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a)
SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node
""")
def recursive_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that follow one another in sales, upwards in small steps, and whom each one leads to."""
    sales = table(spark, sf_dir, "sales").select("sale_id", "client_id")
    after = sales.select((F.col("sale_id") - 1).alias("sale_id"), F.col("client_id").alias("follower"))
    edges = sales.join(after, "sale_id").filter("client_id % 4 = 1 and client_id < follower and follower < client_id + 40")
    return reachable(edges, "client_id", "follower")


@plan("""
WITH RECURSIVE e AS (SELECT client_id AS a, master_id AS b FROM clients WHERE master_id IS NOT NULL AND client_id IS NOT NULL),
r AS (SELECT a AS start, b AS node FROM e UNION SELECT r.start, e.b FROM r JOIN e ON r.node = e.a)
SELECT start AS client_id, count(*) AS masters, min(node) AS least FROM r GROUP BY start
""")
def recursive_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a client's record is merged into, at any remove; most are merged into themselves."""
    found = reachable(table(spark, sf_dir, "clients"), "client_id", "master_id")
    return found.groupBy(F.col("start").alias("client_id")).agg(F.count(F.lit(1)).alias("masters"), F.min("node").alias("least"))


statement("recursive_series", """
WITH RECURSIVE r(client_id, node, depth) AS (SELECT client_id, master_id, 1 FROM clients WHERE master_id <> client_id
UNION ALL SELECT r.client_id, c.master_id, r.depth + 1 FROM r JOIN (SELECT client_id AS k, master_id FROM clients WHERE master_id <> client_id) AS c ON r.node = c.k WHERE r.depth < 8)
SELECT client_id, node, depth FROM r
""")


@plan("""
WITH d AS (SELECT DISTINCT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 30) AS BIGINT) AS period, client_id FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
p AS (SELECT DISTINCT period FROM d)
SELECT period, (SELECT count(DISTINCT client_id) FROM d WHERE d.period IN (p.period, p.period + 1)) AS either,
       (SELECT count(*) FROM d JOIN d AS x USING (client_id) WHERE d.period = p.period AND x.period = p.period + 1) AS both_of,
       (SELECT count(*) FROM d WHERE d.period = p.period AND client_id NOT IN (SELECT x.client_id FROM d AS x WHERE x.period = p.period + 1)) AS only_first
FROM p WHERE period + 1 IN (SELECT period FROM p)
""")
def sketch_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of a period, of the next, of both and of the first alone, from sketches that were stored by the day.

    Clients are dealt to parts that a sketch holds in full, so that counts are exact however many there are.
    """
    path = scratch(spark, "daily-sketches")
    clicks = table(spark, sf_dir, "clicks").filter("ts is not null and client_id is not null")
    daily_sketches(clicks, F.to_date("ts").alias("day"), "client_id", "value", parts_of(clicks, "client_id")).write.parquet(path)
    periods = merged_days(spark.read.parquet(path), F.floor(F.datediff("day", F.lit("2024-01-01")) / 30).alias("period"))
    return compared(periods, periods.withColumn("period", F.col("period") - 1), "period")


@plan()
def sketch_stored_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and tails of a month from the stored sketches of its days; within the sketch's error of the exact ranks."""
    path = scratch(spark, "daily-quantiles")
    clicks = table(spark, sf_dir, "clicks").filter("ts is not null and value is not null")
    daily_sketches(clicks, F.to_date("ts").alias("day"), "client_id", "value").write.parquet(path)
    months = merged_days(spark.read.parquet(path), F.date_format("day", "yyyy-MM").alias("month"))
    at = lambda q: F.kll_sketch_get_quantile_double("values", F.lit(q))
    return months.select("month", "n", at(0.5).alias("median"), at(0.95).alias("p95"))
