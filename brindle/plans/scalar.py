"""Families of scalar functions, user functions and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import mergeable, scalars, tables, udfs
from brindle.operators import sketches
from brindle.operators.scan import running
from brindle.plans.catalog import plan, statement
from brindle.session import table

statement("scalar_string", """
SELECT c_custkey, upper(c_name) AS up, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 2, 4) AS part, replace(c_name, '0', 'o') AS swapped,
       concat(c_name, '/', c_mktsegment) AS both, trim(concat('  ', c_name, ' ')) AS cut, reverse(c_mktsegment) AS back, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS far, md5(c_name) AS digest
FROM customer
""")
statement("scalar_math", """
SELECT l_orderkey, l_linenumber, l_quantity / 7 AS ratio, CAST(l_orderkey AS BIGINT) % 7 AS rest, round(l_extendedprice, 1) AS rounded, abs(l_discount - 0.05) AS off, floor(l_tax * 100) AS cents,
       greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS few
FROM lineitem
""", """
SELECT l_orderkey, l_linenumber, l_quantity / 7 AS ratio, CAST(l_orderkey AS BIGINT) % 7 AS rest, round(l_extendedprice, 1) AS rounded, abs(l_discount - 0.05) AS off, CAST(floor(l_tax * 100) AS BIGINT) AS cents,
       greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS few
FROM lineitem
""")


@plan("""
SELECT event_id, date_trunc('hour', ts) AS hour, CAST(extract(year FROM ts) AS BIGINT) AS y, CAST(extract(dow FROM ts) AS BIGINT) AS weekday, CAST(extract(second FROM ts) AS BIGINT) AS sec, ts + INTERVAL 36 HOUR AS later
FROM events
""")
def scalar_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.truncated("hour", ts).alias("hour"), F.year(ts).cast("bigint").alias("y"), scalars.weekday(ts).alias("weekday"),
        scalars.whole_second(ts).alias("sec"), F.expr("ts + interval 36 hours").alias("later"),
    )


@plan("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.json_number(F.col("props"), "$.k").alias("k"))


@plan("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def scalar_url_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.host(F.col("url")).alias("host"), scalars.without_tags(F.col("html")).alias("plain"))


@plan("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dot
FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND b.vec_id = a.vec_id + 1
""")
def scalar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    a = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label", (F.col("vec_id") + 1).alias("b"))
    b = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "label")
    return a.join(b, ["label", "b"]).select("a", "b", F.round(scalars.dot(F.col("x"), F.col("y")), 9).alias("dot"))


statement("scalar_arrays", """
SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS ks, CAST(size(collect_set(n_regionkey)) AS BIGINT) AS n FROM nation GROUP BY n_regionkey
""", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS ks, CAST(count(DISTINCT n_regionkey) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")


@plan("SELECT event_id, value * 2.0 AS doubled FROM events")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", udfs.scaled(F.col("value"), F.lit(2.0)).alias("doubled"))


@plan("""
SELECT event_type, round(avg(value), 6) AS middle FROM
(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) // 10 AS cut, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE r > cut AND r <= n - cut GROUP BY event_type
""")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the middle eight tenths, by rank: ranks by prefix scan, then an aggregate of our own whose states merge."""
    events = table(spark, sf_dir, "events").filter("value is not null").select("event_type", "value")
    ranked = running(events, ["event_type"], ["value"], {"r": ("count", F.lit(1))})
    sizes = ranked.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    middle = ranked.join(sizes, F.col("event_type").eqNullSafe(F.col("kind"))).filter("r > n div 10 and r <= n - n div 10")
    out = mergeable.user_aggregate(middle, ["event_type"], ["value"], mergeable.Moments())
    return out.select("event_type", F.round("mean", 6).alias("middle"))


@plan("SELECT client_id, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd FROM clicks GROUP BY client_id")
def udf_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mergeable.user_aggregate(table(spark, sf_dir, "clicks"), ["client_id"], ["value"], mergeable.Moments())
    return out.select("client_id", "n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@plan("SELECT vendor_id, list_sort(list(amount) FILTER (WHERE amount IS NOT NULL), 'DESC')[1:3] AS top FROM sale_lines GROUP BY vendor_id HAVING count(amount) > 0")
def udf_mergeable_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mergeable.user_aggregate(table(spark, sf_dir, "sale_lines"), ["vendor_id"], ["amount"], mergeable.Largest(3)).filter("size(top) > 0")


@plan("""
SELECT user_id, day, round(avg(value), 6) AS middle FROM
(SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) // 10 AS cut, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)
WHERE r > cut AND r <= n - cut GROUP BY user_id, day
""")
def udf_pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of groups, here users' days, of which a call takes as many as are in a batch: they are as many as a few rows each make."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return udfs.trimmed_means(events, ["user_id", "day"], "value").select("user_id", "day", F.round("mean", 6).alias("middle"))


@plan("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS value FROM events")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rows.groupBy("user_id").applyInPandas(udfs.demeaned, "event_id bigint, user_id bigint, value double").select("event_id", F.round("value", 9).alias("value"))


@plan("SELECT event_id, value FROM events WHERE value > 0")
def udf_map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").mapInArrow(udfs.positive_only, "event_id bigint, value double")


@plan("SELECT c_custkey, step, c_nationkey - step AS value FROM (SELECT c_custkey, c_nationkey, unnest(range(c_nationkey)) AS step FROM customer)")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of each row's values, in a lateral join."""
    spark.udtf.register("brindle_countdown", udfs.Countdown)
    return spark.sql("select c_custkey, step, value from {customer}, lateral brindle_countdown(c_nationkey)", customer=table(spark, sf_dir, "customer"))


@plan("""
WITH d AS (SELECT client_id, CAST(ts AS DATE) AS day, count(*) AS n FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL GROUP BY ALL),
s AS (SELECT client_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY client_id)
SELECT client_id, day, coalesce(n, 0) AS n, last_value(n IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS carried FROM s LEFT JOIN d USING (client_id, day)
""")
def udtf_filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over a table argument, partitioned and ordered."""
    return tables.filled_days(table(spark, sf_dir, "clicks").filter("client_id is not null"), "client_id", "ts")


@plan("SELECT c_custkey, len(regexp_replace(lower(c_mktsegment), '[^aeiou]', '', 'g')) AS n, c_mktsegment[1] AS first FROM customer")
def udf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one row at a time, pickled and over Arrow."""
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.vowels("c_mktsegment").alias("n"), udfs.initials("c_mktsegment").alias("first"))


@plan()
def sketch_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a count-min sketch estimates them: never too few."""
    events = table(spark, sf_dir, "events")
    return sketches.count_min_estimates(sketches.count_min(events, "user_id"), events.select("user_id").distinct(), "user_id")


@plan()
def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog counts of users per event type, merged from hourly sketches."""
    hourly = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.hll_sketch_agg("user_id").alias("s"))
    return hourly.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))


@plan()
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", [0.1, 0.5, 0.9], 10_000).alias("q"))


@plan()
def sketch_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta and KLL sketches, frequent items and histograms, in one pass; bounded in memory, near the exact answers."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.theta_sketch_estimate(F.theta_sketch_agg("user_id")).alias("users"),
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("value"), F.lit(0.5)).alias("median"),
        F.expr("approx_top_k(user_id, 3)").alias("frequent"),
        F.histogram_numeric("value", F.lit(5)).alias("histogram"),
    )


@plan("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {'type': event_type}['type'] AS kind, length(event_type) + 1 AS n FROM events")
def scalar_variant_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-structured values and maps."""
    events = table(spark, sf_dir, "events")
    kinds = F.create_map(F.lit("type"), F.col("event_type"))
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), kinds["type"].alias("kind"), (F.length("event_type") + F.size(kinds)).cast("bigint").alias("n"))


statement("scalar_hash", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha2(c_name, 256) AS c FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer")
statement("scalar_width_bucket", "SELECT l_orderkey, l_linenumber, width_bucket(l_quantity, 5, 45, 8) AS bucket FROM lineitem", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 9 ELSE CAST(floor((l_quantity - 5) * 8 / 40) AS BIGINT) + 1 END AS bucket FROM lineitem
""")
statement("scalar_json_tuple", "SELECT event_id, CAST(t.k AS BIGINT) AS k, t.missing, from_json(props, 'k BIGINT').k AS again FROM events LATERAL VIEW json_tuple(props, 'k', 'none') t AS k, missing", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing, CAST(json_extract(props, '$.k') AS BIGINT) AS again FROM events
""")
statement("scalar_maps", "SELECT event_id, array_join(map_keys(m), ',') AS names, aggregate(map_values(m), 0D, (s, x) -> s + x) AS total, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT event_id, map(event_type, value, 'fixed', 1.5D) AS m FROM events) AS x", """
SELECT event_id, array_to_string(map_keys(m), ',') AS names, list_sum(map_values(m)) AS total, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT event_id, MAP {event_type: value, 'fixed': 1.5} AS m FROM events) AS x
""")


@plan("SELECT user_id, count(*) AS n, CAST(1 AS BIGINT) AS parts FROM events WHERE value > 50 GROUP BY user_id")
def scalar_xxhash_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by xxhash64 of a key: what custom partitioning goes by. All rows of a user are in one part."""
    events = table(spark, sf_dir, "events").filter("value > 50").select("user_id")
    dealt = events.repartition(16, F.pmod(F.xxhash64("user_id"), F.lit(16))).withColumn("part", F.spark_partition_id())
    return dealt.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"))
