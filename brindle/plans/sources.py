"""Formats and sources: tables written in a format to the shared folder and read back, and a source of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.catalog import ORACLE_SQL, QUERIES, plan
from brindle.session import scratch, table
from brindle.sources import files
from brindle.sources.log import LogSource, read_log
from brindle.streaming.events import drained, event_stream


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "supplier")
        path = scratch(spark, kind)
        files.write(rows, path, kind)
        return files.read(spark, path, kind, rows.schema)

    run.__name__ = f"source_{kind}"
    QUERIES[run.__name__] = run
    ORACLE_SQL[run.__name__] = "SELECT * FROM supplier"


for _kind in ("csv", "json", "orc", "xml"):
    _round_trip(_kind)


@plan("SELECT n_name AS value FROM nation")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    files.write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), path, "text")
    return files.read(spark, path, "text")


@plan("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hive-style folders: the filter picks one of them."""
    path = scratch(spark, "partitioned")
    files.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "parquet", ["o_orderstatus"])
    return files.read(spark, path, "parquet").filter("o_orderstatus = 'F'")


@plan("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def source_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed by the join's key: neither the join nor the aggregation shuffles."""
    places = {t: scratch(spark, t) for t in ("customers", "orders")}
    names = {t: f"brindle_{p.rsplit('-', 1)[1]}" for t, p in places.items()}
    files.write_bucketed(table(spark, sf_dir, "customer").select("c_custkey"), names["customers"], ["c_custkey"], 8, places["customers"])
    files.write_bucketed(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), names["orders"], ["o_custkey"], 8, places["orders"])
    customers, orders = (spark.table(n) for n in names.values())
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def _log(df: DataFrame, name: str, **options) -> str:
    """A table in a log of our own."""
    df.sparkSession.dataSource.register(LogSource)
    path = scratch(df.sparkSession, name)
    df.write.format("brindle_log").options(path=path, **options).mode("append").save()
    return path


@plan("SELECT sale_id, client_id, total FROM sales WHERE sale_id >= 100 AND client_id < 50")
def source_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales through a sink and source of our own; the filters reach its segments' bounds and rows."""
    path = _log(table(spark, sf_dir, "sales").select("sale_id", "client_id", "total").repartitionByRange(8, "sale_id"), "log")
    return read_log(spark, path, "sale_id >= 100 and client_id < 50")


@plan("SELECT sale_id, line_no, item_id, quantity FROM sale_lines")
def source_custom_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream: commits are its offsets, partitions of some 700 rows are planned from them."""
    path = _log(table(spark, sf_dir, "sale_lines").select("sale_id", "line_no", "item_id", "quantity"), "log", batch=500)
    return drained(spark.readStream.format("brindle_log").options(path=path, step=700).load(), "append")


@plan("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def sink_custom_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into the log: a micro-batch is one commit, however often it is tried."""
    spark.dataSource.register(LogSource)
    path = scratch(spark, "log")
    buys = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "value")
    query = buys.writeStream.format("brindle_log").options(path=path, checkpointLocation=scratch(spark, "log-state"), stream="buys").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.format("brindle_log").option("path", path).load()
