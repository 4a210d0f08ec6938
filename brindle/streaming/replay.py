"""Streams that move: a table arrives in portions, and a query takes each where it left off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import scratch, spooled

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def own_session(spark: SparkSession, rocks: bool = False) -> SparkSession:
    """A session beside the caller's, so that what a stream needs set does not reach other queries."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    if rocks:
        own.conf.set(_PROVIDER, _ROCKS)
    return own


def replayed(arrivals: DataFrame, portion: Column, plan: Callable[[DataFrame], DataFrame], mode: str, rocks: bool = False, once: bool = False) -> DataFrame:
    """What a streaming plan sends when arrivals come portion by portion: its rows, and `batch`, the micro-batch that sent them.

    portion is an integer; a null one never arrives. The portions come in ascending order. For each, its rows are appended to the source's folder and the query is started
    anew on one checkpoint, takes what is there and stops: state and watermark go on from start to start, and the watermark has moved past one portion
    when the next one comes. Few portions are meant: their numbers are listed by the driver. Rows never pass through it. No arrivals, no rows.

    once: one micro-batch a portion and no more, for state with processing time, which would have a next one for ever. The watermark then moves a portion later.
    """
    spark = arrivals.sparkSession
    place = scratch(spark, "replay")
    rows = spooled(arrivals.withColumn("_portion", portion.cast("int")).filter("_portion is not null"), "arrivals")
    schema = arrivals.schema
    own = own_session(spark, rocks)
    spark.createDataFrame([], schema).write.parquet(f"{place}/in")
    stream = plan(own.readStream.schema(schema).parquet(f"{place}/in"))
    sent = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], stream.schema).write.parquet(f"{place}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    for (number,) in sorted(rows.select("_portion").distinct().collect()):
        rows.filter(F.col("_portion") == number).drop("_portion").write.mode("append").parquet(f"{place}/in")
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/log").foreachBatch(keep).trigger(**({"once": True} if once else {"availableNow": True})).start()
        query.awaitTermination()
    return spark.read.schema(sent).parquet(f"{place}/out")


def latest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of replayed() in update mode: each key's last row."""
    names = [c for c in rows.columns if c not in (*by, "batch")]
    last = F.max_by(F.struct(*names), "batch").alias("s")
    return rows.groupBy(*by).agg(last).select(*by, *(F.col(f"s.{c}").alias(c) for c in names))
