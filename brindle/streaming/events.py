"""Structured Streaming over event tables: windows, deduplication, joins and state. Late rows are those behind the watermark; null keys are keys,
and match nothing in joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.session import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, lateness: str = "1 hour", glob: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Events of a folder's files; ts as an instant, which watermarks ask for."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _counted(events.groupBy(F.window("ts", width).alias("w"), "event_type"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return _counted(events.groupBy(F.window("ts", width, step).alias("w"), "event_type"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return _counted(events.groupBy(F.session_window("ts", gap).alias("w"), "user_id"))


def _counted(grouped) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    keys = [c for c in out.columns if c not in ("w", "n", "total")]
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), *keys, "n", "total")


def deduplicated(events: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(by)


def interval_join(left: DataFrame, right: DataFrame, minutes: int = 10) -> DataFrame:
    """Pairs of one user's events of which right's comes up to `minutes` after left's. Both sides carry watermarks."""
    a = left.select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = right.select(F.col("user_id").alias("other_id"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    near = F.expr(f"user_id = other_id and second_ts > first_ts and second_ts <= first_ts + interval {minutes} minutes")
    return a.join(b, near).select("user_id", "first_id", "second_id")


def _add_up(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for rows in batches:
        n, total = n + len(rows), total + float(rows["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """Each user's count and sum so far, after every micro-batch that has rows of the user (update mode)."""
    return events.groupBy("user_id").applyInPandasWithState(_add_up, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, by: list[str] | None = None) -> DataFrame:
    """Runs a stream over all there is and returns its rows; with `by`, only the last ones of each key.

    Every micro-batch is a folder of the shared directory, so that rows never pass through the driver; the folders go
    when the driver ends. complete mode returns the last result, append and update all rows sent; a source
    without files gives no rows.
    """
    spark = stream.sparkSession
    place = scratch(spark, "stream")
    schema = T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())] * (mode != "complete"))
    # so that there is something to read where no batch ever runs
    spark.createDataFrame([], stream.schema).write.parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{place}/out" if mode == "complete" else f"{place}/out/batch={number}"
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(schema).parquet(f"{place}/out")
    if by:
        names = [c for c in out.columns if c not in (*by, "batch")]
        last = F.max_by(F.struct(*names), "batch").alias("s")
        return out.groupBy(*by).agg(last).select(*by, *(F.col(f"s.{c}").alias(c) for c in names))
    return out.drop("batch")


def in_memory(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all there is into the memory sink: for results that the driver can hold, such as totals by kind."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", scratch(stream.sparkSession, "memory")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
