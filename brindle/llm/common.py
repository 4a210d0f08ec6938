"""What several corpus operators share: tables, the shared folder, bounded batches, block layouts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.session import shared_dir, table  # noqa: F401


def spool(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    `few` is for rows that are small beside what made them: they are gathered in files of the advisory size, where each task
    would write one of its own. The application's folder goes when its driver ends.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if few else df
    top = f"{shared_dir(spark)}/brindle/{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    # no mark of success: the table is read after its write has returned, and by nothing else
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    fs, at = _hadoop(spark, top)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def unspool(df: DataFrame) -> None:
    """Deletes what spool() wrote: for tables that nothing reads any more, nor would after a failure."""
    fs, at = _hadoop(df.sparkSession, df._spooled)
    fs.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(values: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary array of about `most` bytes each; a longer value is a range of its own."""
    if not len(values):
        return
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
        stop = min(len(values), max(start + 1, stop))
        yield start, stop
        start = stop


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the graph of edges a-b, with the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
