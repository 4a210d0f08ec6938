"""File sources and sinks by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Formats that every Spark build has.
BUILT_IN = ("parquet", "orc", "json", "csv", "text", "xml")
_READ = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}, "xml": {"rowTag": "row", "mode": "FAILFAST"}}
_WRITE = {"csv": {"header": "true"}, "xml": {"rowTag": "row", "rootTag": "rows"}}


def available(spark: SparkSession, kind: str) -> bool:
    """Whether the session can read a format: avro and the table formats are modules that may be absent."""
    try:
        spark.sparkContext._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(kind, spark._jsparkSession.sessionState().conf())
    except Exception:  # the JVM's own classes of error differ by module
        return False
    return True


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A frame over files. Formats without a schema of their own need one: inference would read everything twice."""
    if kind in ("csv", "json", "xml") and schema is None:
        raise ValueError(f"{kind} files are read with a schema")
    reader = spark.read.format(kind).options(**(_READ.get(kind, {}) | options))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    writer = df.write.format(kind).options(**(_WRITE.get(kind, {}) | options)).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, by: list[str], buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by keys: joins on them then need no shuffle. With a path, the table's files lie there."""
    writer = df.write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
