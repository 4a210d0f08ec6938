"""Table functions that take a table: state between the rows of a partition, a schema that follows the argument."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@F.udtf
class FillDays:
    """A row for each day from a partition's first to its last: key, day, n (0 where the table has no row), and the last n that it has.

    The table: key, day, n, a row for each day at most, by PARTITION BY key ORDER BY day. The key's name and type are the table's; rows without
    a day are left out. A partition is never held: the state between rows is the last one.
    """

    def __init__(self):
        self.key, self.day, self.n = None, None, None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        fields = table.dataType.fields if table.isTable else []
        if [f.dataType for f in fields[1:]] != [T.DateType(), T.LongType()]:
            raise ValueError("a table of key, day date, n bigint is asked for")
        return AnalyzeResult(T.StructType([fields[0], T.StructField("day", T.DateType()), T.StructField("n", T.LongType()), T.StructField("carried", T.LongType())]))

    def eval(self, row: T.Row) -> Iterator[tuple[object, date, int, int]]:
        key, day, n = row
        if day is None:
            return
        if self.day is not None:
            between = self.day + timedelta(1)
            while between < day:
                yield key, between, 0, self.n
                between += timedelta(1)
        self.key, self.day, self.n = key, day, n
        yield key, day, n, n


def filled_days(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows per key and day, days without rows included: key, day, n, carried. Null times are left out; a null key is a key.

    Days are counted before the function sees them, so that a hot key is as many rows as it has days.
    """
    daily = df.filter(F.col(ts).isNotNull()).groupBy(F.col(key), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return FillDays(daily.asTable().partitionBy(key).orderBy("day"))
