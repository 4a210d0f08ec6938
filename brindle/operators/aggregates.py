"""Aggregations for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.names import unused


def dealt_salt(salts: int) -> Column:
    """0 to salts - 1 by turns within each partition: equal rows get different salts, and columns of any type will do."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts))


def two_step(df: DataFrame, by: list[str], parts: dict[str, Column], totals: dict[str, Column], salts: int) -> DataFrame:
    """Aggregates by (keys, salt) and then by keys, for aggregates without map-side combining such as collected lists.

    parts names the first step's results, totals computes the second's from them. A null key is a key, an empty table gives no rows.
    """
    salt = unused("_salt", df)
    first = df.withColumn(salt, dealt_salt(salts)).groupBy(*by, salt).agg(*(c.alias(n) for n, c in parts.items()))
    return first.groupBy(*by).agg(*(c.alias(n) for n, c in totals.items()))
