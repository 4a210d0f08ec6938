"""Sketches that Spark SQL has no estimator for, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_min(df: DataFrame, column: str, width: int = 1 << 12, depth: int = 4) -> DataFrame:
    """(row, cell, n): counts of a column's values in `depth` rows of `width` cells; nulls are not counted.

    Sketches of parts of a table add up by (row, cell). An estimate is never too low, and with a chance of
    1 - exp(-depth) it is at most e / width of all rows too high.
    """
    return _cells(df.filter(F.col(column).isNotNull()), column, width, depth).groupBy("row", "cell").agg(F.count(F.lit(1)).alias("n"))


def count_min_estimates(sketch: DataFrame, keys: DataFrame, column: str, width: int = 1 << 12, depth: int = 4) -> DataFrame:
    """keys with the estimate n of each; the sketch, of width * depth rows at most, is broadcast.

    A null key has none: n is 0, as nulls are not counted. Keys that repeat come once. Columns of keys may have any names.
    """
    names = [f"k{i}" for i in range(len(keys.columns))]
    at = names[[c.lower() for c in keys.columns].index(column.lower())]
    met = _cells(keys.toDF(*names), at, width, depth, *names).join(F.broadcast(sketch), ["row", "cell"], "left")
    counted = F.when(F.col(at).isNull(), 0).otherwise(F.coalesce("n", F.lit(0)))
    return met.groupBy(*names).agg(F.min(counted).alias("n")).toDF(*keys.columns, "n")


def _cells(df: DataFrame, column: str, width: int, depth: int, *keep: str) -> DataFrame:
    at = F.lit(0), F.lit(depth - 1)
    own = df.select(*keep, F.col(column).alias("value"), F.explode(F.sequence(*at)).alias("row"))
    return own.select(*keep, "row", F.pmod(F.xxhash64("row", "value"), F.lit(width)).cast("int").alias("cell"))


#: Members that a stored sketch holds before it estimates, as a power of two.
_LG_MEMBERS = 16

#: Members that a part of them is meant to have: a quarter of what a sketch holds, as parts and the count that they go by are uneven.
_PART = 1 << (_LG_MEMBERS - 2)


def parts_of(df: DataFrame, member: str) -> int:
    """In how many parts members are to be dealt so that no part has more than a sketch holds, over whatever span."""
    return 1 + df.agg(F.approx_count_distinct(member)).first()[0] // _PART


def daily_sketches(df: DataFrame, day: Column, member: str, value: str, parts: int | None = None) -> DataFrame:
    """(day, n, members, values): a row a day, to be stored: its rows, a theta sketch of members and a KLL sketch of values.

    Null members and values are in neither sketch; a null day is a day. What is asked later of spans of days needs these rows alone.
    With parts, a row a day and `part`: members are dealt by their hash, and counts add up over parts. With as many parts as
    parts_of() tells, no sketch ever estimates: counts are exact, and the rows grow with the days' members.
    """
    part = [F.pmod(F.xxhash64(member), F.lit(parts)).alias("part")] if parts else []
    return df.groupBy(day, *part).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(member, F.lit(_LG_MEMBERS)).alias("members"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values")
    )


def merged_days(days: DataFrame, span: Column) -> DataFrame:
    """daily_sketches() by spans of days, and by parts if it has them: sketches merge into what one pass over all rows of the span would give."""
    merged = F.theta_union_agg("members", F.lit(_LG_MEMBERS)).alias("members")
    part = [c for c in days.columns if c == "part"]
    return days.groupBy(span, *part).agg(F.sum("n").alias("n"), merged, F.kll_merge_agg_double("values").alias("values"))


def compared(spans: DataFrame, others: DataFrame, span: str) -> DataFrame:
    """(span, either, both_of, only_first): members of two tables of merged_days() with parts, for the spans that both have."""
    sides = spans.select(span, "part", "members").join(others.select(span, "part", F.col("members").alias("others")), [span, "part"], "full")
    own, other = (F.coalesce(F.theta_sketch_estimate(c), F.lit(0)) for c in ("members", "others"))
    # a part that one side lacks has the other's members
    either = F.coalesce(F.theta_sketch_estimate(F.theta_union("members", "others", F.lit(_LG_MEMBERS))), own + other)
    both = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("members", "others")), F.lit(0))
    only = F.coalesce(F.theta_sketch_estimate(F.theta_difference("members", "others")), own)
    counts = sides.groupBy(span).agg(
        F.sum(either).alias("either"), F.sum(both).alias("both_of"), F.sum(only).alias("only_first"), F.count("members").alias("first"), F.count("others").alias("second")
    )
    return counts.filter("first > 0 and second > 0").drop("first", "second")
