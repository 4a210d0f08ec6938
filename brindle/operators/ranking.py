"""DISTINCT ON, QUALIFY, top-k, GROUPS frames and EXCLUDE, which Spark SQL does not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.names import unused


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the rank filter reaches both sides of the shuffle (WindowGroupLimit).

    A null key is a group. Rows equal in order come in some order. An empty table gives no rows; all columns of df stay as they are.
    """
    rank = unused("_rank", df)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k).drop(rank)


def distinct_on(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each group: the first in order."""
    return top_k(df, by, order, 1)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition over window functions holds; where it is null they go, as in a filter."""
    keep = unused("_keep", df)
    return df.withColumn(keep, condition).filter(F.col(keep)).drop(keep)


def groups_frame(df: DataFrame, by: list[str], order: str, aggregate: Column, before: int, after: int, name: str) -> DataFrame:
    """aggregate over a frame of peer groups: those from `before` groups ahead to `after` groups behind the row's own.

    Rows without an order are peers, the first group; a null key is a key. A column of df called `name` is replaced.
    """
    group = unused("_group", df)
    ranked = df.withColumn(group, F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    frame = Window.partitionBy(*by).orderBy(group).rangeBetween(-before, after)
    return ranked.withColumn(name, aggregate.over(frame)).drop(group)


def sum_excluding(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, exclude: str, name: str) -> DataFrame:
    """sums_excluding() of one kind."""
    return sums_excluding(df, by, order, value, before, after, {name: exclude})


def sums_excluding(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, names: dict[str, str]) -> DataFrame:
    """Sums of value over a ROWS frame without the row itself (`current row`), its peers (`ties`) or both (`group`): names gives each one's kind.

    Sums over the frame's peers are taken from the frame's sum. Null where no value is left. For integers and decimals the result is
    exact; doubles are subtracted, so that round-off stays. Rows without an order are peers, the first; a null key is a key. All frames go by one
    sort of the keys' rows: peers stand together in it, in the order that tells them apart.
    """
    tie = unused("_tie", df)
    total, n, peers, others = (unused(stem, df) for stem in ("_total", "_n", "_peers", "_others"))
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    own = F.col(value)
    frame = Window.partitionBy(*by).orderBy(order, tie).rowsBetween(-before, after)
    # the same frame, of the row's peers only
    alike = Window.partitionBy(*by, order).orderBy(tie).rowsBetween(-before, after)
    rows = rows.withColumns({total: F.sum(own).over(frame), n: F.count(own).over(frame)})
    if set(names.values()) - {"current row"}:
        rows = rows.withColumns({peers: F.sum(own).over(alike), others: F.count(own).over(alike)})
    number = lambda c: F.coalesce(c, F.lit(0))
    counted = F.when(own.isNotNull(), 1).otherwise(0)
    left = {
        "current row": lambda: (number(own), counted),
        "group": lambda: (number(F.col(peers)), F.col(others)),
        "ties": lambda: (number(F.col(peers)) - number(own), F.col(others) - counted),
    }
    out = {}
    for name, kind in names.items():
        less, fewer = left[kind]()
        out[name] = F.when(F.col(n) > fewer, F.col(total) - less)
    return rows.withColumns(out).drop(tie, total, n, peers, others)


#: Rows of a part that by_rows() deals, about.
_PART = 500_000


def by_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys to as many parts as its rows ask for, so that what a task sorts stays the same however many they are."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // _PART))
    return df.repartition(parts, *keys)
