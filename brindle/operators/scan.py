"""Running aggregates by prefix scan: no key, however hot, is sorted by one task.

Rows are dealt by ranges of (keys, order), so that a hot key, or no key at all, is spread over as many tasks as it has rows for.
Each range takes the running values of its own rows; the state at the end of a range is added to those of the next one that goes on
with the same key. These states are one row a range, whatever the input, and are all that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import spooled

#: Of a range's own rows; of the states of earlier ranges, and how a state joins what comes after it.
_KINDS = {
    "count": (F.count, F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "sum": (F.sum, F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def in_ranges(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with `part`, the number of their range by order, and `tie`, which tells equal rows apart, so that they are split too."""
    return rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "tie").withColumn("part", F.spark_partition_id())


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """df with running values: for each row, those of its key's rows up to and with itself, ascending by `order`, nulls first.

    values: name -> (kind, column), kind one of count, sum, min, max and last (the last that is not null). Nulls are not counted or
    added; a value is null (a count 0) until there is one. Rows equal in keys and order come one after another in some order.
    A null key is a key. An empty table gives no rows. Columns of df keep their names and places, repeated names included; a new
    value under a name that df has is a second column of that name. Sums of doubles are added range by range, so that they may differ
    in the last digits from those of one task. The ranges are written to the shared folder once, when this is called.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select("*", *(c.alias(f"_new{i}") for i, (_, c) in enumerate(values.values())))
    rows = rows.toDF(*names, *(f"v{i}" for i in range(len(values))))
    at = {c.lower(): n for c, n in zip(df.columns, names)}
    keys, by_order = [at[k.lower()] for k in by], [at[k.lower()] for k in order]
    kinds = {f"v{i}": _KINDS[kind] for i, (kind, _) in enumerate(values.values())}

    dealt = in_ranges(rows, [*keys, *by_order], n)
    within = Window.partitionBy("part", *keys).orderBy(*by_order, "tie").rowsBetween(Window.unboundedPreceding, 0)
    dealt = spooled(dealt.withColumns({v: own(F.col(v)).over(within) for v, (own, _, _) in kinds.items()}), "ranges")

    # a range's last row has its last key and that key's state: at most n rows from here on
    last = F.max_by(F.struct(*keys, *kinds), F.struct(*keys, *by_order, "tie")).alias("end")
    ends = dealt.groupBy("part").agg(last).select("part", "end.*")
    up_to = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select(
        F.lead("part").over(Window.orderBy("part")).alias("next"), *(F.col(k).alias(f"on_{k}") for k in keys), *(before(F.col(v)).over(up_to).alias(f"before_{v}") for v, (_, before, _) in kinds.items())
    ).filter("next is not null")
    goes_on = F.col("part") == F.col("next")
    for k in keys:
        goes_on &= F.col(k).eqNullSafe(F.col(f"on_{k}"))
    joined = dealt.join(F.broadcast(carried), goes_on, "left")
    return joined.select(*names, *(join(F.col(f"before_{v}"), F.col(v)).alias(v) for v, (_, _, join) in kinds.items())).toDF(*df.columns, *values)
