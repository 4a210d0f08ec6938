"""Exact quantiles by distributed selection: no group's values meet in one task.

A sketch of each group brackets the value of a wanted rank; one pass counts what is below and inside each bracket, exactly. A bracket with
more than `held` rows strictly inside is sketched again, from those rows alone, and shrinks some 60 times. Only a bracket's
distinct values are gathered in the end, with their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import spooled

#: Of the sketches: a rank is off by at most n / _ACCURACY.
_ACCURACY = 1000


def exact_percentiles(df: DataFrame, by: list[str], value: str, cont: dict[str, float] | None = None, disc: dict[str, float] | None = None, held: int = 1 << 16) -> DataFrame:
    """A row for each group: keys, then a column for each named quantile of a number, as percentile_cont and percentile_disc give it.

    cont, disc: name -> quantile from 0 to 1; cont lies between two values, disc is one of them. Nulls are left out; a group without values has nulls,
    NaN is above all numbers. A null key is a group; an empty table gives no rows, or with no keys one of nulls. Values are doubles.
    A task of the last step holds held + 2 distinct values of a group. Intermediate tables, a row a group, are written when this is called.
    """
    cont, disc = cont or {}, disc or {}
    wanted = [(q, True) for q in cont.values()] + [(q, False) for q in disc.values()]
    if not all(0 <= q <= 1 for q, _ in wanted):
        raise ValueError("quantiles are from 0 to 1")
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(value).cast("double").alias("v"))
    ask = [min(1.0, max(0.0, q + e)) for q, _ in wanted for e in (-2 / _ACCURACY, 2 / _ACCURACY)]
    groups = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", ask, _ACCURACY).alias("s"))
    n, each = F.col("n"), []
    for j, (q, between) in enumerate(wanted):
        at = F.lit(q) * (n - 1) if between else (F.greatest(F.ceil(F.lit(q) * n), F.lit(1)) - 1).cast("double")
        each.append(F.struct(F.lit(j).alias("j"), at.alias("at"), F.col("s")[2 * j].alias("low"), F.col("s")[2 * j + 1].alias("high")))
    groups = spooled(groups.select(*keys, "n", F.explode(F.array(*each)).alias("t")).select(*keys, "n", "t.*"), "groups")
    settled = None
    brackets = groups.filter("n > 0").drop("n")
    while True:
        counted = spooled(_counted(rows, brackets, keys, held), "brackets")
        closed = counted.filter("not open")
        settled = closed if settled is None else settled.unionByName(closed)
        left = counted.filter("open")
        if left.isEmpty():
            break
        brackets = spooled(_narrowed(rows, left, keys), "brackets")
    picked = _picked(rows, settled, keys)
    wide = groups.join(picked, _same(keys) & (F.col("j") == F.col("g_j")), "left").groupBy(*keys)
    # one value at most for each group and quantile
    out = wide.agg(*(F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"q{j}") for j in range(len(wanted))))
    return out.toDF(*by, *cont, *disc)


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys), F.lit(True))


def _as_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"g_{c}" for c in (*keys, "j")})


def _met(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with its group's brackets; a table of few groups is broadcast by its size, a larger one shuffled."""
    own = _as_groups(brackets, keys)
    if not keys:
        own = F.broadcast(own)  # a row for each quantile
    return rows.filter("v is not null").join(own, _same(keys))


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str], held: int) -> DataFrame:
    """Brackets with the numbers of values below, on the ends and strictly inside, and whether they are still open: the ranks are not in
    the bracket, or not on its ends while more than `held` rows are inside."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    number = lambda c, name: F.count(F.when(c, 1)).alias(name)
    own = [*keys, "j", "at", "low", "high"]
    met = _met(rows, brackets, keys).select(*(F.col(f"g_{c}").alias(c) for c in (*keys, "j")), "at", "low", "high", "v")
    out = met.groupBy(*own).agg(number(v < low, "below"), number(v == low, "on_low"), number((v > low) & (v < high), "inside"), number((v == high) & (high > low), "on_high"))
    out = out.withColumns({"first": F.floor("at").cast("long"), "last": F.ceil("at").cast("long")})
    out = out.withColumn("upper", F.expr("below + on_low + inside"))
    out = out.withColumns({"holds": F.expr("below <= first and last < upper + on_high"), "on_ends": F.expr("last < below + on_low or first >= upper")})
    return out.withColumn("open", F.expr(f"not holds or not on_ends and inside > {held}"))


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Smaller brackets: steps of 1/250 around the ranks among what is inside, of which a sketch is off by a quarter at most; the
    least and greatest values where the ranks were missed. An end on which a rank lies stays."""
    among = F.expr("case when not holds or v > low and v < high then v end")
    own = ["j", "at", "low", "high", "below", "on_low", "inside", "upper", "first", "last", "holds"]
    met = _met(rows, brackets, keys).select(*(F.col(f"g_{c}").alias(c) for c in (*keys, "j")), *own[1:], "v")
    sketch = F.percentile_approx(among, [i / 250 for i in range(251)], _ACCURACY).alias("s")
    sketched = met.groupBy(*keys, *own).agg(sketch, F.min("v").alias("least"), F.max("v").alias("most"))
    step = lambda rank: F.try_divide(250 * (F.col(rank) - F.col("below") - F.col("on_low")), F.col("inside"))
    start = F.greatest(F.floor(step("first")) - 1, F.lit(0)).cast("int")
    stop = F.least(F.ceil(step("last")) + 2, F.lit(250)).cast("int")
    low = F.when(~F.col("holds"), F.col("least")).when(F.expr("first < below + on_low"), F.col("low")).otherwise(F.get("s", start))
    high = F.when(~F.col("holds"), F.col("most")).when(F.expr("last >= upper"), F.col("high")).otherwise(F.get("s", stop))
    return sketched.select(*keys, "j", "at", low.alias("low"), high.alias("high"))


def _picked(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """(g_keys, g_j, value): the values of the ranks, from the brackets' distinct values."""
    needed = F.expr("v = low or v = high or not on_ends and v > low and v < high")
    own = ["at", "low", "high", "below", "inside", "first", "last", "on_ends"]
    inside = _met(rows, brackets, keys).filter(needed).groupBy(*(f"g_{c}" for c in (*keys, "j")), *own, "v").agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy(*(f"g_{c}" for c in (*keys, "j"))).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # where the ranks lie on the ends, what is between them was left out
    skipped = F.expr("case when on_ends and v = high and high > low then inside else 0 end")
    placed = inside.withColumn("stop", F.col("below") + F.sum("c").over(up_to) + skipped).withColumn("start", F.expr("stop - c"))
    on = lambda rank: F.max(F.when(F.expr(f"start <= {rank} and {rank} < stop"), F.col("v")))
    ends = placed.groupBy(*(f"g_{c}" for c in (*keys, "j")), "at").agg(on("first").alias("a"), on("last").alias("b"))
    value = F.expr("case when a = b then a else a + (b - a) * (at - floor(at)) end").alias("value")
    return ends.select(*(f"g_{c}" for c in (*keys, "j")), value)
