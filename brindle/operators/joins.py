"""Joins that Spark SQL has no syntax for, as compositions of its own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.aggregates import dealt_salt
from brindle.operators.names import unused
from brindle.operators.scan import running


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """left with the values of the last row of right, per key, whose `on` is not after left's.

    Both sides are united and dealt by ranges of (keys, on), over which the last row of right is carried on by prefix scan: no pairs, and
    no task that sorts a hot key. Rows of left without a match keep nulls, rows that repeat are rows each; a null key matches nothing;
    a null `on` is before all others. Among rows of right with equal `on` the largest values in order win, nulls the least. A value whose
    name left has comes as `<name>_right`. Columns: keys, on, the others of left, values. Ranges are written when this is called.
    """
    others = [c for c in left.columns if c not in by and c != on]
    keys = [f"k{i}" for i in range(len(by))]
    named = lambda df: [df[b].alias(k) for b, k in zip(by, keys)]
    own = F.struct(*(left[c].alias(f"c{i}") for i, c in enumerate(others)), F.lit(1).alias("one"))
    found = F.struct(*(right[v].alias(f"v{i}") for i, v in enumerate(values)))
    rows = left.select(*named(left), left[on].alias("at"), F.lit(1).alias("side"), own.alias("own"))
    rows = rows.unionByName(right.select(*named(right), right[on].alias("at"), F.lit(0).alias("side"), found.alias("found")), allowMissingColumns=True)
    seen = running(rows, keys, ["at", "side", "found"], {"last": ("last", F.col("found"))}).filter("side = 1")
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    out: list[str] = [*by, on, *others]
    for v in values:
        out.append(v if v.lower() not in {c.lower() for c in out} else _free(f"{v}_right", out))
    return seen.select(*keys, "at", *(F.col(f"own.c{i}") for i in range(len(others))), *(F.when(known, F.col(f"last.v{i}")) for i in range(len(values)))).toDF(*out)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


#: Buckets of one width that a range may meet; a longer one goes to buckets as many times as wide.
_REACH = 64


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of points and ranges with low <= point <= high (finite numbers), joined by equality of buckets of `width`.

    A range is written once for each bucket it meets, a point to its own bucket: an equi-join that shuffles and
    splits like any other, in place of a nested loop. Choose width near the ranges' usual length. Ranges over more
    than 64 buckets go to coarser levels, 64 times as wide each, and points to a bucket of every level that some range is in,
    so that neither a long range nor a point is written more than some 65 times a level. Nulls, and ranges whose low is above their
    high, join nothing; rows that repeat join each. All columns of both sides come out.
    """
    in_level, bucket = unused("_level", points, ranges), unused("_bucket", points, ranges)
    wide = lambda level: F.lit(width) * F.pow(F.lit(float(_REACH)), level)
    cell = lambda c, level: F.floor(c / wide(level))
    span = F.greatest((high - low) / F.lit(width), F.lit(1.0))
    level = F.greatest(F.ceil(F.log(float(_REACH), span)) - 1, F.lit(0)).cast("int")
    spread = ranges.filter(low <= high).withColumn(in_level, level)
    levels = [r[0] for r in spread.select(in_level).distinct().collect()] or [0]
    spread = spread.withColumn(bucket, F.explode(F.sequence(cell(low, F.col(in_level)), cell(high, F.col(in_level)))))
    dealt = points.withColumn(in_level, F.explode(F.array(*(F.lit(k) for k in sorted(levels))))) if len(levels) > 1 else points.withColumn(in_level, F.lit(levels[0]))
    dealt = dealt.withColumn(bucket, cell(point, F.col(in_level)))
    return dealt.join(spread, [in_level, bucket]).filter((point >= low) & (point <= high)).drop(in_level, bucket)


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose keys are spread over `salts` partitions each: for hot keys where AQE cannot split a side.

    Every row of small is written salts times, and both sides are shuffled: a plan's size of the copies is that of small's files, so that a
    broadcast chosen by it would bring all copies to the driver. Only joins that keep no unmatched row of small are allowed. Null keys match
    nothing, as in any equi-join; columns are those of the join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: a copied row of the small side would come out once for each salt")
    salt = unused("_salt", large, small)
    dealt = large.withColumn(salt, dealt_salt(salts))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copies.hint("merge"), [*on, salt], how).drop(salt)
