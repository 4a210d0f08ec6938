"""Operators that keep a hot key from one task: prefix scans, exact quantiles, salts; and that no operator touches the user's columns."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import ranking, sketches
from brindle.operators.aggregates import dealt_salt, two_step
from brindle.operators.joins import asof_join, range_join, salted_join
from brindle.operators.quantiles import exact_percentiles
from brindle.operators.ranking import by_rows, distinct_on, groups_frame, qualify, sum_excluding, sums_excluding, top_k
from brindle.operators.scan import in_ranges, running


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def hot(spark, n=4000):
    """Half of the rows have one key; null keys, null values and ties."""
    return spark.range(n).selectExpr("case when id % 2 = 0 then 'hot' when id % 97 = 1 then null else concat('k', id % 13) end as k", "(id * 7919) % 400 as t", "if(id % 5 = 0, null, id) as v", "id as part", "id as tie", "id as c0")


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("ranges", [1, 7])
def test_running_is_the_window(spark, by, ranges):
    df = hot(spark)
    window = Window.partitionBy(*by).orderBy("t", "part").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    want = df.select("*", F.sum(v).over(window).alias("s"), F.count(v).over(window).alias("n"), F.min(v).over(window).alias("low"), F.max(v).over(window).alias("high"), F.last(v, ignorenulls=True).over(window).alias("last"))
    got = running(df, by, ["t", "part"], {"s": ("sum", v), "n": ("count", v), "low": ("min", v), "high": ("max", v), "last": ("last", v)}, ranges)
    assert got.columns == want.columns and rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, "the written ranges meet a broadcast of their ends"


def test_running_of_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("a", None)] * 10 + [(None, 2)] * 5, "k string, t int")
    got = running(df, ["k"], ["t"], {"i": ("count", F.lit(1))}, 6)
    assert rows(got) == sorted([("a", None, i) for i in range(1, 11)] + [("a", 1, i) for i in range(11, 61)] + [(None, 2, i) for i in range(1, 6)], key=repr)
    assert running(df.limit(0), ["k"], ["t"], {"i": ("count", F.lit(1))}).count() == 0
    twice = df.select("k", "t", F.col("t").alias("t"), F.create_map(F.lit("x"), "t").alias("i"))
    assert running(twice, ["k"], ["k"], {"i": ("sum", F.lit(1))}, 2).columns == ["k", "t", "t", "i", "i"]


@pytest.mark.parametrize("order", [["k", "t"], ["t"]])
def test_a_hot_key_or_none_is_spread(spark, order):
    for df in (hot(spark, 40_000), hot(spark, 40_000).withColumn("t", F.lit(1))):
        sizes = [r["count"] for r in in_ranges(df.select("k", "t"), order, 8).groupBy("part").count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * median(sizes)


def test_asof_is_the_definition(spark):
    rng = random.Random(5)
    left = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(30)]), i) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, 1, 2, 3]), f"n{i}") for i in range(200)]
    want = []
    for k, t, i in left:
        before = [r for r in right if k is not None and r[0] == k and (r[1] is None or t is not None and r[1] <= t)]
        top = max(before, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0, r[3]), default=(None,) * 4)
        want.append((k, t, i, top[2], top[3]))
    got = asof_join(spark.createDataFrame(left, "k string, t int, v int"), spark.createDataFrame(right, "k string, t int, v int, name string"), "t", ["k"], ["v", "name"])
    assert got.columns == ["k", "t", "v", "v_right", "name"] and rows(got) == sorted(want, key=repr)


def exact(values, q, cont):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    if not cont:
        return values[max(math.ceil(q * len(values)), 1) - 1]
    at = q * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if a == b else a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("held", [1 << 16, 3])
@pytest.mark.parametrize("by", [["k"], []])
def test_percentiles_are_exact(spark, held, by):
    rng = random.Random(7)
    data = [("hot", rng.choice([rng.gauss(0, 100), 7.5, -1.0])) for _ in range(3000)] + [("ties", 4.0)] * 500 + [("two", v) for v in (1.0, 2.0)] + [("one", 3.0), ("none", None), (None, 8.0), (None, 9.0)] + [("many", float(i)) for i in range(2000)] + [("hot", None)] * 20
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, n double").select("k", "n", F.col("n").alias("v"))
    cont, disc = {"c0": 0.0, "c25": 0.25, "c50": 0.5, "c999": 0.999, "c1": 1.0}, {"d0": 0.0, "d10": 0.1, "d50": 0.5, "d1": 1.0}
    got = exact_percentiles(df, by, "n", cont, disc, held)
    groups = {}
    for k, v in data:
        groups.setdefault((k,) if by else (), []).append(v)
    want = [(*k, *(exact(v, q, True) for q in cont.values()), *(exact(v, q, False) for q in disc.values())) for k, v in groups.items()]
    assert got.columns == [*by, *cont, *disc]
    assert sorted(((*r[: len(by)], *(x if x is None else round(x, 9) for x in r[len(by) :])) for r in rows(got)), key=repr) == sorted(((*r[: len(by)], *(x if x is None else round(x, 9) for x in r[len(by) :])) for r in want), key=repr)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, n double")
    assert exact_percentiles(empty, ["k"], "n", {"m": 0.5}).count() == 0
    assert rows(exact_percentiles(empty, [], "n", {"m": 0.5}, {"d": 0.5})) == [(None, None)]
    with pytest.raises(ValueError):
        exact_percentiles(empty, [], "n", {"m": 1.5})


def test_salts_part_equal_rows_and_take_maps(spark):
    same = spark.range(1000).select(F.lit("k").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.lit(5).alias("_salt"))
    sizes = [r["count"] for r in same.groupBy(dealt_salt(16).alias("s")).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * min(sizes)
    assert rows(two_step(same, ["k"], {"n": F.count("m"), "x": F.max("_salt")}, {"n": F.sum("n"), "x": F.max("x")}, 16)) == [("k", 1000, 5)]
    small = spark.createDataFrame([("k", "y", 9)], "k string, y string, other int")
    joined = salted_join(same, small, ["k"], 16)
    assert joined.columns == ["k", "m", "_salt", "y", "other"] and joined.count() == 1000


def test_the_copies_of_a_salted_join_are_never_broadcast(spark, tmp_path):
    # files so small that a plan by size would collect the copies on the driver
    spark.range(2000).selectExpr("id % 50 as k", "id as y").write.parquet(f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small")
    large = spark.range(5000).selectExpr("if(id % 2 = 0, 0, id % 60) as k", "id as x")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(large, small, ["k"], 16, how)
        assert got.count() == large.join(small, ["k"], how).count()
        got.collect()
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_frames_that_exclude_share_a_sort(spark):
    df, kinds = hot(spark).select("k", "t", "v", "part"), {"a": "current row", "b": "group", "c": "ties"}
    got = sums_excluding(df, ["k"], "t", "v", 2, 1, kinds)
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    own = df.join(df.groupBy("k", "t").count().filter("count = 1"), ["k", "t"], "left_semi")
    both = sums_excluding(own, ["k"], "t", "v", 2, 1, kinds)
    for name, kind in kinds.items():
        assert rows(both.select("k", "t", name)) == rows(sum_excluding(own, ["k"], "t", "v", 2, 1, kind, "s").select("k", "t", "s"))


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_PART", 100)
    dealt = by_rows(hot(spark), ["k", "t"])
    assert dealt.rdd.getNumPartitions() == 40 and rows(dealt) == rows(hot(spark))
    assert by_rows(hot(spark).limit(0), ["k"]).count() == 0


def test_no_operator_touches_the_users_columns(spark):
    names = ["_rank", "_keep", "_group", "_at", "_peer", "_level", "_bucket", "_salt", "row", "cell"]
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0)], "g string, o int, x double").select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    for got in (
        top_k(df, ["g"], [F.col("o")], 2),
        distinct_on(df, ["o"], [F.col("g")]),
        qualify(df, F.col("o") > 0),
        groups_frame(df, ["g"], "o", F.sum("o"), 1, 0, "s").drop("s"),
        sum_excluding(df, ["g"], "o", "o", 1, 0, "ties", "s").drop("s"),
        range_join(df, spark.createDataFrame([(0.0, 9.0)], "low double, high double"), F.col("x"), F.col("low"), F.col("high"), 1.0).drop("low", "high"),
    ):
        assert got.columns == df.columns and rows(got) == rows(df)
    keys = spark.createDataFrame([(1, 2, "a"), (None, 3, "b")], "row int, cell int, k0 string")
    sketch = sketches.count_min(keys, "row")
    assert rows(sketches.count_min_estimates(sketch, keys, "row")) == [(1, 2, "a", 1), (None, 3, "b", 0)]
