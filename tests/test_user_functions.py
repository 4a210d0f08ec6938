"""Aggregates whose states merge and table functions over tables, against their definitions."""

from datetime import date, datetime, timedelta
from statistics import fmean, stdev

import pytest
from pyspark.sql import functions as F

from brindle import plans
from brindle.functions import mergeable, udfs
from brindle.functions.mergeable import Largest, Moments, user_aggregate
from brindle.functions.tables import FillDays, filled_days


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("by", [["k"], ["k", "j"], []])
def test_merged_states_are_the_aggregate(spark, monkeypatch, by):
    monkeypatch.setattr(mergeable, "HELD", 2)
    data = [("hot", i % 2, float(i % 50)) for i in range(600)] + [(None, 1, 2.0), (None, 1, 4.0), ("none", None, None), ("one", 3, 5.0), ("hot", 1, None)]
    df = spark.createDataFrame(data, "k string, j int, v double").repartition(7)
    groups = {}
    for k, j, v in data:
        groups.setdefault((k, j)[: len(by)], []).append(v)
    want = []
    for key, values in groups.items():
        values = [v for v in values if v is not None]
        want.append((*key, len(values), round(fmean(values), 9) if values else None, round(stdev(values), 9) if len(values) > 1 else None))
    got = user_aggregate(df, by, ["v"], Moments(), salts=3)
    assert got.columns == [*by, "n", "mean", "sd"]
    assert sorted(((*r[:-2], *(x if x is None else round(x, 9) for x in r[-2:])) for r in rows(got)), key=repr) == sorted(want, key=repr)
    top = user_aggregate(df, by, ["v"], Largest(2), salts=3)
    assert rows(top) == sorted(((*k, sorted((v for v in vs if v is not None), reverse=True)[:2]) for k, vs in groups.items()), key=repr)
    assert user_aggregate(df.limit(0), by, ["v"], Moments()).count() == 0


def test_a_hot_key_reaches_no_worker_whole(spark):
    """A worker gets states, as many as there are tasks, not rows."""

    class Counted(Moments):
        def merge(self, a, b):
            assert b[0] <= 500, "a task's state is of its own 500 rows"
            n = a[0] + b[0]
            return (n if n < 500 else 500, 0.0, 0.0)

    df = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v")).repartition(8)
    assert user_aggregate(df, ["k"], ["v"], Counted(), salts=4).count() == 1


def test_days_are_filled(spark):
    t0 = datetime(2024, 1, 30, 12)
    data = [("a", t0 + timedelta(days=d)) for d in (0, 0, 3, 4)] + [(None, t0), ("b", None)]
    got = filled_days(spark.createDataFrame(data, "k string, ts timestamp_ntz"), "k", "ts")
    assert got.columns == ["k", "day", "n", "carried"]
    day = date(2024, 1, 30)
    want = [("a", day, 2, 2), ("a", day + timedelta(1), 0, 2), ("a", day + timedelta(2), 0, 2), ("a", day + timedelta(3), 1, 1), ("a", day + timedelta(4), 1, 1), (None, day, 1, 1)]
    assert rows(got) == sorted(want, key=repr)
    assert filled_days(spark.createDataFrame([], "k bigint, ts timestamp_ntz"), "k", "ts").count() == 0
    with pytest.raises(Exception, match="key, day date, n bigint"):
        FillDays(spark.createDataFrame([(1, 2)], "k int, n int").asTable().partitionBy("k")).collect()


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_trimmed_means_of_many_groups_are_those_of_one_each(spark, batch):
    data = [("hot", 0, float(i * 7 % 100)) for i in range(95)] + [(None, i % 3, float(i)) for i in range(30)] + [("none", 1, None), ("nan", 1, float("nan")), ("nan", 1, 4.0), ("hot", None, 5.0), ("hot", None, None)]
    data += [(f"k{i}", 2**60 + i, 1.0 * i) for i in range(200)]
    df = spark.createDataFrame(data, "mean string, j bigint, v double").repartition(5)
    want = rows(df.groupBy("mean", "j").agg(udfs.trimmed_mean("v")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = udfs.trimmed_means(df, ["mean", "j"], "v")
        assert got.columns == ["mean", "j", "mean"] and rows(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert udfs.trimmed_means(df.limit(0), ["j"], "v").count() == 0


def test_a_call_takes_many_groups(spark):
    plan = plans.QUERIES["udf_pandas_aggregate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowAggregatePython" not in plan and "AggregateInPandas" not in plan
