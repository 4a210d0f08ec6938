from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import scalars, udfs
from brindle.operators.aggregates import two_step
from brindle.operators.joins import asof_join, range_join, salted_join
from brindle import session
from brindle.operators import sketches
from brindle.operators.ranking import distinct_on, groups_frame, qualify, sum_excluding, top_k
from brindle.sources import files
from brindle.streaming import events as streams

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_nulls_ties_and_missing(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 9, "d"), (1, 5, "a")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 10), (1, 5, 12), (1, 3, None), (2, 10, 7), (None, 1, 99)], "k int, t int, v int")
    assert rows(asof_join(left, right, "t", ["k"], ["v"])) == sorted([(1, 5, "a", 12), (1, 5, "a", 12), (1, 1, "b", None), (2, 9, "c", None), (None, 9, "d", None)], key=repr)
    assert asof_join(left.limit(0), right, "t", ["k"], ["v"]).count() == 0
    assert rows(asof_join(left, right.limit(0), "t", ["k"], ["v"]).select("v").distinct()) == [(None,)]


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_range_join_is_the_nested_loop(spark, width):
    points = spark.createDataFrame([(i, x) for i, x in enumerate([-7.5, -3.0, 0.0, 2.0, 2.0, 9.99, 10.0, None])], "p int, x double")
    spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(-8.0, -3.0), (0.0, 2.0), (2.0, 10.0), (5.0, 4.0), (-100.0, 100.0), (None, 3.0)])], "r int, a double, b double")
    want = points.crossJoin(spans).filter("x >= a and x <= b").select("p", "r")
    got = range_join(points, spans, F.col("x"), F.col("a"), F.col("b"), width)
    assert rows(got.select("p", "r")) == rows(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join(spark, how):
    large = spark.range(200).selectExpr("if(id < 150, 0, id) as k", "id as x")
    small = spark.createDataFrame([(0, "hot"), (160, "a"), (160, "b"), (999, "c")], "k long, y string")
    assert rows(salted_join(large, small, ["k"], 7, how)) == rows(large.join(small, "k", how))
    with pytest.raises(ValueError):
        salted_join(large, small, ["k"], 7, "full")


def test_two_step_aggregation(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as x")
    got = two_step(df, ["k"], {"s": F.sum("x"), "n": F.count("x")}, {"s": F.sum("s"), "n": F.sum("n")}, 5)
    assert rows(got) == rows(df.groupBy("k").agg(F.sum("x"), F.count("x")))


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", 2, 1), ("a", 4, 2), ("b", 1, None)], "g string, o int, v int")
    assert rows(top_k(df, ["g"], [F.col("o"), F.desc("v")], 2)) == [("a", 1, 5), ("a", 1, 7), ("b", 1, None)]
    assert rows(distinct_on(df, ["g"], [F.desc("o")])) == [("a", 4, 2), ("b", 1, None)]
    assert rows(qualify(df, F.col("v") > 4)) == [("a", 1, 5), ("a", 1, 7)]
    framed = groups_frame(df, ["g"], "o", F.sum("v"), 1, 0, "s")
    assert rows(framed.select("g", "o", "v", "s")) == [("a", 1, 5, 12), ("a", 1, 7, 12), ("a", 2, 1, 13), ("a", 4, 2, 3), ("b", 1, None, None)]


def test_scalars(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], '{"k": 5}', "https://a.b/c"), ([0.0, 0.0], [1.0, 1.0], '{"k": "x"}', "no url"), (None, None, None, None)], "a array<float>, b array<float>, j string, u string")
    got = df.select(scalars.cosine(F.col("a"), F.col("b")), scalars.json_number(F.col("j"), "$.k"), scalars.host(F.col("u")))
    assert rows(got) == sorted([(1.0, 5, "a.b"), (None, None, None), (None, None, None)], key=repr)
    assert rows(df.select(udfs.initials(F.lit("ab cd")))) == [("ac",)] * 3


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv", "xml"])
def test_formats_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "é, x", 2.5), (2, None, None)], "a int, b string, c double")
    files.write(df, f"{tmp_path}/{kind}", kind)
    assert rows(files.read(spark, f"{tmp_path}/{kind}", kind, df.schema)) == rows(df)


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, "x", "csv")
    files.write(spark.createDataFrame([("a",), ("b",)], "value string"), f"{tmp_path}/t", "text")
    assert rows(files.read(spark, f"{tmp_path}/t", "text")) == [("a",), ("b",)]
    files.write(spark.range(6).selectExpr("id", "id % 2 as p"), f"{tmp_path}/p", "parquet", ["p"])
    plan = files.read(spark, f"{tmp_path}/p", "parquet").filter("p = 1")
    assert "PartitionFilters: [isnotnull(p" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 3
    assert files.available(spark, "parquet") and not files.available(spark, "no-such-format")


def write_events(spark, folder, name, items):
    made = [(i, T0 + timedelta(minutes=m), u, "view", v, "{}") for i, m, u, v in items]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, lateness):
    frame = spark.readStream.schema(streams.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    return frame.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def test_late_rows_and_state(spark, tmp_path):
    for k, items in enumerate([[(1, 0, 1, 1.0), (2, 130, 1, 2.0)], [(4, 125, 2, 8.0)], [(3, 5, 1, 4.0), (5, 400, 2, 16.0)]]):
        write_events(spark, tmp_path, f"b{k}", items)
        for f in (tmp_path / f"b{k}").glob("*.parquet"):
            __import__("os").utime(f, (1_700_000_000 + 60 * k,) * 2)
    got = streams.drained(streams.tumbling(stream(spark, tmp_path, "10 minutes")), "append")
    # the row at minute 5 comes two batches after the watermark has passed it and is dropped; the window at 400 stays open
    assert rows(got.select("n", "total")) == [(1, 1.0), (2, 10.0)]
    totals = streams.drained(streams.running_totals(stream(spark, tmp_path, "10 minutes")), "update", by=["user_id"])
    assert rows(totals) == [(1, 3, 7.0), (2, 2, 24.0)]
    deduplicated = streams.drained(streams.deduplicated(stream(spark, tmp_path, "10 minutes"), ["user_id"]).select("user_id"), "append")
    assert {r[0] for r in rows(deduplicated)} == {1, 2}


def test_sessions_a_gap_apart_are_one(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=m), 1, 1.0) for i, m in enumerate((0, 29, 59, 90))], "event_id long, ts timestamp_ntz, user_id long, value double")
    assert rows(streams.sessions(df).select("n")) == [(1,), (3,)]


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
def test_sum_excluding_is_the_definition(spark, exclude):
    data = [("a", 1, 5), ("a", 1, 7), ("a", 1, None), ("a", 2, 1), ("a", 4, 2), ("a", 4, 9), ("b", 1, None), ("b", None, 3), (None, 1, 4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, g string, o int, v int").coalesce(1)
    placed = df.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect()
    want = {}
    for r in placed:
        frame = [x for x in placed if x.g == r.g and r["at"] - 2 <= x["at"] <= r["at"] + 1]
        kept = [x.v for x in frame if x.v is not None and not (x.i == r.i and exclude != "ties" or x.o == r.o and x.i != r.i and exclude != "current row")]
        want[r.i] = sum(kept) if kept else None
    got = sum_excluding(df, ["g"], "o", "v", 2, 1, exclude, "s")
    assert got.columns == ["i", "g", "o", "v", "s"]
    assert {r.i: r.s for r in got.collect()} == want


def test_count_min_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (7,)], "k long")
    got = sketches.count_min_estimates(sketches.count_min(df, "k"), spark.createDataFrame([(1,), (7,), (9,)], "k long"), "k")
    assert rows(got) == [(1, 2), (7, 1), (9, 0)]
    assert sketches.count_min(df.limit(0), "k").count() == 0


def test_range_join_of_very_long_ranges(spark):
    points = spark.range(200).selectExpr("id as p", "id * 5000000.0 - 1e8 as x")
    spans = spark.createDataFrame([(0, -1e8, 9e8), (1, 0.0, 1.0), (2, 3.0, 70.0), (3, -5e6, 6e6), (4, 1e8, 1e8)], "r int, a double, b double")
    got = range_join(points, spans, F.col("x"), F.col("a"), F.col("b"), 1.0)
    assert rows(got.select("p", "r")) == rows(points.crossJoin(spans).filter("x >= a and x <= b").select("p", "r"))
    assert range_join(points, spans.limit(0), F.col("x"), F.col("a"), F.col("b"), 1.0).count() == 0


def test_a_stream_without_files_gives_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    empty = streams.event_stream(spark, str(tmp_path / "none"))
    for mode in ("complete", "append"):
        assert streams.drained(streams.tumbling(empty), mode).count() == 0
    assert streams.in_memory(empty.groupBy("event_type").count(), "complete", "no_events").count() == 0


def test_a_cluster_names_its_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
    Session.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: "hdfs://shared")})()
    assert session.shared_dir(Session()) == "hdfs://shared"


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name, n in (("brindle_test_a", 50), ("brindle_test_b", 80)):
        files.write_bucketed(spark.range(n).selectExpr("id as k", f"'{name}' as v"), name, ["k"], 4)
    joined = spark.table("brindle_test_a").hint("merge").join(spark.table("brindle_test_b"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50
    for name in ("brindle_test_a", "brindle_test_b"):
        spark.sql(f"drop table {name}")
