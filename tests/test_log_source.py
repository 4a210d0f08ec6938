"""The log source: filters, steps, repeated and killed tasks, streams in and out."""

from pathlib import Path

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from brindle.sources.log import LogSource, Segment, _Log, _Reading, read_log
from brindle.streaming.events import drained


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def log(spark, tmp_path):
    spark.dataSource.register(LogSource)
    return f"{tmp_path}/log"


def table(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id", "if(id % 7 = 0, null, concat('s', id % 5)) as s", "id * 0.5 as x", "timestamp_ntz'2024-01-01 00:00:00' as t", "array(id) as a")


def write(df, path, mode="append", **options):
    df.write.format("brindle_log").options(path=path, **options).mode(mode).save()


def test_round_trip_and_overwrite(spark, log):
    write(table(spark, 100), log, batch=7)
    write(table(spark, 50, 100), log)
    read = lambda **o: spark.read.format("brindle_log").options(path=log, **o).load()
    for step in (1, 20, 10_000):
        assert rows(read(step=step)) == rows(table(spark, 150))
    assert read(step=1).rdd.getNumPartitions() > read(step=10_000).rdd.getNumPartitions()
    write(table(spark, 3), log, "overwrite")
    assert rows(read()) == rows(table(spark, 3))
    write(table(spark, 0), log)
    assert rows(read()) == rows(table(spark, 3))
    with pytest.raises(Exception, match="no log at"):
        spark.read.format("brindle_log").option("path", f"{log}-none").load()


def test_partitions_grow_where_steps_would_be_too_many(tmp_path):
    commits = lambda n: [{"segments": [{"name": f"{k}", "batches": [500] * n, "bounds": {}} for k in range(4)]}]
    reading = _Reading({"path": f"{tmp_path}", "step": 700}, None)
    assert len(reading._spans(commits(40))) == 80
    spans = reading._spans(commits(10_000))
    assert len(spans) <= 1004
    for k in range(4):  # every batch once
        own = [s for s in spans if s.name == f"{k}"]
        assert [i for s in own for i in range(s.first, s.stop)] == list(range(10_000))


def test_filters_leave_segments_and_rows_out(spark, log):
    for k in range(4):
        write(table(spark, 100, 100 * k).coalesce(1), log, batch=10)
    for condition in ("id = 250", "id > 390 and s = 's3'", "id <= 5", "s is not null and id < 10", "x > 100.0 and id >= 300", "s is null", "id = -1", "id < 390 or s = 's1'"):
        assert rows(read_log(spark, log, condition, step=10_000)) == rows(table(spark, 400).filter(condition)), condition
    parts = [read_log(spark, log, c, step=10_000).rdd.getNumPartitions() for c in ("id = 250", "id >= 150 and id < 250", None)]
    assert parts == [1, 2, 4] and rows(read_log(spark, log)) == rows(table(spark, 400))


def test_a_task_that_fails_leaves_no_row(spark, log):
    write(table(spark, 20), log)

    def fail_late(batches):
        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 1:
            raise RuntimeError("killed")

    bad = table(spark, 40).repartition(2).mapInArrow(fail_late, table(spark, 1).schema)
    with pytest.raises(Exception, match="killed"):
        write(bad, log)
    assert rows(spark.read.format("brindle_log").option("path", log).load()) == rows(table(spark, 20))


def test_a_commit_of_a_stream_counts_once(spark, log):
    write(table(spark, 5), log)
    own = _Log(log)
    (Path(log) / "segments" / "again.arrow").write_bytes(b"")
    held = len(own.commits())
    for _ in range(2):
        own.commit([Segment("again.arrow", [])], table(spark, 1).schema, stream="q", batch=3)
    assert len(own.commits()) == held + 1 and not (Path(log) / "segments" / "again.arrow").exists()


@pytest.mark.parametrize("step", [1, 4, 1000])
def test_a_stream_reads_all_rows_for_any_step(spark, log, step):
    for k in range(3):
        write(table(spark, 20, 20 * k), log, batch=3)
    got = drained(spark.readStream.format("brindle_log").options(path=log, step=step).load(), "append")
    assert rows(got) == rows(table(spark, 60))


def test_a_stream_writes_and_goes_on(spark, log, tmp_path):
    for k in range(2):
        table(spark, 30, 30 * k).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(table(spark, 1).schema).parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("brindle_log").options(path=log, checkpointLocation=f"{tmp_path}/cp", stream="q").trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows(spark.read.format("brindle_log").option("path", log).load()) == rows(table(spark, 60))
    assert spark.read.format("brindle_log").option("path", log).load().agg(F.count_distinct("id")).first()[0] == 60
