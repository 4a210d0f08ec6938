"""Streams that move: expiring state, timers, late rows, outer joins, maps that forget; on small tables portion by portion."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from brindle.plans import QUERIES
from brindle.streaming import replay, state
from brindle.streaming.events import deduplicated

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clicks(spark, items):
    made = [(p, k, None if m is None else T0 + timedelta(minutes=m), v) for p, k, m, v in items]
    return spark.createDataFrame(made, "portion int, k string, ts timestamp_ntz, value double")


def test_late_rows_are_dropped_and_a_null_portion_never_comes(spark):
    df = clicks(spark, [(0, "a", 0, 1.0), (0, "a", 130, 2.0), (1, "a", 5, 4.0), (1, "a", 125, 8.0), (2, "b", 400, 16.0), (None, "a", 1, 32.0)])
    plan = lambda s: state.with_time(s, "ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.sum("value").alias("v")).select("window.start", "v")
    sent = replay.replayed(df, F.col("portion"), plan, "append")
    # minute 5 comes when the watermark stands at 120
    assert [v for _, v in rows(sent.select("start", "v"))] == [1.0, 10.0]
    assert replay.replayed(df.limit(0), F.col("portion"), plan, "append").count() == 0


def test_a_key_comes_out_again_once_it_expired(spark):
    df = clicks(spark, [(0, "a", 0, 1.0), (0, None, 0, 1.0), (1, "a", 20, 2.0), (2, "b", 60, 3.0), (3, "a", 61, 4.0), (3, "a", 62, 4.0), (3, None, 61, 1.0), (4, "b", 63, 5.0)])
    sent = replay.replayed(df, F.col("portion"), lambda s: deduplicated(state.with_time(s, "ts", "15 minutes"), ["k"]).select("k", "portion"), "append")
    assert rows(sent.select("k", "portion")) == sorted([("a", 0), (None, 0), ("b", 2), ("a", 3), (None, 3)], key=repr)


def test_timers_close_sessions_that_rows_out_of_order_joined(spark):
    items = [(0, "a", 0, 1.0), (0, "a", 50, 2.0), (0, None, 10, None), (1, "a", 25, 4.0), (1, "b", 100, 8.0), (1, "a", None, 9.0), (2, "a", 300, 16.0), (3, "b", 20, 99.0), (3, "b", 600, 1.0)]
    sent = replay.replayed(clicks(spark, items), F.col("portion"), lambda s: state.timed_sessions(state.with_time(s, "ts", "60 minutes"), "k", 30 * 60), "append", rocks=True)
    got = sent.select("k", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n", "total")
    at = lambda m: T0 + timedelta(minutes=m)
    # 0, 25 and 50 are one session; b's minute 20 comes too late; 600 is still open
    want = [("a", at(0), at(80), 3, 7.0), (None, at(10), at(40), 1, None), ("b", at(100), at(130), 1, 8.0), ("a", at(300), at(330), 1, 16.0)]
    assert rows(got) == sorted(want, key=repr)


def test_rows_of_one_time_are_in_one_session(spark):
    """A session may begin with several, in any order and in other portions."""
    items = [(0, "a", 0, 1.0), (0, "a", 100, 2.0), (0, "a", 100, None), (1, "a", 100, 8.0), (1, "a", 131, 16.0), (1, "a", 131, 32.0), (2, "z", 400, 0.0)]
    sent = replay.replayed(clicks(spark, items), F.col("portion"), lambda s: state.timed_sessions(state.with_time(s, "ts", "60 minutes"), "k", 30 * 60), "append", rocks=True)
    got = sent.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n", "total")
    at = lambda m: T0 + timedelta(minutes=m)
    assert rows(got) == [(at(0), at(30), 1, 1.0), (at(100), at(130), 3, 10.0), (at(131), at(161), 2, 48.0)]


def test_sessions_that_end_in_the_millisecond_of_the_watermark(spark, tmp_path):
    """Those up to its very microsecond are closed, as the SQL has them."""
    at = lambda us: datetime(2024, 1, 5, 10) + timedelta(microseconds=us)
    items = [(1, at(300)), (2, at(500)), (3, at(0)), (4, at(501)), (5, at(-1)), (6, at(500) + timedelta(days=20, minutes=30)), (7, at(1001))]
    df = spark.createDataFrame([(c, t, t, 1.5) for c, t in items], "client_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value double")
    df.write.parquet(f"{tmp_path}/clicks.parquet")
    got = QUERIES["stream_timed_sessions"](spark, str(tmp_path))
    assert rows(got) == [(c, t, t + timedelta(minutes=30), 1, 1.5) for c, t in items if c in (1, 2, 3, 5)]


def test_sessions_of_many_clients_are_few_rows_of_state(spark, tmp_path, monkeypatch):
    """Clients share a state by the hundred, however many clicks wait; one has a fifth of them, and ties, nulls and late arrivals join as ever."""
    rng, items = random.Random(4), []
    for c in [*range(300), *[2**60] * 80]:
        at = T0 + timedelta(days=rng.randrange(80), seconds=rng.randrange(86_400))
        for _ in range(rng.randint(1, 6)):
            items.append((c, at, at + timedelta(hours=rng.randrange(72)), rng.choice([None, 1.25, 2.5])))
            at += timedelta(minutes=rng.choice([0, 10, 30, 31]), microseconds=rng.randrange(2))
    items.append((1, T0 + timedelta(days=119), T0 + timedelta(days=119), 1.0))
    spark.createDataFrame(items, "client_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value double").write.parquet(f"{tmp_path}/clicks.parquet")
    held, ends = [], StreamingQuery.awaitTermination

    def ended(query):
        ends(query)
        held.extend(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)

    monkeypatch.setattr(StreamingQuery, "awaitTermination", ended)
    got = QUERIES["stream_timed_sessions"](spark, str(tmp_path))
    made = {}
    for c, at, _, value in sorted(items, key=lambda i: i[:2]):
        own = made.setdefault(c, [])
        if not own or at > own[-1][-1][0] + timedelta(minutes=30):
            own.append([])
        own[-1].append((at, value))
    want = [(c, s[0][0], s[-1][0] + timedelta(minutes=30), len(s), sum(v or 0.0 for _, v in s)) for c, own in made.items() for s in own]
    assert rows(got) == sorted((w for w in want if w[2] <= T0 + timedelta(days=99)), key=repr) and len(want) > 300
    assert 0 < max(held) < 20


def test_pauses_of_rows_out_of_order(spark):
    df = clicks(spark, [(0, "1", 0, 0.0), (0, "1", 100, 0.0), (1, "1", 40, 0.0), (2, "1", 130, 0.0), (3, "1", 131, 0.0), (3, None, 5, 0.0)])
    events = df.select("portion", F.col("k").cast("bigint").alias("user_id"), "ts")
    sent = replay.latest(replay.replayed(events, F.col("portion"), lambda s: state.longest_gaps(state.with_time(s, "ts", "90 minutes")), "update", rocks=True), ["user_id"])
    assert rows(sent.filter("user_id is not null")) == [(1, 5, 3600.0)]  # 40 to 100, not 0 to 100


def test_a_map_forgets(spark):
    df = clicks(spark, [(0, "a", 0, 1.0), (0, "b", 0, 1.0), (1, "a", 1, 1.0), (1, None, 1, 1.0)]).select("portion", F.lit(7).cast("bigint").alias("client_id"), F.col("k").alias("kind"))
    kept = replay.replayed(df, F.col("portion"), state.kinds_so_far, "update", rocks=True)
    assert rows(replay.latest(kept, ["client_id"])) == [(7, 2, "a", 2)]
    gone = replay.replayed(df, F.col("portion"), lambda s: state.kinds_so_far(s, ttl_ms=1), "update", rocks=True, once=True)
    assert rows(replay.latest(gone, ["client_id"])) == [(7, 1, "a", 1)]


def test_a_part_of_clients_counts_as_each_one_would(spark):
    big = 2**60
    items = [(p, k, c) for p in range(2) for i in range(40) for k, c in [("ab"[(i + p) % 2], big + i % 7)]] + [(0, None, 3), (0, "a", None), (1, "b", None), (1, "b", None)]
    df = spark.createDataFrame(items, "portion int, kind string, client_id bigint")
    got = replay.latest(replay.replayed(df, F.col("portion"), lambda s: state.kinds_of_parts(s, 10), "update", rocks=True), ["client_id"])
    want = []
    for client in {c for _, _, c in items}:
        n = Counter(k for _, k, c in items if c == client and k)
        top = min(n, key=lambda k: (-n[k], k), default=None)
        want.append((client, len(n), top, n.get(top, 0)))
    assert (None, 2, "b", 2) in want and rows(got) == sorted(want, key=repr)


def test_outer_joins_send_what_the_watermark_evicts(spark):
    df = clicks(spark, [(0, "a", 0, 1.0), (0, "a", 5, -1.0), (0, "b", 10, 1.0), (1, "c", 100, -1.0), (1, None, 100, 1.0), (2, "d", 300, 1.0), (2, "d", 300, -1.0)])

    def plan(s):
        own = state.with_time(s, "ts", "10 minutes")
        left = own.filter("value > 0").select(F.col("k").alias("x"), F.col("ts").alias("left_ts"))
        right = own.filter("value < 0").select(F.col("k").alias("y"), F.col("ts").alias("right_ts"))
        return left.join(right, F.expr("x = y and right_ts >= left_ts and right_ts <= left_ts + interval 10 minutes"), "full").select("x", "y", F.minute("left_ts").alias("at"))

    sent = replay.replayed(df, F.col("portion"), plan, "append").drop("batch")
    assert rows(sent) == sorted([("a", "a", 0), ("b", None, 10), (None, "c", None), (None, None, 40), ("d", "d", 0)], key=repr)


def test_streams_leave_the_session_alone(spark):
    own = replay.own_session(spark, rocks=True)
    assert "RocksDB" in own.conf.get(replay._PROVIDER) and "RocksDB" not in str(spark.conf.get(replay._PROVIDER, ""))
