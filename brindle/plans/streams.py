"""Event-time plans: run as streams over the events table, stated as batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.catalog import plan
from brindle.session import table
from brindle.streaming import replay, state
from brindle.streaming.events import deduplicated, drained, event_stream, in_memory, interval_join, running_totals, sessions, sliding, tumbling


@plan("""
SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(tumbling(event_stream(spark, sf_dir)), "complete")


@plan("""
SELECT start, start + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start, event_type
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sliding(event_stream(spark, sf_dir)), "complete")


@plan("""
WITH m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
""")
def batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


@plan("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = drained(running_totals(event_stream(spark, sf_dir)), "update", by=["user_id"])
    return last.select("user_id", "n", F.round("total", 4).alias("total"))


@plan("""
SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM (SELECT * FROM events WHERE event_type = 'view') AS a
JOIN (SELECT * FROM events WHERE event_type = 'click') AS b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE
""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = event_stream(spark, sf_dir).filter("event_type = 'view'")
    clicks = event_stream(spark, sf_dir).filter("event_type = 'click'")
    return drained(interval_join(views, clicks), "append")


@plan("""
SELECT * FROM (SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
WHERE stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are sent once the watermark has passed them; the last ones are held back."""
    return drained(tumbling(event_stream(spark, sf_dir)), "append")


@plan("""
WITH m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sessions(event_stream(spark, sf_dir)), "append")


@plan("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events come in one micro-batch, within which no watermark moves: one row of each key stays."""
    return drained(deduplicated(event_stream(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@plan("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return in_memory(totals, "complete", "brindle_stream_memory")


@plan("""
SELECT user_id, count(*) AS n, round(coalesce(max(gap), 0.0), 6) AS gap FROM
(SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS gap FROM events) GROUP BY user_id
""")
def stream_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transformWithState, which needs the RocksDB store: in a session of its own."""
    last = drained(state.longest_gaps(event_stream(replay.own_session(spark, rocks=True), sf_dir)), "update", by=["user_id"])
    return last.select("user_id", "n", F.round("gap", 6).alias("gap"))


#: Days of arrivals in a portion.
_DAYS = 15
_ARRIVED = f"date_diff('day', DATE '2024-01-01', CAST(arrived_at AS DATE)) // {_DAYS}"
_CLICKS = f"SELECT *, {_ARRIVED} AS b FROM clicks WHERE ts IS NOT NULL"


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clicks").filter("ts is not null")


def _portion(column: str, days: int = _DAYS):
    return F.floor(F.datediff(F.to_date(column), F.lit("2024-01-01")) / days)


@plan(f"""
WITH a AS ({_CLICKS}), mark AS (SELECT b, max(ts) AS top FROM a GROUP BY b),
w AS (SELECT m.b, (SELECT max(top) FROM mark AS p WHERE p.b < m.b) - INTERVAL 10 MINUTE AS wm FROM mark AS m),
k AS (SELECT date_trunc('hour', ts) AS start, wm IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > wm AS kept FROM a JOIN w USING (b))
SELECT start, count(*) FILTER (WHERE kept) AS n, count(*) FILTER (WHERE NOT kept) AS dropped FROM k GROUP BY start
""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as they arrive: windows count what comes before the watermark has passed them; what comes later is dropped, and counted beside."""
    clicks = _clicks(spark, sf_dir)
    hour = F.window("ts", "1 hour").alias("w")
    sent = replay.replayed(clicks, _portion("arrived_at"), lambda s: state.with_time(s, "ts", "10 minutes").groupBy(hour).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "update")
    every = clicks.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("came")).select("w.start", "came")
    both = every.join(replay.latest(sent, ["start"]), "start", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("start", "n", (F.col("came") - F.col("n")).alias("dropped"))


@plan(f"""
WITH RECURSIVE a AS (SELECT DISTINCT client_id, kind, b FROM ({_CLICKS}) WHERE client_id IS NOT NULL AND kind IS NOT NULL),
sent AS (SELECT client_id, kind, min(b) AS b FROM a GROUP BY client_id, kind
  UNION ALL SELECT s.client_id, s.kind, (SELECT min(x.b) FROM a AS x WHERE x.client_id = s.client_id AND x.kind = s.kind AND {_DAYS} * (x.b - 1) - 20 >= {_DAYS} * s.b + 20) AS b
  FROM sent AS s WHERE s.b IS NOT NULL)
SELECT client_id, kind, b AS portion FROM sent WHERE b IS NOT NULL
""")
def stream_dedup_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first click of a kind in a portion, per client; once the watermark has passed its 20 days, the kind comes out again."""
    clicks = _clicks(spark, sf_dir).filter("client_id is not null and kind is not null").select("client_id", "kind", _portion("arrived_at").cast("int").alias("portion"))
    clicks = clicks.withColumn("ts", F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval({_DAYS} * portion)"))
    sent = replay.replayed(clicks, F.col("portion"), lambda s: deduplicated(state.with_time(s, "ts", "20 days"), ["client_id", "kind"]).select("client_id", "kind", "portion"), "append")
    return sent.select("client_id", "kind", F.col("portion").cast("bigint").alias("portion"))


def _outer(how: str):
    def plan_of(s: DataFrame) -> DataFrame:
        own = state.with_time(s, "ts", "1 hour")
        views = own.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
        buys = own.filter("event_type = 'purchase'").select(F.col("user_id").alias("other_id"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
        near = F.expr("user_id = other_id and second_ts >= first_ts and second_ts <= first_ts + interval 10 minutes")
        return views.join(buys, near, how).select("first_id", "second_id")

    return plan_of


_OUTER = """
WITH v AS (SELECT user_id, event_id AS first_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id AS second_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events WHERE event_type IN ('view', 'purchase')),
j AS (SELECT first_id, second_id, v.ts AS vt, p.ts AS pt FROM v {how} JOIN p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 10 MINUTE)
SELECT first_id, second_id FROM j, w WHERE first_id IS NOT NULL AND second_id IS NOT NULL OR first_id IS NOT NULL AND vt + INTERVAL 10 MINUTE < wm OR second_id IS NOT NULL AND pt < wm
"""


@plan(_OUTER.format(how="LEFT"))
def stream_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the next ten minutes; a view without one comes out when the watermark has passed them."""
    return replay.replayed(table(spark, sf_dir, "events"), F.floor(F.dayofmonth("ts") / 8), _outer("left"), "append").drop("batch")


@plan(_OUTER.format(how="FULL"))
def stream_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(table(spark, sf_dir, "events"), F.floor(F.dayofmonth("ts") / 8), _outer("full"), "append").drop("batch")


@plan(f"""
WITH a AS (SELECT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY client_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM a),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT client_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total FROM s GROUP BY client_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 20 DAY FROM a)
""")
def stream_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as they arrive, out of order, and their sessions as timers close them."""
    clicks = _clicks(spark, sf_dir).filter("client_id is not null").select("client_id", "ts", "value", "arrived_at")
    clients = clicks.agg(F.approx_count_distinct("client_id")).first()[0]

    def plan_of(s: DataFrame) -> DataFrame:
        marked = s.withColumn("at", F.col("ts").cast("timestamp")).withColumn("ts", state.whole_millis("ts"))
        return state.timed_sessions(state.with_time(marked, "ts", "20 days"), "client_id", 1800, "at", clients)

    sent = replay.replayed(clicks, _portion("arrived_at", 40), plan_of, "append", rocks=True)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    closed = sent.select("client_id", ntz("start"), ntz("stop"), "n", F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))
    # the watermark's last millisecond may be past the time of the last click
    last = clicks.agg(F.max("ts").cast("timestamp_ntz").alias("last"))
    return closed.crossJoin(F.broadcast(last)).filter("stop <= last - interval 20 days").drop("last")


@plan("""
WITH c AS (SELECT client_id, kind, count(*) AS n FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
SELECT client_id, count(*) AS kinds, arg_min(kind, (-n, kind)) AS usual, max(n) AS n FROM c GROUP BY client_id
""")
def stream_map_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _clicks(spark, sf_dir).filter("client_id is not null and kind is not null").select("client_id", "kind", "arrived_at")
    clients = clicks.agg(F.approx_count_distinct("client_id")).first()[0]
    return replay.latest(replay.replayed(clicks, _portion("arrived_at", 40), lambda s: state.kinds_of_parts(s, clients), "update", rocks=True), ["client_id"])
