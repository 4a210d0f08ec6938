"""State of one's own: sessions closed by timers, pauses between rows out of order, kinds in a map that forgets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def _millis(us: int) -> int:
    """Up, so that a timer is never before its time."""
    return -(-int(us) // 1000)


def _joined(key: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, total: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Stretches of time (key, first, last, n, total), those of a key that are up to a gap apart made one; sorted. NaN is no total."""
    if not len(key):
        return key, first, last, n, total
    code = pd.factorize(key)[0]
    order = np.lexsort((first, code))
    key, code, first, last, n, total = (x[order] for x in (key, code, first, last, n, total))
    # the latest end so far of each key, by ranks, which can be set apart by key
    ends, rank = np.unique(last, return_inverse=True)
    latest = ends[np.maximum.accumulate(rank + code * len(ends)) - code * len(ends)]
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (first[1:] > latest[:-1] + gap)])
    some = np.logical_or.reduceat(~np.isnan(total), starts)
    total = np.where(some, np.add.reduceat(np.nan_to_num(total), starts), np.nan)
    return key[starts], first[starts], latest[np.r_[starts[1:], len(key)] - 1], np.add.reduceat(n, starts), total


class TimedSessions(StatefulProcessor):
    """Sessions of all keys of a part, sent when the watermark has passed their end.

    The part's open sessions are one value, as calls and trips to the store are what state costs; rows join them in any order. There is a timer at the first end, which moves as rows move that end.
    The value holds what the watermark has not passed, and the gap before.
    """

    def __init__(self, gap_seconds: int, at: str = "ts"):
        self.gap, self.at = gap_seconds * 1_000_000, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _held(self) -> tuple[np.ndarray, ...]:
        if not self.open.exists():
            return np.empty(0, object), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0)
        with pa.ipc.open_stream(pa.py_buffer(bytes(self.open.get()[0]))) as stream:
            return tuple(c.to_numpy() for c in stream.read_all().columns)

    def _hold(self, sessions: tuple[np.ndarray, ...]) -> None:
        """One timer, at the end that comes first."""
        table = pa.table([pa.array(x) for x in sessions], ["key", "first", "last", "n", "total"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.open.update((sink.getvalue().to_pybytes(),))
        want, have = _millis(sessions[2].min() + self.gap), list(self.handle.listTimers())
        for t in have:
            if t != want:
                self.handle.deleteTimer(t)
        if want not in have:
            self.handle.registerTimer(want)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            at = part[self.at].to_numpy("datetime64[us]").astype(np.int64)
            fresh = part["key"].to_numpy(object), at, at, np.ones(len(at), np.int64), part["value"].to_numpy(float, na_value=np.nan)
            held = _joined(*(np.concatenate(x) for x in zip(held, fresh)), self.gap)
        self._hold(held)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = -(-(held[2] + self.gap) // 1000) <= timerValues.getCurrentWatermarkInMs()
        if not over.all():
            self._hold(tuple(x[~over] for x in held))
        else:
            self.open.clear()
        if over.any():
            name, first, last, n, total = (x[over] for x in held)
            yield pd.DataFrame({"key": name, "start": first.view("datetime64[us]"), "stop": (last + self.gap).view("datetime64[us]"), "n": n, "total": total})

    def close(self) -> None:
        pass


#: Keys of a part that timed_sessions() and kinds_of_parts() deal, about.
_KEYS = 200


def timed_sessions(rows: DataFrame, key: str, gap_seconds: int, at: str = "ts", keys: int = 1) -> DataFrame:
    """(key, start, stop, n, total) of each session once the watermark has passed its end; rows a gap apart are one session.

    rows: the key, ts with a watermark, value; at: the times of the sessions, where ts is rounded for the watermark. A null key is a key, null values add nothing; rows without a time and rows behind the
    watermark are dropped. For about so many keys, which are dealt to parts by their hash; a part is a key of the state, and meets in one worker. A query must go on with the number that it began with.
    Keys need a text that stands for them. Needs the RocksDB store.
    """
    kind = dict(rows.dtypes)[key]
    part = F.pmod(F.xxhash64(key), F.lit(1 + keys // _KEYS)).alias("part")
    # a null key has the empty text
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key")
    grouped = rows.filter("ts is not null").select(part, text, *dict.fromkeys(("ts", at)), F.col("value").cast("double").alias("value")).groupBy("part")
    out = grouped.transformWithStateInPandas(TimedSessions(gap_seconds, at), "key string, start timestamp, stop timestamp, n long, total double", "Append", "EventTime")
    return out.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(key), "start", "stop", "n", "total")


class LongestGap(StatefulProcessor):
    """Each key's rows and longest pause so far, rows out of order included: what the watermark has not passed waits, and is put in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint, last timestamp, gap double")
        self.waiting = handle.getListState("waiting", "ts timestamp")

    @staticmethod
    def _after(last, gap: float, times: pd.Series) -> float:
        stops = times if last is None else pd.concat([pd.Series([pd.Timestamp(last)]), times])
        return max(gap, float(stops.diff().dt.total_seconds().max()) if len(stops) > 1 else 0.0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, last, gap = self.seen.get() if self.seen.exists() else (0, None, 0.0)
        fresh = pd.concat([r["ts"] for r in rows])
        old = [pd.Timestamp(t) for (t,) in self.waiting.get()] if self.waiting.exists() else []
        times = pd.concat([pd.Series(old, dtype="datetime64[ns]"), fresh.astype("datetime64[ns]")]).sort_values()
        passed = times <= pd.Timestamp(max(0, timerValues.getCurrentWatermarkInMs()), unit="ms")
        done, waiting = times[passed], times[~passed]
        if len(done):
            gap = self._after(last, gap, done)
            last = done.iloc[-1].to_pydatetime()
        n += len(fresh)
        self.seen.update((n, last, gap))
        if len(waiting):
            self.waiting.put([(t.to_pydatetime(),) for t in waiting])
        else:
            self.waiting.clear()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "gap": [self._after(last, gap, waiting) if len(waiting) else gap]})

    def close(self) -> None:
        pass


def longest_gaps(events: DataFrame) -> DataFrame:
    """Each user's rows and longest pause in seconds, after every micro-batch that has rows of the user (update mode).

    Rows may come out of order within the watermark; those behind it, and those without a time, are dropped. Needs the RocksDB state store, and the protobuf
    package on the workers.
    """
    return events.filter("ts is not null").groupBy("user_id").transformWithStateInPandas(LongestGap(), "user_id bigint, n bigint, gap double", "Update", "EventTime")


class Kinds(StatefulProcessor):
    """How many kinds a key has had, in a map that forgets a kind some time after its last row."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "kind string", "n bigint", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = {k: n for (k,), (n,) in self.counts.iterator()} if self.counts.exists() else {}
        for kind, n in pd.concat([part["kind"] for part in rows]).dropna().value_counts().items():
            held[kind] = held.get(kind, 0) + int(n)
            self.counts.updateValue((kind,), (held[kind],))
        top = min(held, key=lambda k: (-held[k], k), default=None)
        yield pd.DataFrame({"client_id": pd.array([key[0]], "Int64"), "kinds": [len(held)], "usual": [top], "n": [held.get(top, 0)]})

    def close(self) -> None:
        pass


class KindsOfPart(StatefulProcessor):
    """Kinds of all clients of a part: a map from the client to its counts, which is read in one go and written once a client with rows.

    Calls and trips to the store are what state costs: a client of its own takes some ten of them a micro-batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "client string", "counts map<string,bigint>", None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, Counter] = {}
        for part in rows:
            for (client, kind), n in Counter(zip(part["client"], part["kind"])).items():
                fresh.setdefault(client, Counter())[kind] += n
        out = []
        held = {client: counts for (client,), (counts,) in self.counts.iterator()}
        for client, counts in fresh.items():
            now = Counter(held.get(client)) + Counter({k: n for k, n in counts.items() if isinstance(k, str)})
            self.counts.updateValue((client,), (dict(now),))
            top = min(now, key=lambda k: (-now[k], k), default=None)
            out.append((int(client) if client else None, len(now), top, now.get(top, 0)))
        made = pd.DataFrame(out, columns=["client_id", "kinds", "usual", "n"], dtype=object)
        yield made.astype({"client_id": "Int64", "kinds": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def kinds_of_parts(rows: DataFrame, clients: int) -> DataFrame:
    """kinds_so_far() without a time to forget, for about so many clients: they are dealt to parts by their hash, and a part is a key of the state.

    A query must go on with the number that it began with.
    """
    part = F.pmod(F.xxhash64("client_id"), F.lit(1 + clients // _KEYS)).alias("part")
    dealt = rows.select(part, F.coalesce(F.col("client_id").cast("string"), F.lit("")).alias("client"), "kind").groupBy("part")
    return dealt.transformWithStateInPandas(KindsOfPart(), "client_id bigint, kinds long, usual string, n long", "Update", "None")


def kinds_so_far(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(client_id, kinds, usual, n) after every micro-batch with rows of the client (update mode): its kinds, the most frequent and its count.

    Null kinds are left out, ties go to the first by name, a null client is a client. ttl_ms: processing time after which a kind without rows is
    forgotten; None keeps all. With it a query that runs over what is available never ends: it is for continuous queries and single micro-batches.
    Needs the RocksDB store.
    """
    time_mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("client_id").transformWithStateInPandas(Kinds(ttl_ms), "client_id bigint, kinds long, usual string, n long", "Update", time_mode)


def whole_millis(ts: str) -> Column:
    """The time rounded up to a millisecond: watermarks count in these, rounded down, and would stand before the last row."""
    return F.date_trunc("millisecond", F.col(ts).cast("timestamp") + F.expr("interval 999 microseconds"))


def with_time(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Rows with a watermark on ts, as an instant, which watermarks ask for."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
