"""A source and sink of one's own through the Python data source API: a log of Arrow segments with commits.

A task writes a segment; the driver's commit names the segments that count, with their rows and the least and greatest value of each column. What a
killed or repeated task leaves behind is in no commit, so that no row is read twice or half. Readers take commits as their offsets and
plan partitions of whole record batches; filters leave segments out by their bounds and rows by their values.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Partitions that a read plans, about: with more rows than make so many steps, partitions are larger. Each costs a task, and a file of whatever the rows go to.
_MOST = 1000

_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _bound(x):
    """What a commit keeps of a least or greatest value; None where it has no order that JSON keeps."""
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return x if isinstance(x, (int, float, str)) and not (isinstance(x, float) and x != x) else None


@dataclass
class Segment(WriterCommitMessage):
    name: str
    batches: list[int]  # rows of each
    bounds: dict[str, list] = field(default_factory=dict)


class _Log:
    """The commits of a folder."""

    def __init__(self, path: str):
        self.path = path

    def commits(self) -> list[dict]:
        store, top = _at(self.path)
        found = store.get_file_info(fs.FileSelector(f"{top}/commits", allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda i: i.path):
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    out.append(json.loads(f.read()))
        return out

    def commit(self, segments: list[Segment], schema: StructType, replace: bool = False, stream: str | None = None, batch: int | None = None) -> None:
        """Adds a commit; one of a stream's batch counts once, however often it comes."""
        store, top = _at(self.path)
        held = self.commits()
        if stream is not None and any(c.get("stream") == stream and c.get("batch") == batch for c in held):
            self.remove(segments)
            return
        made = {"schema": schema.jsonValue(), "stream": stream, "batch": batch, "replace": replace, "segments": [{"name": s.name, "batches": s.batches, "bounds": s.bounds} for s in segments if s.batches]}
        store.create_dir(f"{top}/commits")
        draft, name = f"{top}/commits/{uuid.uuid4().hex}.draft", f"{top}/commits/{len(held):010d}.json"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps(made).encode())
        store.move(draft, name)

    def remove(self, segments: list[Segment]) -> None:
        store, top = _at(self.path)
        for s in segments:
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(f"{top}/segments/{s.name}")


class _Writing:
    """What both writers share: a task's segment, the driver's commit or abort."""

    def __init__(self, options: dict, schema: StructType, replace: bool):
        self.log, self.schema, self.replace = _Log(options["path"]), schema, replace
        self.rows, self.stream = int(options.get("batch", 10_000)), options.get("stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        store, top = _at(self.log.path)
        store.create_dir(f"{top}/segments")
        segment, schema, bounds = Segment(f"{uuid.uuid4().hex}.arrow", []), to_arrow_schema(self.schema), {}
        with store.open_output_stream(f"{top}/segments/{segment.name}") as f, pa.ipc.new_file(f, schema) as out:
            for batch in iterator:
                for a in range(0, batch.num_rows, self.rows):
                    part = pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.slice(a, self.rows).columns, schema)], schema=schema)
                    out.write_batch(part)
                    segment.batches.append(part.num_rows)
                    for name, column in zip(schema.names, part.columns):
                        with contextlib.suppress(pa.ArrowNotImplementedError):
                            both = pc.min_max(column)
                            bounds.setdefault(name, []).append((both["min"].as_py(), both["max"].as_py(), column.null_count < len(column)))
        for name, seen in bounds.items():
            low, high = [x[0] for x in seen if x[0] is not None], [x[1] for x in seen if x[1] is not None]
            segment.bounds[name] = [_bound(min(low)) if low else None, _bound(max(high)) if high else None, any(x[2] for x in seen)]
        return segment

    def _abort(self, messages: list[Segment | None]) -> None:
        self.log.remove([m for m in messages if m is not None])


class _Writer(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Segment | None]) -> None:
        self.log.commit([m for m in messages if m is not None], self.schema, self.replace)

    def abort(self, messages: list[Segment | None]) -> None:
        self._abort(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Segment | None], batchId: int) -> None:
        self.log.commit([m for m in messages if m is not None], self.schema, stream=self.stream or "stream", batch=batchId)

    def abort(self, messages: list[Segment | None], batchId: int) -> None:
        self._abort(messages)


class _Span(InputPartition):
    """Record batches of a segment."""

    def __init__(self, name: str, first: int, stop: int):
        self.name, self.first, self.stop = name, first, stop


class _Reading:
    def __init__(self, options: dict, schema: StructType):
        self.log, self.schema = _Log(options["path"]), schema
        self.step = int(options.get("step", 100_000))
        self.filters: list[Filter] = []

    def _spans(self, commits: list[dict]) -> list[_Span]:
        """Partitions of about `step` rows, or more where there would be more than _MOST of them, of the segments that the filters do not leave out."""
        segments = [s for c in commits for s in c["segments"] if all(self._may(f, s["bounds"]) for f in self.filters)]
        step = max(self.step, -(-sum(sum(s["batches"]) for s in segments) // _MOST))
        out = []
        for s in segments:
            first, rows = 0, 0
            for i, n in enumerate(s["batches"]):
                rows += n
                if rows >= step or i == len(s["batches"]) - 1:
                    out.append(_Span(s["name"], first, i + 1))
                    first, rows = i + 1, 0
        return out

    @staticmethod
    def _may(f: Filter, bounds: dict) -> bool:
        low, high, some = bounds.get(f.attribute[0], [None, None, True])
        if not some:
            return False  # nulls alone
        if isinstance(f, IsNotNull) or low is None or high is None:
            return True
        value = _bound(f.value)
        if value is None or isinstance(value, str) != isinstance(low, str):
            return True
        return {EqualTo: low <= value <= high, GreaterThan: high > value, GreaterThanOrEqual: high >= value, LessThan: low < value, LessThanOrEqual: low <= value}[type(f)]

    def read(self, partition: _Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # all segments were left out
            return
        store, top = _at(self.log.path)
        with store.open_input_file(f"{top}/segments/{partition.name}") as f:
            held = pa.ipc.open_file(f)
            for i in range(partition.first, partition.stop):
                batch = held.get_batch(i)
                for own in self.filters:
                    column = batch.column(batch.schema.get_field_index(own.attribute[0]))
                    keep = pc.is_valid(column) if isinstance(own, IsNotNull) else _COMPARE[type(own)](column, pa.scalar(own.value, column.type))
                    batch = batch.filter(keep)
                yield batch


class _Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[_Span]:
        commits = self.log.commits()
        start = max((i for i, c in enumerate(commits) if c["replace"]), default=0)
        return self._spans(commits[start:])


class _FilteringReader(_Reader):
    """A reader apart, as Spark refuses one that takes filters where spark.sql.python.filterPushdown.enabled is not set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {f.name: f.dataType.typeName() for f in self.schema.fields}
        for f in filters:
            # floats have NaN, which compares otherwise here than in Spark
            if isinstance(f, (IsNotNull, *_COMPARE)) and len(f.attribute) == 1 and kinds.get(f.attribute[0]) in ("byte", "short", "integer", "long", "string", "date"):
                self.filters.append(f)
            else:
                yield f


class _StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are numbers of commits. All that is committed is the latest offset, whatever the step: a run over what is available takes it all."""

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": len(self.log.commits())}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return self._spans(self.log.commits()[start["commit"] : end["commit"]])

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Options: path; step (rows of a read partition, about; more where a read would have over 1000 partitions); batch (rows of a record batch, when written); stream (a name for the writing query);
    filters (true: takes filters, as read_log() sets it; a frame loaded so is for one filtered query, as Spark keeps the filters of the
    first plan for a later one without any).

    mode append adds a commit, overwrite one that hides those before it from batch readers. A single query writes a log at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "brindle_log"

    def schema(self) -> StructType:
        commits = _Log(self.options["path"]).commits()
        if not commits:
            raise ValueError(f"no log at {self.options['path']}")
        return StructType.fromJson(commits[-1]["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteringReader if self.options.get("filters") == "true" else _Reader)(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options, schema, overwrite)


def read_log(spark: SparkSession, path: str, condition: str | None = None, **options) -> DataFrame:
    """The rows of a log that meet a condition (SQL), which reaches the segments' bounds and rows; each call loads a frame of its own.

    Sets spark.sql.python.filterPushdown.enabled, which matters to Python sources that take filters alone.
    """
    spark.dataSource.register(LogSource)
    if condition is None:
        return spark.read.format("brindle_log").options(path=path, **options).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("brindle_log").options(path=path, filters="true", **options).load().filter(condition)
