"""Aggregates of one's own whose states merge: no worker ever holds a group.

Each task adds its rows to a state for each key as they come, in Arrow batches. States are rows of a schema that the aggregate
names. They are dealt by (key, salt), sorted, and merged one into the next; what is left of a key, `salts` states at most, is merged
again by key alone and finished.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys that a task holds states of before it sends them on.
HELD = 1 << 16


class Aggregate:
    """State: a tuple as `state` (DDL) says, never null; result: as `result` (DDL) says. add() gets a key's rows of a batch, with the columns asked for."""

    state: str
    result: str

    def add(self, state: tuple | None, rows: pa.RecordBatch) -> tuple:
        raise NotImplementedError

    def merge(self, a: tuple, b: tuple) -> tuple:
        raise NotImplementedError

    def finish(self, state: tuple) -> tuple:
        raise NotImplementedError


class Moments(Aggregate):
    """n, mean and the sample's standard deviation of the values that are not null, by their pairwise update."""

    state = "n long, mean double, m2 double"
    result = "n long, mean double, sd double"

    def add(self, state, rows):
        x = rows.column(0).drop_null().to_numpy(zero_copy_only=False).astype(float)
        own = (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())) if len(x) else (0, 0.0, 0.0)
        return own if state is None else self.merge(state, own)

    def merge(self, a, b):
        n = a[0] + b[0]
        if not a[0] or not b[0]:
            return a if a[0] else b
        apart = b[1] - a[1]
        return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n

    def finish(self, state):
        n, mean, m2 = state
        return n, mean if n else None, float(np.sqrt(m2 / (n - 1))) if n > 1 else None


class Largest(Aggregate):
    """The k largest values, descending; nulls are left out."""

    state = "top array<double>"
    result = "top array<double>"

    def __init__(self, k: int):
        self.k = k

    def add(self, state, rows):
        x = rows.column(0).drop_null().to_numpy(zero_copy_only=False).astype(float)
        if len(x) > self.k:
            x = np.partition(x, -self.k)[-self.k :]
        return self.merge(state or ([],), (x.tolist(),))

    def merge(self, a, b):
        return (heapq.nlargest(self.k, [*a[0], *b[0]]),)

    def finish(self, state):
        return state


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """A batch's rows by key; nulls are a key."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        found = batch.column(i).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(found.dictionary) + 1) + found.indices.to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1)) if len(order) else []
    rows = batch.take(pa.array(order))
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(rows.column(i)[a].as_py() for i in range(keys)), rows.slice(a, b - a).select(range(keys, batch.num_columns))


def _rows(schema: pa.Schema, items: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in items], f.type) for i, f in enumerate(schema)], schema=schema)


def user_aggregate(df: DataFrame, by: list[str], columns: list[str], aggregate: Aggregate, salts: int = 16) -> DataFrame:
    """A row for each key: keys and the result's columns.

    A null key is a key; a key's rows may all be null, which is the aggregate's to say. Repeated rows count each. An empty table gives no rows,
    without keys as well. The state's and the result's columns may be named as keys are.
    """
    names = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, names)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))
    state, result = (T.StructType([T.StructField(f"s{i}", f.dataType) for i, f in enumerate(T._parse_datatype_string(x).fields)]) for x in (aggregate.state, aggregate.result))
    key_fields = T.StructType(rows.schema.fields[: len(names)])
    partial, final = T.StructType(key_fields.fields + state.fields), T.StructType(key_fields.fields + result.fields)
    partial_arrow, final_arrow, n = to_arrow_schema(partial), to_arrow_schema(final), len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for key, own in _groups(batch, n):
                held[key] = aggregate.add(held.get(key), own)
            if len(held) > HELD:
                yield _rows(partial_arrow, [(*k, *s) for k, s in held.items()])
                held.clear()
        yield _rows(partial_arrow, [(*k, *s) for k, s in held.items()])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """States of sorted keys, each key's merged."""
        at, state = None, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(partial.fields)))):
                key, own = row[:n], row[n:]
                if state is not None and key == at:
                    state = aggregate.merge(state, own)
                    continue
                if state is not None:
                    yield (*at, *state)
                at, state = key, own
        if state is not None:
            yield (*at, *state)

    def in_batches(items: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held = []
        for item in items:
            held.append(item)
            if len(held) == 4096:
                yield _rows(schema, held)
                held = []
        yield _rows(schema, held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(merged(batches), partial_arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(((*row[:n], *aggregate.finish(row[n:])) for row in merged(batches)), final_arrow)

    states = rows.mapInArrow(add, partial)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    once = states.withColumn("salt", salt).repartition(*names, "salt").sortWithinPartitions(*names, "salt").drop("salt").mapInArrow(merge, partial)
    dealt = once.repartition(*names) if names else once.coalesce(1)
    ends = dealt.sortWithinPartitions(*names) if names else dealt
    return ends.mapInArrow(finish, final).toDF(*by, *(f.name for f in T._parse_datatype_string(aggregate.result).fields))
