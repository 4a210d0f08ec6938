"""The user-function surface: what to use where built-in expressions cannot say it. All move Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def scaled(values: pd.Series, factor: pd.Series) -> pd.Series:
    """Scalar: a series in, a series out."""
    return values * factor


@F.pandas_udf(T.DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """Grouped aggregate: the mean of the middle eight tenths, by rank. A group must fit a worker, and costs a call: for few groups."""
    ordered = values.dropna().sort_values()
    cut = len(ordered) // 10
    kept = ordered.iloc[cut : len(ordered) - cut]
    return float(kept.mean()) if len(kept) else None


def trimmed_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(keys, mean): trimmed_mean() of each group, for many groups: rows come sorted, and a call takes all groups of a batch.

    A null key is a key, nulls and NaN are no values, a group without values has a null mean. Keys are of types with an order and no columns within. A worker holds
    a batch and the values of the group that goes on into the next one.
    """
    schema = T.StructType([*(T.StructField(df.schema[k].name, df.schema[k].dataType) for k in by), T.StructField("mean", T.DoubleType())])
    names = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(by, names)), F.col(value).cast("double").alias("v"))
    inner = T.StructType([T.StructField(n, f.dataType) for n, f in zip([*names, "mean"], schema.fields)])
    return rows.repartition(*names).sortWithinPartitions(*names, "v").mapInArrow(_means_of_sorted, inner).toDF(*schema.names)


def _starts(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where a group of sorted rows begins: keys are all columns but the last."""
    fresh = np.zeros(rows.num_rows, bool)
    fresh[0] = True
    for column in rows.columns[:-1]:
        coded = column.dictionary_encode(null_encoding="encode")
        codes = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def _means(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    starts, values = _starts(rows), rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    some = ~np.isnan(values)  # nulls have become NaN
    group, values = group[some], values[some]
    n = np.bincount(group, minlength=len(starts))
    rank, cut = np.arange(len(values)) - (np.cumsum(n) - n)[group], n // 10
    kept = (rank >= cut[group]) & (rank < (n - cut)[group])
    sums = np.bincount(group[kept], weights=values[kept], minlength=len(starts))
    means = pa.array(sums / np.maximum(n - 2 * cut, 1), mask=n == 0)
    keys = rows.drop_columns([rows.column_names[-1]]).take(pa.array(starts))
    return keys.append_column("mean", means).combine_chunks().to_batches()[0]


def _means_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # of the last group, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            ends = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(_starts(ends)) > 1:
                yield _means(held)
                held = []
        last = int(_starts(batch)[-1])
        if last:
            yield _means([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _means(held)


@F.udf(T.StringType(), useArrow=True)
def initials(text: str | None) -> str | None:
    """Row by row, over Arrow."""
    return None if text is None else "".join(w[0] for w in text.split())


@F.udf(T.LongType(), useArrow=False)
def vowels(text: str | None) -> int | None:
    """Row by row, pickled: the slowest kind, for functions over types that Arrow lacks."""
    return None if text is None else sum(c in "aeiou" for c in text.lower())


@F.udtf(returnType=T.StructType([T.StructField("step", T.LongType()), T.StructField("value", T.LongType())]))
class Countdown:
    """A table function: from n down to 1."""

    def eval(self, n: int):
        for i in range(n):
            yield i, n - i


def demeaned(group: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: values less their group's mean. A group must fit a worker."""
    return group.assign(value=group["value"] - group["value"].mean())


def positive_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: keeps rows with a value above zero."""
    import pyarrow.compute as pc

    for batch in batches:
        yield batch.filter(pc.greater(batch.column("value"), 0))
