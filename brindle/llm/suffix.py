"""Passages that repeat across documents, or within one too, by sparse suffix arrays.

Only suffixes at minimisers are retained: among the k-word grams of every stretch of `size` words, the one of the
least hash. A stretch that repeats selects the same minimiser wherever it is, so that its copies retain suffixes
that begin with the same gram; what occurs once goes, behind a sketch of fixed size. Each task sorts its retained suffixes by their
words and compares neighbours: words in common to the right are the least of the common prefixes between two suffixes. Then matches are
extended to the left, a word at a time, and a stretch repeats if the words to the left and those to the right that complete
it are both in common. Stretches that a task's array does not show to be repeats are sorted by hash of their content and compared,
by minimiser, over all tasks. Matches that touch are joined: the passage then reaches as far left and right as the copies agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import substring
from brindle.llm.common import by_bytes, partitions, spool
from brindle.llm.substring import Places, flagged_cells, rolling, sketched, window_keys, word_hashes

GRAM = 16
#: Suffixes whose words a task holds at once.
SUFFIXES = 1 << 16
_SENT = "kind int, key int, data binary"
_RUN = np.dtype([("null", "u1"), ("id", "<i8"), ("text", "<i8"), ("start", "<u4"), ("stop", "<u4"), ("from_null", "u1"), ("from_id", "<i8"), ("from_text", "<i8"), ("from_start", "<u4")])


def _runs(docs: np.ndarray, index: np.ndarray, start: np.ndarray, source: np.ndarray, source_start: np.ndarray, size: int) -> np.ndarray:
    """Repeated stretches as runs: consecutive starts that are consecutive in one source are one."""
    order = np.lexsort((start, index))
    index, start, source, source_start = index[order], start[order].astype(np.int64), source[order], source_start[order].astype(np.int64)
    if not len(index):
        return np.empty(0, _RUN)
    new = np.r_[True, (index[1:] != index[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (source_start[1:] != source_start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(index)] - 1
    out = np.empty(len(first), _RUN)
    for name in ("null", "id", "text"):
        out[name] = docs[name][index[first]]
    out["start"], out["stop"] = start[first], start[last] + size
    for name in ("null", "id", "text"):
        out[f"from_{name}"] = docs[name][source[first]]
    out["from_start"] = source_start[first]
    return out


def _order_of(docs: np.ndarray, within: bool) -> np.ndarray:
    """Rank of each document by id, and with within by text hash too, so that rows that share an id only have an order."""
    return np.unique(docs, return_inverse=True)[1].reshape(-1) if within and len(docs) else substring.order_of(docs)


def _compare(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order; in it, whether an equal stretch is earlier (in an earlier document, or within one too), and where the first one is."""
    order = np.lexsort((start, rank, h2, h1))
    a, b, r = h1[order], h2[order], rank[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = r != r[first]
    if within:
        p = start[order]
        later |= p != p[first]
    return order, later, order[first]


class Suffixes:
    """Retained suffixes with their words: gram (the hash of the first words), right (those that follow it), left (those before, nearest first)."""

    def __init__(self, gram: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.gram, self.left, self.right = gram, left, right

    @classmethod
    def at(cls, hashes: np.ndarray, grams: np.ndarray, places: np.ndarray, gram: int, reach: int) -> Suffixes:
        """Of places in a row of words' hashes; where the row ends, words are 0."""
        padded = np.r_[np.zeros(reach, np.uint64), hashes, np.zeros(reach + gram, np.uint64)]
        step = np.arange(reach)
        return cls(grams[places], padded[places[:, None] + (reach - 1 - step)], padded[places[:, None] + (reach + gram + step)])

    @classmethod
    def joined(cls, parts: list[Suffixes]) -> Suffixes:
        return cls(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("gram", "left", "right")))

    def array(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array: each suffix's place in the order of words, and in that order how many words after the gram it has in common with
        the one before; -1 if not even that."""
        words = np.c_[self.gram, self.right]
        order = np.argsort(words.astype(">u8").view(f"S{8 * words.shape[1]}").ravel(), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ordered = words[order]
        equal = np.c_[ordered[1:] == ordered[:-1], np.zeros(max(0, len(order) - 1), bool)]
        return place, np.r_[-1, equal.argmin(1) - 1][: len(order)]

    def compare(self, suffix: np.ndarray, back: np.ndarray, rank: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of stretches that reach `back` words to the left of a suffix: whether an equal one is earlier, and which is the first of its equals."""
        place, common = self.array()
        later, first = np.zeros(len(suffix), bool), np.arange(len(suffix))
        reach = self.right.shape[1]
        left = np.zeros(len(self.gram), np.uint64)
        by_back = np.argsort(back, kind="stable")
        cuts = np.searchsorted(back[by_back], np.arange(reach + 2))
        for j in range(reach + 1):
            if j:
                left = substring._mix((left ^ self.left[:, j - 1]) * np.uint64(substring.M2) + np.uint64(j))
            rows = by_back[cuts[j] : cuts[j + 1]]
            if not len(rows):
                continue
            # neighbours with so many words in common to the right are a run of the array; in it, those with j to the left are equal
            run = np.cumsum(common < reach - j)[place[suffix[rows]]]
            own = left[suffix[rows]]
            order = np.lexsort((start[rows], rank[rows], own, run))
            run, own, rows = run[order], own[order], rows[order]
            new = np.r_[True, (run[1:] != run[:-1]) | (own[1:] != own[:-1])]
            head = rows[np.flatnonzero(new)][np.cumsum(new) - 1]
            first[rows] = head
            later[rows] = (rank[rows] != rank[head]) | (within & (start[rows] != start[head]))
        return later, first


def _stretches(texts: list[bytes | None], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """The words' hashes of all texts in a row, the hashes of their grams; and of each stretch of `size` words inside a text its place in the row, text,
    first word and the place of its minimiser: the gram of least hash, the first of equals."""
    hashes, counts = word_hashes(texts)
    fit = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), fit)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(fit) - fit, fit)
    if not len(owner):
        return hashes, hashes[:0], start, owner, start, start
    at = start + np.repeat(np.cumsum(counts) - counts, fit)
    grams = rolling(hashes, gram, substring.M1)
    index, have, width = np.arange(len(grams)), 1, size - gram + 1
    while have < width:
        step = min(have, width - have)
        a, b = index[: len(index) - step], index[step:]
        index = np.where(grams[a] <= grams[b], a, b)
        have += step
    return hashes, grams, at, owner, start, index[at]


def _batch(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["kind", "key", "data"])


def _candidates(size: int, gram: int, log2_cells: int, bits, often, shards: int, within: bool):
    """Stretches at suffixes that may repeat (kind 0); runs that a task can tell by its own suffix array (kind 1).

    Stretches are dealt by their minimiser, and by their own words where the sketch says that it is common.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        held: list[tuple[np.ndarray, ...]] = []
        suffixes: list[Suffixes] = []
        docs_held = suffixes_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs_held, suffixes_held
            docs, inverse = np.unique(np.concatenate(known), return_inverse=True)
            h1, h2, index, start, least, suffix, back = (np.concatenate(x) for x in zip(*held))
            array = Suffixes.joined(suffixes)
            for x in (known, held, suffixes):
                x.clear()
            docs_held = suffixes_held = 0
            index = inverse.reshape(-1)[index]
            later, first = array.compare(suffix, back, _order_of(docs, within)[index], start, within)
            gone, kept = np.flatnonzero(later), np.flatnonzero(~later)
            source = first[gone]
            runs = _runs(docs, index[gone], start[gone], index[source], start[source], size)
            if len(runs):
                data = runs.tobytes()
                yield _batch(1, [(zlib.crc32(data) % shards, data)])
            h1, h2, index, start, least = h1[kept], h2[kept], index[kept], start[kept], least[kept]
            shard = (np.where(flagged_cells(least, often.value, log2_cells), h1, least) >> np.uint64(24)) % np.uint64(shards)
            order = np.lexsort((start, index, shard))
            shard, h1, h2, index, start = shard[order], h1[order], h2[order], index[order], start[order]
            same = np.r_[False, (shard[1:] == shard[:-1]) & (index[1:] == index[:-1]) & (start[1:] == start[:-1])]
            shard, h1, h2, index, start = (x[~same] for x in (shard, h1, h2, index, start))
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                yield _batch(0, [(int(shard[a]), Places.pack(docs, index[a:b], start[a:b], h1[a:b], h2[a:b]))])

        for batch in batches:
            own = Places.of(batch.column("doc_id"), batch.column("hash"))
            for a, b in by_bytes(batch.column("text"), substring.SLICE):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                hashes, grams, at, index, start, places = _stretches(texts, size, gram)
                if not len(at):
                    continue
                flagged = np.flatnonzero(flagged_cells(grams[places], bits.value, log2_cells))
                if not len(flagged):
                    continue
                at, index, start, places = (x[flagged] for x in (at, index, start, places))
                h1, h2, least, back = rolling(hashes, size, substring.M1)[at], rolling(hashes, size, substring.M2)[at].astype("<u4"), grams[places], places - at
                places, suffix = np.unique(places, return_inverse=True)
                used, inverse = np.unique(index, return_inverse=True)
                # in pieces that hold so many suffixes at most
                for k in range(0, len(places), SUFFIXES):
                    part = (suffix >= k) & (suffix < k + SUFFIXES)
                    suffixes.append(Suffixes.at(hashes, grams, places[k : k + SUFFIXES], gram, size - gram))
                    known.append(own[a:b][used])
                    held.append((h1[part], h2[part], inverse.reshape(-1)[part] + docs_held, start[part], least[part], suffix[part] - k + suffixes_held, back[part]))
                    docs_held += len(used)
                    suffixes_held += len(suffixes[-1].gram)
                    if suffixes_held >= SUFFIXES or sum(len(x[0]) for x in held) >= substring.HELD:
                        yield from flush()
        if held:
            yield from flush()

    return work


def _settle(size: int, within: bool):
    """Sorts each shard's stretches and compares neighbours; gives all runs as rows: these, whose sources are the earliest of all, and those that tasks told themselves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for docs, index, start, h1, h2 in substring.sorted_parts(held):
                order, later, first = _compare(h1, h2, _order_of(docs, within)[index], start, within)
                gone, source = order[later], first[later]
                runs = _runs(docs, index[gone], start[gone], index[source], start[source], size)
                if len(runs):
                    yield _rows_of(runs, True)
            held.clear()

        for batch in batches:
            for i, (kind, key) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist())):
                data = batch.column("data")[i].as_buffer()
                if kind:
                    yield _rows_of(np.frombuffer(data, _RUN), False)
                    continue
                if key != shard:
                    if held:
                        yield from done()
                    shard = key
                held.append(data.to_pybytes())
        if held:
            yield from done()

    return work


_RUN_ROW = "doc_id long, hash long, start long, stop long, source_doc_id long, source_hash long, source_start long, settled boolean"


def _rows_of(runs: np.ndarray, settled: bool) -> pa.RecordBatch:
    names = ["doc_id", "hash", "start", "stop", "source_doc_id", "source_hash", "source_start", "settled"]
    ids = pa.array(runs["id"], mask=runs["null"].astype(bool))
    sources = pa.array(runs["from_id"], mask=runs["from_null"].astype(bool))
    starts = [pa.array(runs[c].astype(np.int64)) for c in ("start", "stop", "from_start")]
    return pa.RecordBatch.from_arrays([ids, pa.array(runs["text"]), starts[0], starts[1], sources, pa.array(runs["from_text"]), starts[2], pa.array(np.full(len(runs), settled))], names)


def repeated_passages(docs: DataFrame, size: int = 50, log2_cells: int = 26, text: str = "text", doc_id: str = "doc_id", within: bool = False) -> DataFrame:
    """A row for each passage of `size` words or more that an earlier document has too: doc_id, start, n_words, source_doc_id, source_start.

    Words are what ASCII white space parts, unchanged, and counted from 0. A passage is the longest stretch of words
    covered by stretches of `size` words each of which is also in a document of smaller id; its source is the earliest place
    of the first of them. A null doc_id comes after all ids. Rows that share
    an id are at one place: they are not each other's source, and rows that share the text too are reported once.
    With `within`, a stretch that starts earlier in the same document counts too, and the document is its own source; rows
    that share an id only are then ordered by their texts' hashes and may be each other's source.
    Null texts have no words. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    n, gram = partitions(spark), min(GRAM, size)
    bits, often = map(spark.sparkContext.broadcast, sketched(docs, partial(window_keys, size=size, gram=gram), log2_cells))
    sent = docs.mapInArrow(_candidates(size, gram, log2_cells, bits, often, n, within), _SENT)
    runs = sent.repartitionById(n, F.col("key")).sortWithinPartitions("kind", "key").mapInArrow(_settle(size, within), _RUN_ROW)
    runs = spool(runs, "runs")
    passage = Window.partitionBy("doc_id", "hash").orderBy("start", "stop")
    reach = F.max("stop").over(passage.rowsBetween(Window.unboundedPreceding, -1))
    joined = runs.withColumn("reach", reach).withColumn("new", F.when(F.col("reach") >= F.col("start"), 0).otherwise(1))
    joined = joined.withColumn("passage", F.sum("new").over(passage.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "source_doc_id", "source_hash", "source_start"))
    found = joined.groupBy("doc_id", "hash", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), first.alias("first"))
    # the source that a task knew may itself be later than one that others had: then that one's source is the earliest
    known = runs.filter("settled").select(*(F.col(c).alias(f"_{c}") for c in runs.columns))
    # a place is asked for once, however many documents have a passage from there
    at = ["source_doc_id", "source_hash", "source_start"]
    found = found.select("doc_id", "hash", "start", "stop", *(F.col(f"first.{c}").alias(c) for c in at))
    asked = found.select(*at).distinct()
    place = F.col("source_doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("source_hash") == F.col("_hash"))
    inside = F.col("source_start").between(F.col("_start"), F.col("_stop") - size)
    own = F.struct(F.col("source_doc_id").alias("id"), F.col("source_start").alias("start"))
    other = F.struct(F.col("_source_doc_id").alias("id"), (F.col("_source_start") + F.col("source_start") - F.col("_start")).alias("start"))
    traced = asked.join(known, place & inside, "left").withColumn("source", F.when(F.col("_hash").isNull(), own).otherwise(other))
    told = traced.groupBy(*at).agg(F.min("source").alias("source")).withColumnsRenamed({c: f"told_{c}" for c in at})
    same = F.col("source_doc_id").eqNullSafe(F.col("told_source_doc_id")) & (F.col("source_hash") == F.col("told_source_hash")) & (F.col("source_start") == F.col("told_source_start"))
    return found.join(told, same).select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_words"), F.col("source.id").alias("source_doc_id"), F.col("source.start").alias("source_start"))
