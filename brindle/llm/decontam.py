"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

A window is contained or it is not, so that its necessary prefix under an order by rarity is one
token: its rarest by the counts of the whole corpus. Documents are probed with those tokens alone;
a token's place in its window gives the place of the window in the document (positional bound),
which must lie inside the document (length bound); then the window's words are compared.

Benchmark items come in blocks of bounded bytes, of which one is held at a time. A benchmark of one block is broadcast and passes
once over the documents for the counts and once for the probe, both without a shuffle of texts. For a larger one all
words are counted once, with a shuffle of counts; each block is then probed by itself, its hits are written by the
text's digest, once for a text however often it occurs, and join the documents in the end. A benchmark of any size is
covered whole; each block costs a pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import by_bytes, spool, unspool

#: Bytes of item text in a block at most, but for an item that is longer by itself.
BLOCK_BYTES = 4 << 20
#: Words that a task counts before it sends them on.
HELD = 1 << 19
#: A to Z in lower case; 0-9, a-z and all bytes of other code points stay; the rest separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield words[i : i + window]


def _items(benchmark: DataFrame, text: str, item_id: str) -> tuple[DataFrame, int]:
    """(id, text, block) of the items, each once, and the number of blocks."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("binary").alias("text"))
    items = items.filter("text is not null").distinct()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    return items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


def _counter(vocabulary):
    """Counts of the words of a task's texts, of those in a broadcast vocabulary if there is one; sent whenever HELD words are known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        has = vocabulary.value.__contains__ if vocabulary is not None else None

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                found.update(filter(has, words) if has else words)
                if len(found) > HELD:
                    yield sent()
        yield sent()

    return count


def _counts(docs: DataFrame, vocabulary=None) -> DataFrame:
    """(word, n): how often each word, or each of a broadcast vocabulary, occurs in all documents."""
    return docs.select("text").mapInArrow(_counter(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = sorted(set(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.binary())], ["block", "word"])


def _index(items: list[tuple[str, bytes]], window: int, counts: dict[bytes, int]) -> tuple[dict, dict]:
    """Rarest word -> its (place, length) in windows; window -> items. Windows with a word no document has go."""
    probe: dict[bytes, set[tuple[int, int]]] = {}
    held: dict[bytes, set[str]] = {}
    for name, text in items:
        for w in windows_of(words_of(text), window):
            n, _, at = min((counts.get(x, 0), x, i) for i, x in enumerate(w))
            if n:
                probe.setdefault(w[at], set()).add((at, len(w)))
                held.setdefault(b" ".join(w), set()).add(name)
    return {k: sorted(v) for k, v in probe.items()}, held


def _find(words: list[bytes], probe: dict, held: dict) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items = [], set()
    tried: set[tuple[int, int]] = set()
    for i in [i for i, w in enumerate(words) if w in probe]:
        for at, size in probe[words[i]]:
            s = i - at
            if s < 0 or s + size > len(words) or (s, size) in tried:
                continue
            tried.add((s, size))
            if names := held.get(b" ".join(words[s : s + size])):
                spans.append((s, s + size))
                items |= names
    return spans, items


def _covered(spans: list[tuple[int, int]], n: int) -> int:
    step = np.zeros(n + 1, np.int64)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return int((np.cumsum(step)[:n] > 0).sum())


def _verdict(words: list[bytes], spans: list[tuple[int, int]], items: set[str], share: int) -> tuple:
    n, hit = len(words), _covered(spans, len(words)) if spans else 0
    listed = sorted(items)
    return n, hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), hit > 0 and share * hit >= n, listed


def _hits(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """(_key, _spans, _items): the spans and items of every text that has hits, by the text's digest."""
    spark = docs.sparkSession
    words = items.select("block", "text").mapInArrow(_distinct_words, "block long, word binary").distinct()
    counts = spool(words.join(_counts(docs), "word"), "counts")
    found = None
    for k in range(blocks):
        known = {bytes(r.word): r.n for r in counts.filter(F.col("block") == k).collect()}
        index = spark.sparkContext.broadcast(_index([(r.id, bytes(r.text)) for r in items.filter(F.col("block") == k).collect()], window, known))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe, held = index.value
            for batch in batches:
                rows = []
                for key, text in zip(batch.column("_key").to_pylist(), batch.column("text")):
                    spans, names = _find(words_of(text.as_py()), probe, held)
                    if spans:
                        rows.append((key, [x for s in spans for x in s], sorted(names)))
                kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["_key", "_spans", "_items"])

        part = docs.select("text", F.md5("text").alias("_key")).mapInArrow(search, "_key string, _spans array<long>, _items array<string>")
        part = spool(part.groupBy("_key").agg(F.first("_spans").alias("_spans"), F.first("_items").alias("_items")), "hits")
        index.destroy()
        found = part if found is None else found.unionByName(part)
    unspool(counts)
    every = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  a row for each block at most
    return found.groupBy("_key").agg(every("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, share: int, item_text: str, item_id: str, keep: bool) -> DataFrame:
    """Reports on docs, text (binary) first, or keeps the clean rows of them without it."""
    spark = docs.sparkSession
    items, blocks = _items(benchmark, item_text, item_id)
    if blocks == 1:
        own = [(r.id, bytes(r.text)) for r in items.collect()]
        vocabulary = spark.sparkContext.broadcast({w for _, t in own for w in words_of(t)})
        known = {bytes(r.word): r.n for r in _counts(docs, vocabulary).collect()}
        index = spark.sparkContext.broadcast(_index(own, window, known))
        rows = docs.withColumns({"_spans": F.lit(None).cast("array<long>"), "_items": F.lit(None).cast("array<string>")})
    else:
        index = None
        hits = _hits(docs, items, blocks, window).withColumnsRenamed({"_key": "_text_key", "_spans": "_hit", "_items": "_names"})
        rows = docs.withColumn("_md5", F.md5("text")).join(hits, F.col("_md5") == F.col("_text_key"), "left").select(*docs.columns, F.col("_hit").alias("_spans"), F.col("_names").alias("_items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, held = index.value if index is not None else ({}, {})
        for batch in batches:
            for x, y in by_bytes(batch.column("text"), 1 << 20):
                part = batch.slice(x, y - x)
                out = []
                for text, spans, names in zip(part.column("text"), part.column("_spans").to_pylist(), part.column("_items").to_pylist()):
                    words = words_of(text.as_py())
                    a, b = _find(words, probe, held) if index is not None else (list(zip((spans or [])[::2], (spans or [])[1::2])), set(names or ()))
                    out.append(_verdict(words, a, b, share))
                if keep:
                    mask = pa.array([not r[4] for r in out], pa.bool_())
                    yield pa.RecordBatch.from_arrays(part.columns[1:-2], part.schema.names[1:-2]).filter(mask)
                else:
                    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.string())]
                    cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names)

    return rows.mapInArrow(finish, T.StructType(docs.schema.fields[1:]) if keep else _REPORT)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A word inside an occurrence of a window of an item is hit; a document is contaminated if
    share * n_hit >= n_words > 0 words are. An item of fewer words than a window is one window; an item
    without words has none. Null texts have no words. Items that repeat an item_id are one item, those
    without an id are the item "". Repeated documents are reported each; empty tables give no rows, or
    no hits. Other columns are ignored.
    """
    docs = docs.select(F.col(text).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return _passes(docs, benchmark, window, share, item_text, item_id, keep=False)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs that contamination() does not flag, with all their columns.

    Null, empty and wordless texts stay. Rows that repeat, and rows with a null id, stay or go by their own text. Empty tables
    give no rows, or all of docs.
    """
    names = docs.columns
    rows = docs.select(F.col(text).cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    return _passes(rows, benchmark, window, share, item_text, item_id, keep=True).toDF(*names)
