"""Removal of repeated word windows, behind a count-min prefilter.

Pass 1: every task counts its windows in a count-min sketch of ROWS rows, kept as the sorted cells it touched
(twice at most) and sent in blocks of cells; blocks are merged, and what stays of the sketch is one bit for each
cell: touched twice or more. Its size is fixed by `log2_cells`, so that it may be broadcast. A window is counted
under the least of its grams' hashes, which neighbours mostly share: a sketch then serves several times as many
windows. Both only overestimate: a window that repeats is flagged in every row.
Pass 2: only flagged windows go on. A task keeps the first of equal windows and removes the others itself,
so that a passage, however common, leaves a task once. The rest meet by hash, packed in arrays, and all but
the first in the corpus are removed. Removals go back to the texts by blocks of documents.

Windows are told apart by 96 bits of two polynomial hashes over 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.llm.common import by_bytes, partitions

ROWS = 2
BLOCK_LOG2 = 20
#: Windows a task holds before it sends them on.
HELD = 1 << 20
#: Bytes of packed windows of a shard that are unpacked and sorted at once, about; a larger shard is sorted in parts by hash.
SORTED = 32 << 20
#: Bytes of texts whose windows are hashed at once.
SLICE = 1 << 20
#: Parts of tasks, twice over, that make a key common.
OFTEN = 128
#: Words of the grams that stand for windows in the sketch.
GRAM = 10
M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """The polynomial hash of every `size` consecutive values, from prefix sums modulo 2**64."""
    n = len(hashes)
    powers = np.full(n, multiplier, np.uint64)
    powers[0] = 1
    inverse = np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    powers, inverse = np.cumprod(powers), np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    return _mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in a row, and each text's number of words."""
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or b"").split()
        counts[i] = len(own)
        words += own
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), counts


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def windows(texts: list[bytes | None], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every window inside a text: two hashes, text, first word, key, and whether it is the first to select its key.

    The key is the least hash of the window's grams of `gram` words, so that equal windows have equal keys. Consecutive
    windows that select it at one place count once; equal windows at different places select it at different places.
    """
    hashes, counts = word_hashes(texts)
    fit = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), fit)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(fit) - fit, fit)
    if not len(owner):
        none = np.empty(0, np.uint64)
        return none, none, owner, start, none, np.empty(0, bool)
    at = start + np.repeat(np.cumsum(counts) - counts, fit)
    grams = rolling(hashes, gram, M1)
    key = sliding_least(grams, size - gram + 1)[at]
    left = grams[at] == key
    fresh = np.r_[True, (key[1:] != key[:-1]) | left[:-1] | (owner[1:] != owner[:-1])]
    return rolling(hashes, size, M1)[at], rolling(hashes, size, M2)[at], owner, start, key, fresh


def window_keys(texts: list[bytes | None], size: int, gram: int) -> np.ndarray:
    """The keys of all windows, each once for every place where windows select it."""
    *_, key, fresh = windows(texts, size, gram)
    return key[fresh]


def _cells(h1: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return _mix(h1 + np.uint64(row * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - log2_cells)


def flagged_cells(keys: np.ndarray, bits: np.ndarray, log2_cells: int) -> np.ndarray:
    """Which keys the sketch has counted more than once in every row."""
    flagged = np.ones(len(keys), bool)
    for row in range(ROWS):
        cell = _cells(keys, row, log2_cells).astype(np.int64) + (row << log2_cells)
        flagged &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return flagged


def gaps_encoded(cells: np.ndarray) -> bytes:
    """Ascending cells as bytes: the gap to the one before, 255 for each 255 in it and then the rest."""
    gaps = np.diff(cells, prepend=0)
    long = gaps // 255
    ends = np.cumsum(long + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps - long * 255
    return out.tobytes()


def gaps_decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _sketch_parts(keys: Callable[[list], np.ndarray], log2_cells: int):
    """A task's sketch: for each row and block the cells touched, a cell touched more than once twice."""
    block_log2 = min(BLOCK_LOG2, log2_cells)

    def parts(h1: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        whole = np.concatenate(h1)
        for row in range(ROWS):
            cells = np.sort(_cells(whole, row, log2_cells).astype(np.uint32)).astype(np.int64)
            same = np.zeros(len(cells), bool)
            same[2:] = cells[2:] == cells[:-2]
            cells = cells[~same]
            block = cells >> block_log2
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                yield (row << (log2_cells - block_log2)) + int(block[a]), gaps_encoded(cells[a:b] & ((1 << block_log2) - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = list(parts(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["block", "cells"])

        for batch in batches:
            for a, b in by_bytes(batch.column(0), SLICE):
                h1 = keys(batch.column(0).slice(a, b - a).to_pylist())
                if len(h1):
                    held.append(h1)
                if sum(map(len, held)) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return work


def _merge(log2_block: int):
    """Adds up a block's parts and keeps which cells were touched twice, and which OFTEN times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, np.zeros(1 << log2_block, np.uint8)

        def done() -> pa.RecordBatch:
            bits = [zlib.compress(np.packbits(seen >= least, bitorder="little").tobytes(), 1) for least in (2, OFTEN)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([b], pa.binary()) for b in bits)], ["block", "cells", "often"])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != block:
                    if block is not None:
                        yield done()
                    block = k
                    seen[:] = 0
                cells = gaps_decoded(data.as_buffer())
                again = np.zeros(len(cells), bool)
                again[1:] = cells[1:] == cells[:-1]
                for part in (cells[~again], cells[again]):
                    seen[part] += seen[part] < 255
        if block is not None:
            yield done()

    return work


def sketched(docs: DataFrame, keys: Callable[[list], np.ndarray], log2_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged sketch of the keys of all texts of docs(text binary): rows of bits for each hash, ROWS * 2**log2_cells / 8 bytes,
    of the cells touched twice and of those touched OFTEN times, where a part of a task counts twice at most."""
    block_log2 = min(BLOCK_LOG2, log2_cells)
    parts = docs.select("text").mapInArrow(_sketch_parts(keys, log2_cells), "block int, cells binary")
    dealt = parts.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block")
    bits, often = (np.zeros((ROWS << log2_cells) // 8 if log2_cells >= 3 else ROWS, np.uint8) for _ in range(2))
    step = (1 << block_log2) // 8
    for r in dealt.mapInArrow(_merge(block_log2), "block int, cells binary, often binary").toLocalIterator():
        for whole, part in ((bits, r.cells), (often, r.often)):
            whole[r.block * step : (r.block + 1) * step] = np.frombuffer(zlib.decompress(bytes(part)), np.uint8)
    return bits, often


def repeated_cells(docs: DataFrame, keys: Callable[[list], np.ndarray], log2_cells: int) -> np.ndarray:
    return sketched(docs, keys, log2_cells)[0]


class Places:
    """Word positions of documents, packed: a document is (id is null, id, text hash)."""

    kind = np.dtype([("null", "u1"), ("id", "<i8"), ("text", "<i8")])

    @classmethod
    def of(cls, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        out = np.zeros(len(ids), cls.kind)
        out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
        out["id"] = ids.fill_null(0).to_numpy()
        out["text"] = hashes.to_numpy()
        return out

    @staticmethod
    def pack(docs: np.ndarray, index: np.ndarray, start: np.ndarray, *more: np.ndarray) -> bytes:
        """index ascends, and start in each document: starts are sent as gaps, each document's after the one before."""
        used, first = np.unique(index, return_index=True)
        counts = np.diff(np.r_[first, len(index)])
        base = np.cumsum(np.r_[0, start[np.r_[first[1:], len(index)] - 1][:-1] + 1]) if len(used) else first
        gaps = gaps_encoded(start + np.repeat(base, counts))
        head = np.array([len(used), len(index), len(gaps)], "<u4").tobytes()
        return b"".join([head, docs[used].tobytes(), counts.astype("<u4").tobytes(), *(x.tobytes() for x in more), gaps])

    @classmethod
    def unpack(cls, data: bytes, *more: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Documents, rows of each, starts, and further columns of the given types."""
        n, m, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
        at = 12
        out = []
        for kind, k in ((cls.kind, n), ("<u4", n), *((x, m) for x in more)):
            out.append(np.frombuffer(data, kind, k, at))
            at += out[-1].nbytes
        counts = out[1].astype(np.int64)
        along = gaps_decoded(data[at : at + size])
        first = np.cumsum(counts) - counts
        base = np.r_[0, along[first[1:] - 1] + 1] if n else first
        return out[0], counts, along - np.repeat(base, counts), out[2:]


def order_of(docs: np.ndarray) -> np.ndarray:
    """Rank of each document by id, those without one last; equal ids have equal ranks."""
    key = docs[["null", "id"]]
    return np.unique(key, return_inverse=True)[1].reshape(-1) if len(docs) else np.empty(0, np.int64)


def _later(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by hash and place; in that order, whether an equal window starts earlier."""
    place = rank.astype(np.int64) << 32 | start
    order = np.lexsort((place, h2, h1))
    a, b, p = h1[order], h2[order], place[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
    first = p[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else p
    return order, p != first


def gathered(packed: list[bytes], part: int = 0, parts: int = 1) -> tuple[np.ndarray, ...]:
    """Documents of all packs, and each window's document, first word and hashes; of windows whose hash is in one of `parts` parts."""
    base, found = 0, []
    for data in packed:
        docs, counts, start, (h1, h2) = Places.unpack(data, "<u8", "<u4")
        own = np.flatnonzero((h1 >> np.uint64(8)) % np.uint64(parts) == part) if parts > 1 else slice(None)
        found.append((docs, np.repeat(np.arange(len(docs)), counts)[own] + base, start[own], h1[own], h2[own]))
        base += len(docs)
    return tuple(np.concatenate(x) for x in zip(*found))


def sorted_parts(packed: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """gathered() of a shard, whole or in parts that are about SORTED bytes of it: equal windows are in one."""
    parts = 1 + sum(map(len, packed)) // SORTED
    for k in range(parts):
        yield gathered(packed, k, parts)


def _by_block(docs: np.ndarray, index: np.ndarray, start: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """Removals, packed for each block of documents."""
    if not len(index):
        return
    block = ((docs["text"] ^ docs["id"])[index].view(np.uint64) % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((start, index, block))
    index, start, block = index[order], start[order], block[order]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for a, b in zip(cuts, cuts[1:]):
        yield int(block[a]), Places.pack(docs, index[a:b], start[a:b])


_SENT = "kind int, key int, data binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "key", "data"])


def _candidates(size: int, gram: int, log2_cells: int, bits, shards: int, blocks: int):
    """Flagged windows by shard (kind 0), and removals that a task can tell by itself by block (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        held: list[tuple[np.ndarray, ...]] = []
        docs_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs_held
            docs = np.concatenate(known)
            h1, h2, index, start = (np.concatenate(x) for x in zip(*held))
            known.clear()
            held.clear()
            docs_held = 0
            # rows that repeat an id and text are one document
            docs, inverse = np.unique(docs, return_inverse=True)
            index = inverse.reshape(-1)[index]
            order, later = _later(h1, h2, order_of(docs)[index], start)
            gone, kept = order[later], order[~later]
            yield _batch([(1, k, d) for k, d in _by_block(docs, index[gone], start[gone], blocks)])
            h1, h2, index, start = h1[kept], h2[kept], index[kept], start[kept]
            shard = (h1 >> np.uint64(40)).astype(np.int64) % shards
            order = np.lexsort((start, index, shard))
            same = np.zeros(len(order), bool)
            same[1:] = (shard[order][1:] == shard[order][:-1]) & (index[order][1:] == index[order][:-1]) & (start[order][1:] == start[order][:-1])
            order = order[~same]
            h1, h2, index, start, shard = h1[order], h2[order], index[order], start[order], shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield _batch([(0, int(shard[a]), Places.pack(docs, index[a:b], start[a:b], h1[a:b], h2[a:b]))])

        for batch in batches:
            own = Places.of(batch.column("doc_id"), batch.column("hash"))
            for a, b in by_bytes(batch.column("text"), SLICE):
                h1, h2, index, start, key, _ = windows(batch.column("text").slice(a, b - a).to_pylist(), size, gram)
                flagged = flagged_cells(key, bits.value, log2_cells)
                if not flagged.any():
                    continue
                used, inverse = np.unique(index[flagged], return_inverse=True)
                known.append(own[a:b][used])
                held.append((h1[flagged], h2[flagged].astype("<u4"), inverse.reshape(-1) + docs_held, start[flagged]))
                docs_held += len(used)
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    return work


def _settle(blocks: int):
    """Groups each shard's windows exactly; passes on the removals that are settled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for docs, index, start, h1, h2 in sorted_parts(held):
                order, later = _later(h1, h2, order_of(docs)[index], start)
                gone = order[later]
                rows = [(1, k, d) for k, d in _by_block(docs, index[gone], start[gone], blocks)]
                if rows:
                    yield _batch(rows)
            held.clear()

        for batch in batches:
            kinds, keys = batch.column("kind").to_pylist(), batch.column("key").to_pylist()
            for i, (kind, key) in enumerate(zip(kinds, keys)):
                if kind:
                    yield batch.slice(i, 1)
                    continue
                if key != shard:
                    if held:
                        yield from done()
                    shard = key
                held.append(batch.column("data")[i].as_py())
        if held:
            yield from done()

    return work


def _apply(size: int):
    """Joins a block's removals, which come first, with its texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gone = None, {}
        for batch in batches:
            blocks, kinds = batch.column("block").to_pylist(), batch.column("kind").to_pylist()
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist()
            rows: list[tuple] = []
            for i, k in enumerate(blocks):
                if k != block:
                    block, gone = k, {}
                if kinds[i] == 0:
                    docs, counts, start, _ = Places.unpack(batch.column("data")[i].as_py())
                    at = 0
                    for (null, d, text), n in zip(docs.tolist(), counts.tolist()):
                        gone.setdefault((None if null else d, text), []).append(start[at : at + n])
                        at += n
                    continue
                words = (batch.column("text")[i].as_py() or b"").split()
                n = len(words)
                removed = 0
                if starts := gone.get((ids[i], hashes[i])):
                    step = np.zeros(n + 1, np.int64)
                    at = np.unique(np.concatenate(starts))
                    step[at] += 1
                    step[at + size] -= 1
                    covered = np.cumsum(step)[:n] > 0
                    removed = int(covered.sum())
                    words = [words[j] for j in np.flatnonzero(~covered)]
                kept = b" ".join(words)
                rows.append((ids[i], n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
                if len(rows) >= 512:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return work


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, size: int = 20, log2_cells: int = 28, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by spaces).

    A word goes if a window of `size` words over it also starts earlier: in a document of smaller id, or in the same
    one. A null doc_id comes after all ids. Rows that share an id and text are one document and fare alike; rows that
    share an id only are at one place in the order, and windows at equal places are not earlier than each other.
    Null texts have no words. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    n, gram = partitions(spark), min(GRAM, size)
    bits = spark.sparkContext.broadcast(repeated_cells(docs, partial(window_keys, size=size, gram=gram), log2_cells))
    # shards of windows and blocks of documents are partitions: a task sends one array to each
    sent = docs.mapInArrow(_candidates(size, gram, log2_cells, bits, n, n), _SENT)
    settled = sent.repartitionById(n, F.col("key")).sortWithinPartitions("kind", "key").mapInArrow(_settle(n), _SENT)
    gone = settled.select(F.col("key").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("binary").alias("text"), "data")
    # the block of a document is its text's hash and its id, unsigned, modulo blocks: copies of one text are dealt apart
    both = F.col("hash").bitwiseXOR(F.coalesce("doc_id", F.lit(0)))
    unsigned = F.pmod(F.pmod(F.shiftrightunsigned(both, 1), F.lit(n)) * 2 + both.bitwiseAND(F.lit(1)), F.lit(n)).cast("int")
    rows = docs.select(unsigned.alias("block"), F.lit(1).alias("kind"), "doc_id", "hash", "text", F.lit(None).cast("binary").alias("data"))
    met = gone.unionByName(rows).repartitionById(n, F.col("block")).sortWithinPartitions("block", "kind")
    return met.mapInArrow(_apply(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
