"""SimHash near-duplicates.

Texts become 64-bit fingerprints of their word shingles. A fingerprint is embedded by cutting it
into 32 segments of two bits and counting the set bits of each: fingerprints at Hamming distance d
are at Manhattan distance d at most. Within `distance` 4 over both halves of 16 segments, one half
is within 2, so that the unit grid balls of radius 1 around both points meet in a lattice cell of
that half. Points are written to the cells of their balls, cells that hold one point go, and the
points of a cell are compared: first by the Manhattan bound over all segments, then exactly.

representatives() finds texts of a shingle similarity, which are too far apart for that: at 0.8, 3 to 13 of 64 bits. It has the
same steps, without loss. A set's fingerprint is the bitmap of its shingles' hashes; cut into segments, the counts of set bits
are its embedding. Sets at the similarity differ in so many shingles at most, a share of both sizes, which bounds the
Manhattan distance of their counts. The grid's cells are shingles: in any one order of all shingles, two such sets share one of
the first of both (the prefix filter). The order has those first that no other set has, which a shuffle of a fixed share of all
shingles tells, and common ones last, by a sketch of samples. The points of a cell are joined within the bound, by Manhattan
distance alone; what such links reach is a group, and the sets of a group are made again from their texts and compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from brindle.llm import substring
from brindle.llm.common import by_bytes, least_labels, partitions, spool, unspool

SEGMENT_MASK = 0x5555555555555555
#: Points of a cell that one task compares with each other; larger cells are cut into pairs of blocks.
BLOCK = 16384
#: Segments of a set's bitmap; their counts are bytes, four longs together.
SEGMENTS = 32
#: Cells that are too large for one task, as many as may be broadcast.
BROADCASTABLE = 100_000
#: Verified links held before they are folded into a forest.
FOLD = 1 << 20
#: The larger of the samples in which the sketch counts shingles is one text of so many, or of more where the sketch would fill up.
SAMPLE = 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned SimHash of a text in UTF-8; zero if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of every row, fp the fingerprint as a signed long. Null and wordless texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in by_bytes(texts):
                fps = np.array([fingerprint(t, shingle) for t in texts.slice(a, b - a).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, fp long")


def _cells(points: DataFrame) -> DataFrame:
    """(cell, fp): the lattice cells within one step of each point's embedding, for both halves."""
    def counts(half: Column) -> Column:
        mask = F.lit(SEGMENT_MASK & 0xFFFFFFFF)
        return half.bitwiseAND(mask) + F.shiftrightunsigned(half, 1).bitwiseAND(mask)

    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = points.select("fp", F.explode(F.array(counts(low), counts(high).bitwiseOR(F.lit(1 << 40)))).alias("c"))
    around = [F.col("c")]
    for i in range(0, 32, 2):
        field = F.shiftright("c", i).bitwiseAND(F.lit(3))
        around += [F.when(field < 2, F.col("c") + F.lit(1 << i)), F.when(field > 0, F.col("c") - F.lit(1 << i))]
    return halves.select(F.explode(F.array(*around)).alias("cell"), "fp").filter(F.col("cell").isNotNull())


def _counts(fp: np.ndarray) -> np.ndarray:
    m = np.uint64(SEGMENT_MASK)
    return (fp & m) + ((fp >> np.uint64(1)) & m)


def _manhattan(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed two-bit counts: the counts 0, 1, 2 in unary are 00, 01, 11."""
    m, one = np.uint64(SEGMENT_MASK), np.uint64(1)
    unary = lambda x: ((x | (x >> one)) & m) | (x & (m << one))
    return np.bitwise_count(unary(v) ^ unary(w))


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    keep = np.flatnonzero(_manhattan(_counts(a), _counts(b)) <= distance)
    return keep[np.bitwise_count(a[keep] ^ b[keep]) <= distance]


class _Forest:
    """Links of a task, folded into one star for each of their components whenever FOLD of them are held."""

    def __init__(self):
        self.stars = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def fold(self) -> None:
        a, b = (np.concatenate([self.stars[i], *(x[i] for x in self.found)]) for i in (0, 1))
        if len(a):
            nodes, least = least_labels(a, b)
            rest = nodes != least
            self.stars = nodes[rest], least[rest]
        self.found, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append((a.view(np.int64), b.view(np.int64)))
            self.size += len(a)
            if self.size >= FOLD:
                self.fold()

    def batch(self) -> pa.RecordBatch:
        self.fold()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.stars], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of (cell, i, j), many at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        keys = [batch.column(k).to_numpy() for k in ("cell", "i", "j")]
        cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1]))
        if len(cuts):
            last = int(cuts[-1]) + 1
            rest[-1] = batch.slice(0, last)
            yield pa.Table.from_batches(rest)
            rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def _groups(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of (cell, i, j)."""
    cell, i, j = (part.column(k).to_numpy() for k in ("cell", "i", "j"))
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    return starts, np.diff(np.r_[starts, len(cell)])


def _forest(distance: int):
    """Folds the links of all cells of a task into one star for each of their components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def small(fp: np.ndarray, group: np.ndarray, most: int) -> None:
            for step in range(1, most):
                at = np.flatnonzero(group[step:] == group[:-step])
                a, b = fp[at], fp[at + step]
                hit = _close(a, b, distance)
                forest.add(a[hit], b[hit])

        def against(x: np.uint64, y: np.ndarray) -> None:
            hit = _close(np.broadcast_to(x, len(y)), y, distance)
            forest.add(np.full(len(hit), x, np.uint64), y[hit])

        for part in _runs(batches):
            i, j, blk = (part.column(k).to_numpy() for k in ("i", "j", "blk"))
            fp = part.column("fp").to_numpy().view(np.uint64)
            starts, sizes = _groups(part)
            few = (sizes <= 16) & (i[starts] == j[starts])
            pick = np.repeat(few, sizes)
            if pick.any():
                small(fp[pick], np.repeat(np.arange(len(starts)), sizes)[pick], int(sizes[few].max()))
            for g in np.flatnonzero(~few):
                s = slice(starts[g], starts[g] + sizes[g])
                if i[starts[g]] == j[starts[g]]:
                    x = fp[s]
                    for k in range(len(x) - 1):
                        against(x[k], x[k + 1 :])
                else:
                    y = fp[s][blk[s] == j[starts[g]]]
                    for x in fp[s][blk[s] == i[starts[g]]]:
                        against(x, y)
        yield forest.batch()

    return work


def links(points: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fps within distance (at most 4)."""
    if not 0 <= distance <= 4:
        raise ValueError("the grid of two halves with balls of radius 1 is exact up to distance 4")
    return _dealt(_cells(points), "fp", BLOCK).mapInArrow(_forest(distance), "a long, b long")


def _dealt(rows: DataFrame, key: str, block: int, counted: DataFrame | None = None) -> DataFrame:
    """rows(cell, ...) dealt by cell and sorted, with blk, i, j: cells of more than `block` rows are cut into blocks by key, and
    each pair of blocks i, j meets apart; a row is written once for each partner of its own block blk.

    Cells are counted with partial sums, so that no task holds a large one before it is cut; in `counted`, a cheaper table that has
    as many rows of each cell at least, if there is one.
    """
    spark = rows.sparkSession
    hot = (rows if counted is None else counted).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    some = hot.limit(BROADCASTABLE + 1).collect()
    if some:
        if len(some) <= BROADCASTABLE:
            hot = F.broadcast(spark.createDataFrame(some, hot.schema))
        names = rows.columns
        rows = rows.join(hot, "cell", "left")
        rows = rows.withColumn("_blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
        rows = rows.select(*names, F.pmod(F.xxhash64(key), "_blocks").cast("int").alias("blk"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
        rows = rows.select(*names, "blk", F.least("blk", "_other").alias("i"), F.greatest("blk", "_other").alias("j"))
    else:
        rows = rows.select("*", *(F.lit(0).alias(c) for c in ("blk", "i", "j")))
    return rows.repartition(partitions(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots, their components' least nodes: large and small stars in turn.

    Each round's edges are written to the shared folder; rounds end when the edges no longer change.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = spool(edges, "edges")
    before = None
    while True:
        # around a node whose least neighbour is itself or larger the large star changes nothing, so that only lesser ones are sought; they
        # are written, as a join of two plain tables has its hot keys split
        lesser = spool(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "lesser")
        large = edges.join(lesser, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, spool(small.distinct(), "edges")
        unspool(last)
        unspool(lesser)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _roots(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, least, root): every fingerprint with its least doc_id and the least fingerprint of its component."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(points.select("fp"), distance))
    return points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id among the documents that links of at most `distance` bits reach.
    Null, empty and wordless texts have fingerprint zero and are linked by it like any other. Rows that
    repeat a doc_id stay rows of their own. A null doc_id stays null, and is never a component's id
    unless all of its documents have none. Empty input gives no rows; other columns are ignored.
    """
    prints = spool(fingerprints(docs, text, doc_id, shingle), "prints")
    rooted = _roots(prints, distance)
    ids = spool(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = rooted.join(ids, "root").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(named, F.col("fp") == F.col("fp_")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's set of word shingles, ascending; a text of fewer words is one shingle, one of none has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64))


def _salted(hashes: np.ndarray, sample: int) -> np.ndarray:
    return substring._mix(hashes ^ np.uint64(sample * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _samples(docs: DataFrame, log2_cells: int) -> tuple[int, int]:
    """One text of so many is in a sample, for two of them; neither has more shingles than a sixteenth of the cells, at some six bytes a word."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    rate = max(SAMPLE, -(-words * 16 >> log2_cells))
    return rate, 16 * rate


def _sketch_keys(texts: list[bytes | None], shingle: int, samples: tuple[int, int]) -> np.ndarray:
    """The shingles of each text, salted, for every sample that it is in. What the sketch counts twice is common."""
    out = [np.empty(0, np.uint64)]
    for text in texts:
        name = xxh64_intdigest(text or b"")
        if name % samples[0] == 0:
            own = shingles(text, shingle)
            out += [_salted(own, k) for k in samples if name % k == 0]
    return np.concatenate(out)


def _few(size: int, similarity: Fraction) -> int:
    """A set that lacks so many of its shingles in another is not similar to it."""
    return size - math.ceil(similarity * size) + 1


def _bound(similarity: Fraction) -> int:
    """Shingles below, as signed longs, are the share of all whose company is counted: half as many again as two similar sets may differ in."""
    return int(-(1 << 63) + min(Fraction(1), Fraction(3, 2) * (1 - similarity)) * ((1 << 64) - 1))


def _first(own: np.ndarray, similarity: Fraction, bits: np.ndarray, log2_cells: int, samples: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the common order, rare shingles by value and then common ones: the first few of a set and all rare ones below the bound, as
    rare and common ones; and how many are below."""
    common = sum(substring.flagged_cells(_salted(own, k), bits, log2_cells).astype(int) for k in samples)
    own = own.view(np.int64)
    few, rare = _few(len(own), similarity), np.sort(own[common == 0])
    below = int(np.searchsorted(rare, _bound(similarity)))
    rest = own[common > 0][np.lexsort((own[common > 0], common[common > 0]))]
    return rare[: max(few, below)], rest[: max(0, few - len(rare))], below


def _embedding(own: np.ndarray) -> np.ndarray:
    """The bit counts of the segments of a set's bitmap, 255 at most each."""
    return np.minimum(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=SEGMENTS), 255).astype(np.uint8)


_EMBEDDED = [f"e{k}" for k in range(SEGMENTS // 8)]


def _sets(docs: DataFrame, similarity: Fraction, shingle: int, bits, log2_cells: int, samples: tuple[int, int]) -> DataFrame:
    """(doc_id, text_hash, node, size, below, e0.., rare, common) of docs(doc_id, text_hash, text): node is the set's hash. What follows it is null
    for the empty set, and where the task has sent the same set before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            texts = batch.column("text")
            for a, b in by_bytes(texts):
                nodes, sizes, belows, counts, rares, commons = [], [], [], [], [], []
                for own in (shingles(t, shingle) for t in texts.slice(a, b - a).to_pylist()):
                    nodes.append(xxh64_intdigest(own.tobytes()))
                    fresh = len(own) and nodes[-1] not in sent
                    if fresh:
                        sent.add(nodes[-1])
                    rare, common, below = _first(own, similarity, bits.value, log2_cells, samples) if fresh else (None, None, None)
                    sizes.append(len(own) if fresh else None)
                    belows.append(below)
                    counts.append(_embedding(own).view(np.int64) if fresh else None)
                    rares.append(rare)
                    commons.append(common)
                made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(belows, pa.int32())]
                made += [pa.array([None if c is None else int(c[k]) for c in counts], pa.int64()) for k in range(len(_EMBEDDED))]
                made += [pa.array(x, pa.list_(pa.int64())) for x in (rares, commons)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *made], ["doc_id", "text_hash", "node", "size", "below", *_EMBEDDED, "rare", "common"])

    return docs.mapInArrow(work, f"doc_id long, text_hash long, node long, size int, below int, {', '.join(f'{c} long' for c in _EMBEDDED)}, rare array<long>, common array<long>")


def _in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (cell, node), each row once, and those alone that share their cell with another node."""

    def once(cell: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.r_[True, (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])][: len(cell)]
        return cell[fresh], node[fresh]

    def shared(cell: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        same = cell[1:] == cell[:-1]
        keep = (np.r_[False, same] | np.r_[same, False])[: len(cell)]
        return pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(node[keep])], ["cell", "node"])

    cell, node = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            cell, node = once(np.r_[cell, batch.column("cell").to_numpy()], np.r_[node, batch.column("node").to_numpy()])
            last = int(np.searchsorted(cell, cell[-1]))
            yield shared(cell[:last], node[:last])
            cell, node = cell[last:], node[last:]
    yield shared(cell, node)


def _cells_of_sets(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(node, size, e0.., cells) of the sets that others may be similar to: two that are have a cell in common.

    Rare shingles meet by value. One below the bound that has no company there is in no other set, as every set has sent it: with as many
    of them as two similar sets may differ in, a set goes, and with fewer they come first in the order, so that as many less of the others are needed.
    Common ones, in which many sets may meet, are not asked.
    """
    sets = sets.filter("size is not null")
    rare = sets.select(F.explode("rare").alias("cell"), "node")
    met = rare.repartition(partitions(sets.sparkSession), "cell").sortWithinPartitions("cell", "node").mapInArrow(_in_company, "cell long, node long")
    met = met.groupBy("node").agg(F.sort_array(F.collect_list("cell")).alias("met"))
    # sets of equal nodes are equal
    names = ["size", "below", *_EMBEDDED, "common"]
    every = sets.groupBy("node").agg(*(F.first(c).alias(c) for c in names)).join(met, "node", "left").withColumn("met", F.coalesce("met", F.array().cast("array<long>")))
    few = f"(size - ({similarity.numerator} * cast(size as long) + {similarity.denominator - 1}) div {similarity.denominator} + 1)"
    wanted = F.expr(f"cast({few} - below + size(filter(met, c -> c < {_bound(similarity)})) as int)")
    every = every.withColumn("wanted", wanted).filter("wanted > 0").withColumn("cells", F.slice(F.concat("met", "common"), F.lit(1), F.col("wanted")))
    return every.filter("size(cells) > 0").select("node", "size", *_EMBEDDED, "cells")


def _keys_twice(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).repeat(2)


def _some(hashes: DataFrame, log2_cells: int) -> np.ndarray:
    """A sketch of fixed size that flags all of hashes(h), and few others."""
    return substring.repeated_cells(hashes.select(F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("text")), _keys_twice, log2_cells)


def _sets_again(docs: DataFrame, shingle: int, bits, log2_cells: int) -> DataFrame:
    """(node, shingles) of the texts of docs(doc_id, text_hash, text) whose hashes are flagged, each set once a task at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            texts = batch.column("text").filter(pa.array(substring.flagged_cells(batch.column("text_hash").to_numpy().view(np.uint64), bits.value, log2_cells)))
            for a, b in by_bytes(texts):
                made = {xxh64_intdigest(own.tobytes()): own.tobytes() for own in (shingles(t, shingle) for t in texts.slice(a, b - a).to_pylist())}
                made = {node: own for node, own in made.items() if node not in sent}
                sent.update(made)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(made), np.uint64).view(np.int64)), pa.array(list(made.values()), pa.binary())], ["node", "shingles"])

    return docs.select("text_hash", "text").mapInArrow(work, "node long, shingles binary")


def _peel(node: np.ndarray, alike: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], forest: _Forest) -> None:
    """Links of a group whose components are those of all its pairs that are alike.

    alike(k, others) tells which of the others are alike to k, and which may be alike to one that is. Once a point's
    likes hang on it, they are compared with the latter alone, so that a group of near copies costs one pass.
    """
    left = np.arange(len(node))
    while len(left) > 1:
        k, left = left[0], left[1:]
        hit, about = alike(k, left)
        near, border = left[hit], left[about & ~hit]
        forest.add(np.full(len(near), node[k]), node[near])
        few, more = (near, border) if len(near) < len(border) else (border, near)
        for x in few if len(more) else ():
            linked = more[alike(x, more)[0]]
            forest.add(np.full(len(linked), node[x]), node[linked])
        left = left[~hit]


def _bounded_forest(similarity: Fraction):
    """Links of the points of each cell whose sizes and counts of segments are within the bound that sets of the similarity keep, folded.

    Such sets A and B differ in (1 - s) / (1 + s) of |A| + |B| shingles at most.
    """
    up, down = similarity.denominator - similarity.numerator, similarity.denominator + similarity.numerator

    def apart(size: np.ndarray, counts: np.ndarray, a, b) -> np.ndarray:
        return np.maximum(np.abs(counts[a] - counts[b]).sum(-1, dtype=np.int64), np.abs(size[a] - size[b]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def alike_in(size: np.ndarray, counts: np.ndarray):
            def alike(k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                d = apart(size, counts, k, others)
                # by way of a set alike to k, whose size is that of k over the similarity at most
                between = size[others] + size[k] + 2 * size[k] * similarity.denominator // similarity.numerator
                return d * down <= up * (size[k] + size[others]), d * down <= up * between

            return alike

        for part in _runs(batches):
            node, size = part.column("node").to_numpy(), part.column("size").to_numpy().astype(np.int64)
            counts = np.stack([part.column(c).to_numpy() for c in _EMBEDDED], 1).view(np.uint8).astype(np.int16)
            starts, sizes = _groups(part)
            few = sizes <= 16
            group = np.where(np.repeat(few, sizes), np.repeat(np.arange(len(starts)), sizes), -1)
            for step in range(1, int(sizes[few].max()) if few.any() else 1):
                at = np.flatnonzero((group[step:] == group[:-step]) & (group[step:] >= 0))
                at = at[apart(size, counts, at, at + step) * down <= up * (size[at] + size[at + step])]
                forest.add(node[at], node[at + step])
            for g in np.flatnonzero(~few):
                own = slice(starts[g], starts[g] + sizes[g])
                _peel(node[own], alike_in(size[own], counts[own]), forest)
        yield forest.batch()

    return work


def _exact_forest(similarity: Fraction):
    """Links of the sets of each run that have the similarity, folded. One less the similarity is a metric: what is alike to a
    set's like is within twice the distance of it."""
    far = 2 * similarity - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def alike_in(sets: list[np.ndarray]):
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            size = np.array([len(x) for x in sets])
            stop = np.cumsum(size)
            own = [flat.reshape(-1)[b - n : b] for b, n in zip(stop, size)]
            mark = np.zeros(len(names), bool)

            def alike(k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if not len(others):
                    return np.empty(0, bool), np.empty(0, bool)
                mark[own[k]] = True
                begin = np.r_[0, np.cumsum(size[others])[:-1]]
                both = np.add.reduceat(mark[np.concatenate([own[x] for x in others])], begin, dtype=np.int64)
                mark[own[k]] = False
                either = size[k] + size[others] - both
                return tuple(both * x.denominator >= either * x.numerator for x in (similarity, far))

            return alike

        for part in _runs(batches):
            node, sets = part.column("node").to_numpy(), part.column("shingles")
            for start, n in zip(*_groups(part)):
                if n > 1:
                    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.slice(start, n)]
                    _peel(node[start : start + n], alike_in(own), forest)
        yield forest.batch()

    return work


def exact_links(sets: DataFrame, points: DataFrame, docs: DataFrame, similarity: Fraction, shingle: int, log2_cells: int, block: int = 1024) -> DataFrame:
    """(a, b): links whose components are those of all pairs of sets (node, size, e0.., cells) of the similarity.

    points(node, place) and docs(doc_id, text_hash, text) tell the sets' texts. Cells and groups of more than `block` sets are cut into
    pairs of blocks. unspool() deletes the sets that the links are made of, once these are written.
    """
    spark = sets.sparkSession
    cells = sets.select(F.explode("cells").alias("cell"), "node", "size", *_EMBEDDED)
    near = _dealt(cells, "node", block).mapInArrow(_bounded_forest(similarity), "a long, b long")
    groups = components(near)
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "cell")
    bits = spark.sparkContext.broadcast(_some(members.join(points, "node").select(F.col("place.text_hash").alias("h")), log2_cells))
    own = _sets_again(docs, shingle, bits, log2_cells).join(members, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("cell", "shingles")))
    own = spool(own, "groups")
    bits.unpersist()
    out = _dealt(own, "node", block).mapInArrow(_exact_forest(similarity), "a long, b long")
    out._spooled = own._spooled
    return out


def _ordered(column: Column, kind: T.DataType) -> Column:
    """Something to order any column by."""
    def whole(k: T.DataType) -> bool:
        if isinstance(k, T.StructType):
            return all(whole(f.dataType) for f in k.fields)
        return whole(k.elementType) if isinstance(k, T.ArrayType) else not isinstance(k, (T.MapType, T.VariantType, T.CalendarIntervalType))

    return column if whole(kind) else F.to_json(F.struct(column.alias("c")))


def representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, log2_cells: int = 27, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs, with all its columns, for each group of near copies: of its least doc_id, then of its least text hash.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of `similarity` or more, and what such links
    reach; pairs are compared whole, and none is missed. Null, empty and wordless texts are one group. A null doc_id comes
    after all ids. Of rows that share id and text the first by their other columns stays, maps among them by their JSON. Other
    columns may have any name and type, or be absent. Empty input gives no rows.
    """
    least = Fraction(similarity).limit_denominator(1000)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    samples = _samples(keyed, log2_cells)
    bits = docs.sparkSession.sparkContext.broadcast(substring.repeated_cells(keyed, partial(_sketch_keys, shingle=shingle, samples=samples), log2_cells))
    prints = spool(_sets(keyed, least, shingle, bits, log2_cells, samples), "prints")
    bits.unpersist()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    points = spool(prints.groupBy("node").agg(F.min(place).alias("place")), "points")
    again = prints.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    again = spool(again, "again")
    sets = spool(_cells_of_sets(prints, least), "sets")
    unspool(prints)
    near = exact_links(sets, points, keyed, least, shingle, log2_cells)
    roots = components(near).withColumnRenamed("node", "node_")
    unspool(near)
    unspool(sets)
    rooted = points.join(roots, F.col("node") == F.col("node_"), "left").select("place", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.doc_id").alias("_id"), F.col("place.text_hash").alias("_hash"))
    repeated = not again.isEmpty()

    names = docs.columns
    renamed = [f"c{i}" for i in range(len(names))]
    rows = docs.select(F.col(doc_id).cast("long").alias("_k"), F.xxhash64(text).alias("_h"), *(F.col(f"`{c}`").alias(r) for c, r in zip(names, renamed)))
    same = lambda x: F.col("_k").eqNullSafe(x["_id"]) & (F.col("_h") == x["_hash"])
    rows = rows.join(kept, same(kept), "left_semi")
    if repeated:
        order = [_ordered(F.col(r), f.dataType) for r, f in zip(renamed, docs.schema.fields) if f.name not in (text, doc_id)]
        first = rows.join(again, same(again), "left_semi").groupBy("_k", "_h").agg(F.min_by(F.struct(*renamed), F.struct(*order or [F.lit(0)])).alias("r"))
        rows = rows.join(again, same(again), "left_anti").select(*renamed).unionByName(first.select(*(F.col(f"r.{r}").alias(r) for r in renamed)))
    return rows.select(*(F.col(r).alias(c) for c, r in zip(names, renamed)))
