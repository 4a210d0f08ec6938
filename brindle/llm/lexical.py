"""Ranked lexical search over a clustered index, exact.

Recursive graph bisection orders the documents: a set is halved, and documents are swapped between the halves as long as that lowers
the log-gap cost of the terms' postings; the halves are halved again. It is fitted on a bounded sample (`fitted` documents for each
leaf), by the SAMPLED terms of least hash of a document, which leaves at every node a weight for each of 2^14 hashed terms, by which every document finds its
leaf in one pass. Leaves in their order are the clusters. A leaf's documents are dealt to as many tasks as its share of the bytes
asks for, and cut into shards of bounded size as they come, so that a leaf that a third of all rows shares is many shards. A shard is
inverted: for each term its documents, how often they hold it, and the greatest contribution that any of them gets from it.

A search sums, for each item and cluster, the greatest contributions of the item's terms: no document of the cluster scores higher.
Clusters are visited by falling bounds, 1, then 4, then 16 of them and so on; an item stops when the next bound is below its k-th
score so far. A bound that equals it is still visited, as ties go by doc_id. The bound holds for all rows, so that the result
is that of scoring everything, whatever the order that the sample led to.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import partitions, spool
from brindle.llm.decontam import words_of

#: Hashed terms that the bisection tells apart, and terms of a document that it goes by.
FEATURES = 1 << 14
SAMPLED = 192
#: Bytes of text that make a cluster and a shard, and the least and most levels of the bisection.
CLUSTER_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
LEVELS = (3, 10)
#: Items whose requests one task of a shard answers.
ITEMS = 2048
#: Rows of asked terms that are broadcast to the postings at most; beyond, the asked ones are most of the postings and Spark joins by size.
ASKED = 1 << 19
_INDEX = "leaf int, shard long, term binary, df long, top long, places array<int>, counts array<int>, ids array<long>, sizes array<long>"


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _features(terms) -> np.ndarray:
    """The hashed terms of least hash, SAMPLED at most: those of all documents are one sample of the terms."""
    found = np.fromiter(map(zlib.crc32, terms), np.int64)
    if len(found) > SAMPLED:
        found = np.partition(found, SAMPLED - 1)[:SAMPLED]
    return np.unique(found % FEATURES)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def _halves(docs: list[np.ndarray], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Halves of documents by swaps of most gain, and the number of each term's documents in both."""
    flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    second = np.arange(len(docs)) >= len(docs) // 2
    n = (int((~second).sum()), int(second.sum()))
    for _ in range(rounds):
        degree = [np.bincount(flat[second[owner] == half], minlength=FEATURES).astype(float) for half in (False, True)]
        move = [_cost(degree[h], n[h]) + _cost(degree[1 - h], n[1 - h]) - _cost(np.maximum(degree[h] - 1, 0), n[h]) - _cost(degree[1 - h] + 1, n[1 - h]) for h in (0, 1)]
        gain = np.bincount(owner, np.where(second[owner], move[1][flat], move[0][flat]), len(docs))
        left, right = (np.flatnonzero(second == half) for half in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        pairs = min(len(left), len(right))
        swap = int((gain[left[:pairs]] + gain[right[:pairs]] > 1e-9).sum())
        if not swap:
            break
        second[left[:swap]], second[right[:swap]] = True, False
    return second, np.stack([np.bincount(flat[second[owner] == half], minlength=FEATURES) for half in (False, True)]).astype(float)


def bisect(docs: list[np.ndarray], levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and a threshold for each node, in heap order: documents whose weights sum to more go to the second half."""
    weights, above = np.zeros(((1 << levels) - 1, FEATURES), np.float32), np.full((1 << levels) - 1, np.inf)

    def split(node: int, rows: list[np.ndarray]) -> None:
        if node >= len(above):
            return
        if len(rows) > 1:
            second, (a, b) = _halves(rows)
            n = int((~second).sum()), int(second.sum())
            # what one more document costs in the first half, less what it costs in the second
            weights[node] = (_cost(a + 1, n[0]) - _cost(a, n[0])) - (_cost(b + 1, n[1]) - _cost(b, n[1]))
            score = np.array([float(weights[node][r].sum()) for r in rows])
            # between the halves, where they part; copies go to one side
            middle = float(np.sort(score)[(len(rows) - 1) // 2 :][:2].mean())
            if (score > middle).any():
                above[node] = middle
        goes = np.array([float(weights[node][r].sum()) > above[node] for r in rows], bool)
        split(2 * node + 1, [r for r, g in zip(rows, goes) if not g])
        split(2 * node + 2, [r for r, g in zip(rows, goes) if g])

    split(0, [r for r in docs if len(r)])
    return weights, above


def _leaf(features: np.ndarray, weights: np.ndarray, above: np.ndarray) -> int:
    node = 0
    while node < len(above):
        node = 2 * node + 1 + int(float(weights[node][features].sum()) > above[node])
    return node - len(above)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = docs = terms = size = 0
    for batch in batches:
        for text in batch.column(0):
            raw = text.as_py() or b""
            n = len(words_of(raw))
            rows, docs, terms, size = rows + 1, docs + (n > 0), terms + n, size + len(raw)
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (rows, docs, terms, size)], ["rows", "n", "l", "bytes"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(0)]
        found = [_features(set(words_of(t))).tolist() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(map(len, texts), pa.int64())], ["features", "bytes"])


def _greatest(counts: np.ndarray, sizes: np.ndarray, n: int, length: int) -> np.ndarray:
    """A term's contribution to documents, before its weight."""
    m = 75 + 25 * sizes * n // length
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


class _Shard:
    """Documents on their way into the index; numbers in place of words, so that few bytes are held beyond the postings."""

    def __init__(self, leaf: int):
        self.leaf, self.bytes = leaf, 0
        self.numbers = _Numbers()
        self.terms, self.counts, self.held = array("i"), array("i"), array("i")
        self.ids: list[int | None] = []
        self.sizes = array("q")

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = Counter(words_of(text))
        self.terms.extend(map(self.numbers.__getitem__, found))
        self.counts.extend(found.values())
        self.held.append(len(found))
        self.sizes.append(found.total())
        self.ids.append(doc_id)
        self.bytes += len(text) + 64

    def inverted(self, shard: int, n: int, length: int) -> pa.RecordBatch:
        """A row for each term, and one for the shard."""
        names = sorted(self.numbers)
        new = np.empty(len(names), np.int64)
        new[[self.numbers[t] for t in names]] = np.arange(len(names))
        term = new[np.array(self.terms, np.int64)]
        order = np.argsort(term, kind="stable")
        size = np.array(self.sizes, np.int64)
        count, place = np.array(self.counts, np.int64)[order], np.repeat(np.arange(len(self.ids)), self.held)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int32)
        top = np.maximum.reduceat(_greatest(count, size[place], n, length), ends[:-1]) if len(names) else np.zeros(0, np.int64)
        with_own = np.append(ends, ends[-1])
        lists = [pa.ListArray.from_arrays(with_own, pa.array(x.astype(np.int32))) for x in (place, count)]
        rows = len(names) + 1
        own = [pa.array([None] * len(names) + [x], pa.list_(pa.int64())) for x in (self.ids, size)]
        columns = [pa.array([self.leaf] * rows, pa.int32()), pa.array([shard] * rows, pa.int64()), pa.array([*names, None], pa.binary()), pa.array([*np.diff(ends), 0], pa.int64()), pa.array([*top, 0], pa.int64()), *lists, *own]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])


def _inverter(n: int, length: int, most: int):
    """Shards of rows that come leaf by leaf: a leaf's documents up to `most` bytes, or a longer one by itself."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, shard = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            for leaf, doc_id, text in zip(batch.column("leaf").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_py() or b""
                if shard is not None and (shard.leaf != leaf or shard.bytes + len(raw) > most):
                    yield shard.inverted(first + done, n, length)
                    shard, done = None, done + 1
                shard = shard or _Shard(leaf)
                shard.add(doc_id, raw)
        if shard is not None:
            yield shard.inverted(first + done, n, length)

    return invert


class Index:
    """table: a row for each term of a shard, and one without a term for the shard itself, with its doc_ids. n, length: of the corpus."""

    def __init__(self, table: DataFrame | None, n: int, length: int):
        self.table, self.n, self.length = table, n, length


def build(docs: DataFrame, fitted: int = 64, text: str = "text", doc_id: str = "doc_id") -> Index:
    """The clustered index of all rows. fitted: documents for each leaf that the bisection is fitted on.

    Null texts have no terms. Rows that repeat an id are documents each; a null id stays null. No terms at all give an index without a table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    sums = rows.select("text").mapInArrow(_totals, "rows long, n long, l long, bytes long").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "l", "bytes"))).first()
    if not sums.l:
        return Index(None, 0, 0)
    levels = min(LEVELS[1], max(LEVELS[0], int(np.ceil(np.log2(max(1, sums.bytes / CLUSTER_BYTES))))))
    most = fitted << levels
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, sums.rows // most))) == 0).select("text")
    sample = chosen.mapInArrow(_sampled, "features array<int>, bytes long").limit(2 * most).collect()
    features = [np.array(r.features, np.int64) for r in sample]
    weights, above = bisect(features, levels)
    share = np.zeros(1 << levels)
    for f, r in zip(features, sample):
        share[_leaf(f, weights, above)] += r.bytes
    # a leaf's rows are dealt to as many tasks as its share of the bytes asks for
    n = partitions(spark)
    deals = np.maximum(1, np.ceil(4 * n * share / max(1.0, share.sum()))).astype(int)
    tree = spark.sparkContext.broadcast((weights, above, deals))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, above, deals = tree.value
        for batch in batches:
            leaf = np.array([_leaf(_features(set(words_of(t.as_py()))), weights, above) for t in batch.column("text")], np.int64)
            deal = batch.column("deal").to_numpy() % deals[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(deal, pa.int64()), batch.column("doc_id"), batch.column("text")], ["leaf", "deal", "doc_id", "text"])

    # copies, and rows that repeat an id, are dealt apart too
    deal = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 40)).alias("deal")
    placed = rows.select("doc_id", "text", deal).mapInArrow(place, "leaf int, deal long, doc_id long, text binary")
    dealt = placed.repartition(n, "leaf", "deal").sortWithinPartitions("leaf").select("leaf", "doc_id", "text")
    table = spool(dealt.mapInArrow(_inverter(sums.n, sums.l, SHARD_BYTES), _INDEX), "index")
    return Index(table, sums.n, sums.l)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = Counter(words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item", "term", "times"])


def _scorer(k: int, n: int, length: int):
    def score(postings: pa.Table, asked: pa.Table) -> pa.Table:
        terms, out = {}, [[], [], []]
        for i, term in enumerate(postings.column("term").to_pylist()):
            if term is None:
                own = postings.slice(i, 1)
                ids, sizes = own.column("ids")[0].as_py(), own.column("sizes")[0].values.to_numpy()
            else:
                terms[term] = i
        found: dict[bytes, tuple] = {}
        missing = np.array([x is None for x in ids])
        known = np.array([0 if x is None else x for x in ids], np.int64)
        for item, wanted, weight in zip(asked.column("item").to_pylist(), asked.column("terms").to_pylist(), asked.column("weights").to_pylist()):
            total = np.zeros(len(ids), np.int64)
            for t, w in zip(wanted, weight):
                if t not in terms:
                    continue
                if t not in found:
                    places, counts = (postings.column(c)[terms[t]].values.to_numpy().astype(np.int64) for c in ("places", "counts"))
                    found[t] = places, _greatest(counts, sizes[places], n, length)
                places, part = found[t]
                total[places] += w * part
            at = np.flatnonzero(total)
            if len(at) > k:
                at = at[total[at] >= np.partition(total[at], -k)[-k]]
            at = at[np.lexsort((known[at], missing[at], -total[at]))][:k]
            out[0] += [item] * len(at)
            out[1] += [ids[i] for i in at]
            out[2] += total[at].tolist()
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], names=["item", "doc_id", "score"])

    return score


def search(index: Index, items: DataFrame, k: int = 20, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id.

    A null doc_id comes after the others of its score. Items without terms have no rows. Rows that repeat an item_id and its text are one
    item; another text under the same id, or under none, is ranked by itself. An empty table on either side gives no rows.
    """
    spark = items.sparkSession
    names = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text")).filter("text is not null").distinct()
    if index.table is None:
        return names.filter("false").select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    names = spool(names.withColumn("item", F.monotonically_increasing_id()), "items", few=True)
    blocks = max(1, -(-names.count() // ITEMS))
    terms = names.select("item", "text").mapInArrow(_item_terms, "item long, term binary, times long")
    postings = index.table.filter("term is not null")
    kinds = spool(terms.select("term").distinct(), "terms", few=True)
    n_kinds = kinds.count()
    tops = postings.join(_brought(kinds, n_kinds), "term").groupBy("leaf", "term").agg(F.max("top").alias("top"), F.sum("df").alias("df"))
    tops = spool(tops, "tops", few=True)
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2 * F.col("df") + 1))) * F.col("times")
    weighed = tops.groupBy("term").agg(F.sum("df").alias("df")).join(terms, "term").select("item", "term", weight.alias("weight")).filter("weight > 0")
    asked = F.struct("term", "weight")
    requests = weighed.groupBy("item").agg(F.collect_list(asked).alias("asked")).select("item", F.col("asked.term").alias("terms"), F.col("asked.weight").alias("weights"))
    requests = spool(requests.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "requests", few=True)
    bounds = weighed.join(tops, "term").groupBy("item", "leaf").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    bounds = spool(bounds.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "leaf"))), "bounds", few=True)
    own = index.table.filter("term is null")
    part = F.expr("leaf div 64").alias("part")

    best = spark.createDataFrame([], "item long, doc_id long, score long")
    done, upto = 0, 1
    while True:
        least = best.groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        next_ones = bounds.filter((F.col("place") > done) & (F.col("place") <= upto)).join(least, "item", "left")
        visits = spool(next_ones.filter("bound >= coalesce(least, 1)").select("item", "leaf").join(requests, "item"), "visits", few=True)
        if visits.isEmpty():
            break
        # a row for a term and 64 leaves, a bit for each: the terms of every leaf would grow with the leaves
        wanted = visits.select("block", F.explode("terms").alias("term"), "leaf", part).groupBy("block", "term", "part").agg(F.bit_or(F.expr("shiftleft(1L, leaf % 64)")).alias("bits"))
        columns = ["shard", "block", "term", "places", "counts", "ids", "sizes"]
        met = postings.withColumn("part", part).join(_brought(wanted, blocks * n_kinds << max(0, LEVELS[1] - 6)), ["term", "part"]).filter("getbit(bits, leaf % 64) = 1")
        read = met.select(*columns).unionByName(own.join(_brought(visits.select("leaf", "block").distinct(), blocks << LEVELS[1]), "leaf").select(*columns))
        by_shard = visits.join(own.select("leaf", "shard"), "leaf").select(F.col("shard").alias("in_shard"), F.col("block").alias("in_block"), "item", "terms", "weights")
        hits = read.groupBy("shard", "block").cogroup(by_shard.groupBy("in_shard", "in_block")).applyInArrow(_scorer(k, index.n, index.length), "item long, doc_id long, score long")
        best = spool(_ranked(best.unionByName(hits), k).drop("rank"), "best", few=True)
        done, upto = upto, 4 * upto
    return _ranked(best, k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def _brought(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are joined to all postings, `most` at most: broadcast while that is bounded, so that only matching postings are shuffled."""
    return F.broadcast(rows) if most <= ASKED else rows


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
