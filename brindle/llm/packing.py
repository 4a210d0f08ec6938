"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths reaches the driver: at most `capacity` numbers at any scale. Over
it a configuration linear program (few bins whose patterns cover every length's count) is solved by
multiplicative weights, where a knapsack over the capacity prices the next pattern; the solution is
rounded down and what it leaves is packed best fit, whole patterns at a time. Pieces then find their
place by their rank among the pieces of their length, which is counted in blocks, so that no length,
however common, is numbered by one task.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import by_bytes, spool

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"
_DEAL = ", deal int"


class Tokenizer:
    """Ids of a byte-level BPE. The rank file holds the same merges as the JSON file and is several times as fast;
    texts with the string of a special token, which only the JSON file knows, go to the latter."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        import tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = tokenizers.Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_LOADED: dict[tuple, Tokenizer] = {}


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, files: tuple[str, str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal): each document's ids and end_id, cut where longer than capacity.

    The first piece takes what the others, which are full, leave over. deal is the piece's number in its task: with it, pieces
    that are equal in all else can be dealt apart.
    """
    files = files or default_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if files not in _LOADED:
            _LOADED[files] = Tokenizer(*files)
        encode = _LOADED[files]
        dealt = 0
        for batch in batches:
            for a, b in by_bytes(batch.column(1)):
                rows: list[list[int]] = [[], [], [], [], []]
                owner = batch.column(0).slice(a, b - a).to_pylist()
                for name, raw in zip(owner, batch.column(1).slice(a, b - a).to_pylist()):
                    ids = np.array([*encode((raw or b"").decode("utf-8", "replace")), end_id], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(rows, (name, k, s, e - s, zlib.crc32(ids[s:e].tobytes()))):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                rows.append(list(range(dealt, dealt + len(rows[0]))))
                dealt += len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(work, _PIECES + _DEAL)


def _price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern of most worth that fits: an unbounded knapsack by dynamic programming. lengths ascend."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = best[c - lengths[:k]] + worth[:k]
            at = int(gain.argmax())
            if gain[at] > best[c]:
                best[c], took[c] = gain[at], at
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            n = int(lengths[took[c]])
            pattern[n] = pattern.get(n, 0) + 1
            c -= n
    return pattern


def _tight(left: np.ndarray, capacity: int) -> dict[int, int]:
    """Best fit on the counts left: the longest piece, and what fills the rest of its sequence, long pieces first."""
    taken = left.copy()
    lengths = np.flatnonzero(taken)
    longest = int(lengths[-1])
    pattern, room = {longest: 1}, capacity - longest
    taken[longest] -= 1
    lengths = np.flatnonzero(taken[: room + 1])
    if len(lengths):
        fill = _price(lengths, lengths * (1 + lengths / capacity), room)
        if sum(n * k for n, k in fill.items()) == room and all(k <= taken[n] for n, k in fill.items()):
            for n, k in fill.items():
                pattern[n] = pattern.get(n, 0) + k
            return pattern
    while len(lengths := np.flatnonzero(taken[: room + 1])):
        n = int(lengths[-1])
        k = min(int(taken[n]), room // n)
        pattern[n] = pattern.get(n, 0) + k
        taken[n] -= k
        room -= k * n
    return pattern


def relax(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int, rate: float = 1.0) -> tuple[dict[tuple, float], np.ndarray, float]:
    """The configuration program by multiplicative weights: amounts of patterns, how far they cover each length, a lower bound.

    A round prices the lengths by the weight of what is still uncovered and takes the best pattern, as much as covers
    one of its lengths. The prices over the best pattern's worth are feasible for the dual: they bound the bins from below.
    """
    at = {int(n): i for i, n in enumerate(lengths)}
    weight, cover, bound = np.ones(len(lengths)), np.zeros(len(lengths)), 0.0
    chosen: dict[tuple, float] = {}
    for _ in range(rounds):
        price = weight / need
        key = tuple(sorted(_price(lengths, price + 1e-9 * price.max() * lengths / capacity, capacity).items()))
        own = np.array([at[n] for n, _ in key])
        many = np.array([k for _, k in key])
        bound = max(bound, weight.sum() / float((price[own] * many).sum() * (1 + 1e-6) + 1e-9 * price.max()))
        gain = many / need[own]
        step = 1 / gain.max()
        chosen[key] = chosen.get(key, 0.0) + step
        cover[own] += gain * step
        weight[own] *= np.exp(-rate * gain * step)
        weight /= weight.max()
    return chosen, cover, bound


def _rounded(histogram: dict[int, int], capacity: int, amounts: list[tuple[tuple, float]]) -> list[tuple[dict[int, int], int]]:
    """Whole patterns of the amounts, largest first, as far as pieces are left; best fit for the rest."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    plan: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min(times, *(int(left[n]) // k for n, k in pattern.items()))
        if times > 0:
            plan.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times

    for key, x in amounts:
        use(dict(key), int(x))
    while left.any():
        use(_tight(left, capacity), int(left.sum()))
    return plan


def solve(histogram: dict[int, int], capacity: int, rounds: int = 200) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): patterns {length: pieces} within capacity that use every piece once.

    The relaxed solution is rounded down in full and in part, and the plan of fewest sequences is taken; a plan as
    small as the pieces' total length allows ends the search.
    """
    lengths = np.array(sorted(n for n in histogram if n < capacity))
    amounts: list[tuple[tuple, float]] = []
    if len(lengths):
        chosen, cover, _ = relax(lengths, np.array([histogram[int(n)] for n in lengths], float), capacity, rounds)
        at = {int(n): i for i, n in enumerate(lengths)}
        for key, x in chosen.items():
            if sum(n * k for n, k in key) == capacity:
                amounts.append((key, x / max(1.0, *(cover[at[n]] for n, _ in key))))
        amounts.sort(key=lambda p: (-p[1], p[0]))
    full = [(((capacity, 1),), histogram[capacity])] if capacity in histogram else []
    least = -(-sum(n * k for n, k in histogram.items()) // capacity)
    best: list[tuple[dict[int, int], int]] | None = None
    for share in (1.0, 0.6, 0.0):
        plan = _rounded(histogram, capacity, full + [(key, x * share) for key, x in amounts])
        if best is None or sum(t for _, t in plan) < sum(t for _, t in best):
            best = plan
        if sum(t for _, t in best) <= least:
            break
    return best


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, pieces in a sequence, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n, k in pattern.items():
            rows.setdefault(n, []).append((ranks.get(n, 0), sequence, k, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, files: tuple[str, str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of end_id alone. Documents that repeat a doc_id are packed each;
    a null doc_id stays null. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = spool(tokenized_pieces(docs, capacity, end_id, files, text, doc_id), "pieces", few=True)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(solve(histogram, capacity)))
    # blocks of a length: a rare one is a single block, so that there are few more blocks than lengths
    blocks = F.array(*(F.lit(max(1, -(-histogram.get(n, 0) // 1_000))) for n in range(capacity + 1)))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), F.get(blocks, F.col("length").cast("int"))))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32", "deal")
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(counts, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, firsts = np.unique(length[order], return_index=True)
            for n, a, b in zip(kinds, firsts, [*firsts[1:], len(order)]):
                rows, own = table[int(n)], order[a:b]
                first, seq, k, off = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                j = rank[own] - first
                sequence[own], offset[own] = seq + j // k, off + (j % k) * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(work, _PACKED)
