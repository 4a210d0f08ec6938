"""A quality classifier: a byte-level convolutional network, trained and applied in numpy.

Filters of `WIDTH` bytes run over every byte of a text. Their activations are max-pooled over chunks of
two blocks, each chunk overlapping the next by a block; a hidden layer turns a chunk's maxima into a
logit, and the mean of a document's logits into one probability. For a scan, embedding and filters
fold into a table of 256 rows for each filter position, so that a byte costs WIDTH row additions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_bytes

WIDTH, FILTERS, DEPTH, HIDDEN, BLOCK = 6, 24, 8, 16, 512
#: Positions whose activations are held at once.
SPAN = 1 << 14


class Network:
    """weights: embedding e, filters w (width, depth, filters), bias b, hidden h, c, output o, d."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, DEPTH)), "w": r.normal(0, 0.4, (WIDTH, DEPTH, FILTERS)), "b": np.zeros(FILTERS),
            "h": r.normal(0, 0.3, (FILTERS, HIDDEN)), "c": np.zeros(HIDDEN), "o": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.p["e"], self.p["w"]).astype(np.float32)

    def layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, each followed by WIDTH - 1 zeros; first positions of blocks; those zeros' positions; texts' first blocks."""
        gap = bytes(WIDTH - 1)
        sizes = np.array([max(1, len(t)) for t in texts], np.int64)
        flat = np.frombuffer(b"".join((t or b"\0") + gap for t in texts), np.uint8)
        begin = np.cumsum(sizes + WIDTH - 1) - sizes - (WIDTH - 1)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        at = np.repeat(begin, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * BLOCK
        gaps = (np.repeat(begin + sizes, WIDTH - 1) + np.tile(np.arange(WIDTH - 1), len(texts))) if len(texts) else begin
        return flat, at, gaps, first

    def maxima(self, flat: np.ndarray, at: np.ndarray, gaps: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest activation of each filter in each block, and its position if asked for."""
        tables, n = self.tables(), len(flat) - WIDTH + 1
        out = np.empty((len(at), FILTERS), np.float32)
        args = np.empty((len(at), FILTERS), np.int64) if where else None
        ends = np.r_[at[1:], n]
        k = 0
        while k < len(at):
            m = max(k + 1, int(np.searchsorted(ends, at[k] + SPAN, "right")))
            x = flat[at[k] : ends[m - 1] + WIDTH - 1]
            z = tables[0][x[: len(x) - WIDTH + 1]]
            for j in range(1, WIDTH):
                z += tables[j][x[j : len(x) - WIDTH + 1 + j]]
            z[gaps[np.searchsorted(gaps, at[k]) : np.searchsorted(gaps, at[k] + len(z))] - at[k]] = -np.inf
            out[k:m] = np.maximum.reduceat(z, at[k:m] - at[k], axis=0)
            if where:
                for i in range(k, m):
                    args[i] = z[at[i] - at[k] : ends[i] - at[k]].argmax(0) + at[i]
            k = m
        return np.maximum(out + self.p["b"], 0), args

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.p["h"] + self.p["c"], 0)
        return hidden @ self.p["o"] + self.p["d"], hidden

    @staticmethod
    def chunks(first: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk for each block but a text's last, with the next block; a text of one block is a chunk. Also each chunk's text."""
        owner = np.zeros(blocks, np.int64)
        owner[first[1:]] = 1
        owner = np.cumsum(owner)
        last = np.r_[owner[1:] != owner[:-1], True]
        alone = last & np.r_[True, owner[1:] != owner[:-1]]
        left = np.flatnonzero(~last | alone)
        return left, owner[left]

    def score(self, texts: list[bytes]) -> np.ndarray:
        flat, at, gaps, first = self.layout(texts)
        top, _ = self.maxima(flat, at, gaps)
        left, owner = self.chunks(first, len(at))
        right = np.minimum(left + 1, len(at) - 1)
        right = np.where(np.isin(right, first), left, right)
        pooled = np.maximum(top[left], top[right])
        logit, _ = self.head(pooled)
        mean = np.bincount(owner, logit, len(texts)) / np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(mean, -40, 40)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the log loss, both classes of equal weight. Gradients reach the bytes at each maximum only."""
        r = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for s in range(0, len(order), batch):
                own = order[s : s + batch]
                flat, at, gaps, first = self.layout([texts[i] for i in own])
                top, args = self.maxima(flat, at, gaps, where=True)
                left, owner = self.chunks(first, len(at))
                right = np.minimum(left + 1, len(at) - 1)
                right = np.where(np.isin(right, first), left, right)
                take_left = top[left] >= top[right]
                pooled = np.where(take_left, top[left], top[right])
                logit, hidden = self.head(pooled)
                n = np.bincount(owner, minlength=len(own))
                p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, logit, len(own)) / n, -40, 40)))
                d = ((p - labels[own]) * weight[own] / len(own) / n)[owner].astype(np.float32)
                g = {"o": hidden.T @ d, "d": d.sum(keepdims=True)}
                back = np.outer(d, self.p["o"]) * (hidden > 0)
                g["h"], g["c"] = pooled.T @ back, back.sum(0)
                back = (back @ self.p["h"].T) * (pooled > 0)
                g["b"] = back.sum(0)
                place = np.where(take_left, args[left], args[right])
                row, f = np.nonzero(back)
                grad, place = back[row, f], place[row, f]
                g["e"], g["w"] = np.zeros_like(self.p["e"]), np.zeros_like(self.p["w"])
                for j in range(WIDTH):
                    byte = flat[place + j]
                    np.add.at(g["e"], byte, grad[:, None] * self.p["w"][j].T[f])
                    per = np.zeros((FILTERS, DEPTH), np.float32)
                    np.add.at(per, f, grad[:, None] * self.p["e"][byte])
                    g["w"][j] = per.T
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


class Prior:
    """Stands in where the labels show one class or none."""

    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text is 0 modulo folds; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 500, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_bytes: int = 64 << 20) -> Network | Prior:
    """Learns from the `per_class` labelled documents of each class whose ids hash lowest, none of them held out.

    The sample is bounded by both parameters: texts that would take it beyond `most_bytes` in all, in that order, teach
    nothing, so that the driver never holds more. Repeated labels of a document count once, as the largest, and rows that
    repeat an id teach one text, the least by hash. Null labels, ids and texts teach nothing; where they leave one class
    or none, every score is a prior's.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.join(docs.select(F.col(doc_id).cast("long").alias("id")).distinct(), "id", "left_semi")
    sample = {r.id: y for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()}
    if len(set(sample.values())) < 2:
        return Prior((sum(sample.values()) + 1) / (len(sample) + 2))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).filter(F.col("id").isin(list(sample)) & F.col("text").isNotNull())
    sized = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("s"))
    taken: dict[int, int] = {}
    held = 0
    for r in sorted(sized.select("id", "s.h", "s.n", F.xxhash64("id").alias("o")).collect(), key=lambda r: (r.o, r.id)):
        if held + r.n <= most_bytes:
            taken[r.id] = r.h
            held += r.n
    chosen = F.concat_ws(":", "id", F.xxhash64("text")).isin([f"{i}:{h}" for i, h in taken.items()])
    found = sorted((r.id, bytes(r.text)) for r in rows.filter(chosen).dropDuplicates(["id"]).collect())
    kinds = np.array([sample[i] for i, _ in found], np.float32)
    if len(set(kinds.tolist())) < 2:
        return Prior((float(kinds.sum()) + 1) / (len(kinds) + 2))
    net = Network()
    net.train([t for _, t in found], kinds)
    return net


def _scored(batch: pa.RecordBatch, column: str, model: Network | Prior) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for a, b in by_bytes(batch.column(column), 1 << 20):
        part = batch.slice(a, b - a)
        yield part, np.round(model.score([t or b"" for t in part.column(column).to_pylist()]), 6)


def score(docs: DataFrame, model: Network | Prior, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Null texts count as empty, and empty ones are scored like any other. A null doc_id stays null and is
    not held out. Repeated rows get equal scores; empty input gives no rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in _scored(batch, "text", model):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Network | Prior, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns.

    Null texts count as empty; rows that repeat, and rows with a null id, stay or go by their own text. Empty input gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in _scored(batch, "text", model):
                yield pa.RecordBatch.from_arrays(part.columns[1:], part.schema.names[1:]).filter(pa.array(s >= threshold))

    names = docs.columns
    rows = docs.select(F.col(text).cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    return rows.mapInArrow(work, rows.drop("text").schema).toDF(*names)
