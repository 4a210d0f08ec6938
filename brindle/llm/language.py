"""Language ID by mixtures: each document is a mixture of languages, whose shares expectation-maximisation finds.

Languages are distributions over hashed byte trigrams, counted over all labelled documents. A document is cut into
units of `UNIT` trigrams; a unit's likelihood under each language is fixed, and the shares of the languages are
fitted to the units. This is done for the sets of the likeliest one, two, ... languages, and the set of the best
likelihood less half a logarithm of the units for each language more is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_bytes, partitions

UNIT, BUCKETS, CHUNKS = 64, 1 << 16, 16
#: A text's shares are fitted when no round moves one of them by more.
SETTLED = 1e-4
#: ASCII letters in lower case, bytes of other code points as they are, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, two spaces around each so that none reaches into the next; how many each text has."""
    spaced = [b"  " + t.translate(_LETTERS) + b"  " for t in texts]
    sizes = np.array([len(s) for s in spaced], np.int64)
    x = np.frombuffer(b"".join(spaced) + b"  ", np.uint8).astype(np.uint32)
    x = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(16), sizes


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of each language, in chunks of buckets."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b in by_bytes(batch.column("text")):
            langs = batch.column("lang").slice(a, b - a).to_pylist()
            ids, sizes = trigrams(batch.column("text").slice(a, b - a).to_pylist())
            ends = np.cumsum(sizes)
            for lang in set(langs):
                own = np.concatenate([ids[e - s : e] for x, s, e in zip(langs, sizes, ends) if x == lang])
                counts[lang] = counts.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
    rows = [(lang, k, part) for lang, c in counts.items() for k, part in enumerate(np.split(c, CHUNKS))]
    yield _chunk_rows(rows)


def _chunk_rows(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    data = [zlib.compress(p.astype("<i8").tobytes(), 1) for _, _, p in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(data, pa.binary())], ["lang", "chunk", "counts"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each (lang, chunk), one at a time."""
    key, total = None, None
    for batch in batches:
        for lang, chunk, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            part = np.frombuffer(zlib.decompress(data), "<i8")
            if key == (lang, chunk):
                total = total + part
                continue
            if key is not None:
                yield _chunk_rows([(*key, total)])
            key, total = (lang, chunk), part
    if key is not None:
        yield _chunk_rows([(*key, total)])


class Model:
    """Languages by name, and the logarithms of their trigrams' chances: a row of languages for each bucket."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        tables = [np.log(counts[k] + 0.5) - np.log(counts[k].sum() + 0.5 * BUCKETS) for k in self.langs]
        self.logs = np.stack(tables, 1).astype(np.float32) if tables else np.zeros((BUCKETS, 0), np.float32)

    def mixtures(self, texts: list[bytes]) -> np.ndarray:
        """The languages' shares in each text, over the set that the penalised likelihood selects."""
        ids, sizes = trigrams(texts)
        units = -(-sizes // UNIT)
        first = np.cumsum(units) - units
        owner = np.repeat(np.arange(len(texts)), units)
        at = np.repeat(np.cumsum(sizes) - sizes, units) + (np.arange(len(owner)) - first[owner]) * UNIT
        logs = np.empty((len(owner), len(self.langs)))
        step = 1 << 13
        for k in range(0, len(owner), step):
            stop = at[k + step] if k + step < len(owner) else len(ids)
            logs[k : k + step] = np.add.reduceat(self.logs[ids[at[k] : stop]], at[k : k + step] - at[k], axis=0, dtype=np.float64)
        top = logs.max(1)
        odds = np.exp(logs - top[:, None])
        start = np.full((len(texts), len(self.langs)), 1 / len(self.langs))
        shares, _ = self._fit(odds, owner, first, units, start)
        rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
        best, most = np.zeros_like(shares), np.full(len(texts), -np.inf)
        for k in range(1, len(self.langs) + 1):
            start = np.where(rank < k, np.maximum(shares, 1e-6), 0)
            fitted, fit = self._fit(odds, owner, first, units, start / start.sum(1, keepdims=True))
            fit = fit - (k - 1) * (0.5 * np.log(units) + 1)
            better = fit > most + 1e-9
            best[better], most[better] = fitted[better], fit[better]
        return best

    @staticmethod
    def _fit(odds: np.ndarray, owner: np.ndarray, first: np.ndarray, units: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation until each text's shares have settled; texts that have are left out of the rounds that follow."""
        out, open_ = shares.copy(), np.arange(len(units))
        own, rows, begin, size, now = owner, odds, first, units, shares
        while len(open_):
            part = now[own] * rows
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            after = np.add.reduceat(part, begin, axis=0) / size[:, None]
            moves = np.abs(after - now).max(1) > SETTLED
            out[open_], now = after, after
            if moves.all():
                continue
            keep = moves[own]
            open_, now, size, rows = open_[moves], now[moves], size[moves], rows[keep]
            own, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        fit = np.log(np.maximum((out[owner] * odds).sum(1), 1e-300))
        return out, np.add.reduceat(fit, first)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, str]]:
        """The language of the largest share, that share, and the mixture: name=share, largest first."""
        out = [("und", 0.0, "")] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        if known:
            shares = self.mixtures([texts[i] for i in known])
            for i, row in zip(known, shares):
                order = [k for k in np.argsort(-row, kind="stable") if row[k] >= 0.0005]
                mixture = ",".join(f"{self.langs[k]}={row[k]:.3f}" for k in order)
                out[i] = (self.langs[order[0]], min(1.0, round(float(row[order[0]]), 6)), mixture)
        return out


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", languages: int = 200) -> Model:
    """Counts all documents with a language that are not held out; null ids, texts and languages teach nothing.

    A language takes 256 KB of the model, which every worker holds. More than `languages` of them are an error, as
    of a column that holds something else; none is left out.
    """
    known = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    if known.select(F.col(lang).cast("string")).distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"{lang} has more than {languages} values: raise `languages` if they are languages")
    parts = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text")).mapInArrow(_count, "lang string, chunk int, counts binary")
    dealt = parts.repartition(partitions(docs.sparkSession), "lang", "chunk").sortWithinPartitions("lang", "chunk")
    counts: dict[str, np.ndarray] = {}
    for r in dealt.mapInArrow(_merge, "lang string, chunk int, counts binary").toLocalIterator():
        size = BUCKETS // CHUNKS
        counts.setdefault(r.lang, np.zeros(BUCKETS, np.int64))[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.counts)), "<i8")
    return Model(counts)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, mixture.

    lang_pred is the language of the largest share, score that share, mixture all shares as name=share, largest first. Null texts and texts without a letter are
    `und` with score 0, as all are if no document taught a language. A null doc_id stays null and is not held out;
    repeated rows get equal results; empty input gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                found = shared.value.predict([t or b"" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))], ["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, mixture string")
