"""Secret scans: fixed patterns, and a battery of randomness tests for what has no pattern.

Base spans come from three patterns. The battery looks at the other runs of characters that encodings use.
It infers a run's encoding, and tests its symbols for a uniform alphabet (chi-squared over equal bins of it),
for runs above and below the alphabet's middle, and for serial correlation; Fisher's method combines the three.
A run that looks random may still be ordinary text by chance, the more so the shorter it is: the likelihood of
its changes between letters, capitals, digits and signs in random strings of its encoding, over that in text, is
an e-value against text. The battery's chance p is uniform for random strings, so that the product with 3 p^2, whose
mean is then 1, is an e-value too: what the battery doubts loses weight in proportion. A document's runs pass a
Benjamini-Hochberg step on these e-values, weighted by length. Everything is local to a document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_bytes

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

_HEXES = ("0123456789abcdef", "0123456789ABCDEF")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LOWER36 = "0123456789abcdefghijklmnopqrstuvwxyz"
_UPPER36 = _LOWER36.upper()
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Chance that ordinary text goes on with the same kind of character; the rest is shared by the other kinds.
_STAY = 0.9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in code points: leftmost matches of each, failing ones dropped."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # a run of these two patterns that is too short has no part that is long enough
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def encoding(run: str) -> str | None:
    """The smallest alphabet that a run of mixed characters is from; words and numbers have none."""
    core = run.rstrip("=")
    if core.isalpha() and (core.islower() or core.isupper() or core[1:].islower()) or core.isdigit():
        return None
    chars = set(core)
    for alphabet in (*_HEXES, _BASE32, _LOWER36, _UPPER36):
        if chars <= set(alphabet):
            return alphabet
    return _BASE64 + ("-_" if chars & {"-", "_"} else "+/")


def _chi_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution."""
    if dof % 2 == 0:
        term = total = 1.0
        for k in range(1, dof // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, math.exp(-x / 2) * total)
    total, term = 0.0, math.sqrt(2 * x / math.pi)
    for k in range(1, dof, 2):
        total += term
        term *= x / (k + 2)
    return min(1.0, math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * total)


def randomness(run: str, alphabet: str) -> float:
    """Fisher's combination of the battery: small where the run is not a uniform sequence over the alphabet."""
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in run.rstrip("=") if c in place]
    n, size = len(x), len(alphabet)
    bins = 8
    counts, share = [0] * bins, [0] * bins
    for i in range(size):
        share[i * bins // size] += 1
    for i in x:
        counts[i * bins // size] += 1
    uniform = _chi_tail(sum((c - n * s / size) ** 2 / (n * s / size) for c, s in zip(counts, share)), bins - 1)
    high = [i >= size // 2 for i in x]
    up = sum(high)
    down = n - up
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if up and down:
        mean = 2 * up * down / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        alternating = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 0 else 1.0
    else:
        alternating = 2.0 ** (1 - n)
    middle = sum(x) / n
    power = sum((i - middle) ** 2 for i in x)
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / power if power else 1.0
    correlated = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return _chi_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (uniform, alternating, correlated)), 6)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def against_text(run: str, alphabet: str) -> float:
    """The logarithm of an e-value against ordinary text: how much likelier random strings change kinds of characters as the run does."""
    share = [0.0] * 4
    for c in alphabet:
        share[_kind(c)] += 1 / len(alphabet)
    kinds = [_kind(c) for c in run.rstrip("=")]
    gain = 0.0
    for a, b in zip(kinds, kinds[1:]):
        gain += math.log(max(share[b], 1e-3)) - math.log(_STAY if a == b else (1 - _STAY) / 3)
    return gain


def chance(run: str, alphabet: str, least: float) -> float:
    """A bound on the chance that ordinary text gives such a run; 1 if the battery rejects it at `least`."""
    p = randomness(run, alphabet)
    return math.exp(-max(0.0, against_text(run, alphabet) + math.log(3) + 2 * math.log(p))) if p >= least else 1.0


def _free(text: str, taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Runs that touch no taken span; both ascend."""
    spans = sorted((a, b) for a, _, b in taken)
    k, reach = 0, 0  # of the spans that start before the run's end, the furthest end
    for m in _RUN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            yield m


def random_spans(text: str, taken: list[tuple[int, int, int]], rate: float = 1e-4, least: float = 1e-3) -> list[tuple[int, int, int]]:
    """Runs outside of taken spans that pass the false-discovery step at `rate`."""
    found = [(chance(m[0], alphabet, least), m.start(), m.end()) for m in _free(text, taken) if (alphabet := encoding(m[0]))]
    if not found:
        return []
    mean = sum(b - a for _, a, b in found) / len(found)
    weighed = sorted((p / ((b - a) / mean), a, b) for p, a, b in found)
    passed = [i for i, (p, _, _) in enumerate(weighed, 1) if p <= rate * i / len(weighed)]
    return [(a, 3, b) for _, a, b in weighed[: max(passed, default=0)]]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    column = batch.schema.get_field_index("text")
    for a, b in by_bytes(batch.column(column), 1 << 20):
        part = batch.slice(a, b - a)
        yield part, [None if t is None else t.decode("utf-8", "replace") for t in part.column(column).to_pylist()]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are kind:start:end in code points, by start and kind. Null texts are empty and have none. Repeated rows
    are scanned each, a null doc_id stays null, empty input gives no rows, other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                rows = []
                for t in texts:
                    base = base_spans(t or "")
                    more = random_spans(t or "", base)
                    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with all secrets in text replaced by mark; n_chars, where there is one, follows.

    Null texts stay null, empty ones empty. Every row stays, repeated ones too; empty input gives no rows; other columns are kept.
    """
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                new = [None if t is None else redacted(t, (b := base_spans(t)) + random_spans(t, b), mark) for t in texts]
                yield part.set_column(0, "text", pa.array(new, pa.string()))

    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]
    rows = docs.select(F.col(text).cast("binary").alias("text"), *fields)
    schema = rows.withColumn("text", F.col("text").cast("string")).schema
    out = rows.mapInArrow(work, schema)
    back = {text: F.col("text")} | {c: F.col(f"c{i}") for i, c in enumerate(names) if c != text}
    if n_chars in back:
        kind = docs.schema[n_chars].dataType
        back[n_chars] = F.char_length("text").cast(kind)
    return out.select(*(back[c].alias(c) for c in names))
