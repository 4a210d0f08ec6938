"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words, each weighted by its count. For each of `SAMPLES` hash functions and each word of
weight w a hash gives r and c from Gamma(2, 1) and b from U(0, 1); with t = floor(ln w / r + b), the word's value
is a = c exp(-r (t - b + 1)), and the word and t of the least value are the sample. Two documents draw the same
sample with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima of weights.

Gamma(2, 1) is the sum of two exponentials, and b may be the share of one of them in r: with uniform u, v, p, q,
c = -ln(u v), r = -ln(p q) and r b = -ln q. Then exp(-r (1 - b)) is p, so that a = c p exp(-r t), and a word that
occurs once, whose t is 0, takes a single logarithm.

The value and sixteen bits of (word, t) share a long, so that a sample is a plain `min`. Documents are laid out in
blocks of consecutive ids, each with the document that follows it as a guest: the next text, the fingerprints of
all versions and the next fingerprint need one shuffle of the texts together.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Hash functions evaluated in one row.
GROUP = 16
#: Rows in a block of ids, about.
BLOCK_ROWS = 2000
#: Blocks at most: what the driver holds of them is a split, a head and a place in the order of each. Beyond, blocks
#: have more rows, which one task sorts, spilling, as with the range partitions of a sort.
BLOCKS = 1 << 16
#: Blocks of one id at most.
HOT_PARTS = 1024
#: Values are below 2 ln 2**33 and kept in steps of 2**-41.
_SCALE = 2.0**41
_LEAST = -(1 << 63)


def _weighted(rows: DataFrame, text: str) -> DataFrame:
    """A row for each distinct word of each row: word (its hash) and weight; one of nulls for a text without words."""
    keep = [c for c in rows.columns if c != text]
    # white space at the ends leaves empty words, whose hash is left out
    hashes = F.sort_array(F.transform(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    rows = rows.select(*keep, hashes.alias("_w"))
    first = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.when(i == 0, True).otherwise(F.get("_w", i) != F.get("_w", i - 1)))
    rows = rows.select(*keep, "_w", first.alias("_f"))
    ends = F.transform("_f", lambda p, i: F.struct(F.get("_w", p).alias("word"), (F.coalesce(F.get("_f", i + 1), F.size("_w")) - p).alias("weight")))
    return rows.select(*keep, F.inline_outer(F.filter(ends, lambda x: x["word"] != F.xxhash64(F.lit("")))))


def _constants(n: int, seed: int) -> list[int]:
    """n fixed longs: the finalised multiples of an odd number."""
    out = []
    for i in range(1, n + 1):
        x = (i + (seed << 20)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out.append((x ^ x >> 31) >> 1)
    return out


def _uniform(bits: Column) -> Column:
    """32 bits as one of the middles of as many parts of 0 to 1."""
    return (bits + F.lit(0.5)) * F.lit(2.0**-32)


def gamma(u: Column, v: Column) -> Column:
    """Gamma(2, 1) of two uniforms."""
    return -F.ln(u * v)


def _codes() -> list[Column]:
    """For each hash function of a group the least of value << 16 | sample over the rows (salted, weight)."""
    out = []
    for k, constant in enumerate(_constants(GROUP, 1)):
        first = F.xxhash64(F.col("salted").bitwiseXOR(F.lit(constant)))
        second = F.xxhash64(first)
        low = F.lit((1 << 32) - 1)
        c = gamma(_uniform(F.shiftrightunsigned(first, 32)), _uniform(first.bitwiseAND(low)))
        p, q = _uniform(F.shiftrightunsigned(second, 32)), _uniform(second.bitwiseAND(low))
        name = first.bitwiseAND(F.lit(0xFFFF))

        def code(value: Column, sample: Column) -> Column:
            return F.shiftleft(F.floor(value * F.lit(_SCALE)), 16).bitwiseOR(sample)

        r = gamma(p, q)
        t = F.floor((F.ln("weight") - F.ln(q)) / r)
        more = code(c * p * F.exp(-r * t), name.bitwiseXOR(t.bitwiseAND(F.lit(0xFFFF))))
        out.append(F.min(F.when(F.col("weight") == 1, code(c * p, name)).when(F.col("weight") > 1, more)).alias(f"s{k}"))
    return out


def signatures(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and sig, 4 hex digits for each sample, of each group of keys; a group is one text.

    The hash functions are taken GROUP at a time, each group over rows of its own: beyond that many in one
    aggregation the generated code is too long for the compiler.
    """
    words = _weighted(rows.select(*keys, text), text)
    salts = _constants(SAMPLES // GROUP, 2)
    words = words.select(*keys, "word", "weight", F.explode(F.array(*(F.lit(x) for x in salts))).alias("salt"))
    salted = words.select(*keys, "salt", F.col("word").bitwiseXOR(F.col("salt")).alias("salted"), "weight")
    mins = salted.groupBy(*keys, "salt").agg(*_codes())
    parts = [F.lpad(F.lower(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(GROUP)]
    found = mins.select(*keys, "salt", F.coalesce(F.concat(*parts), F.lit("f" * 4 * GROUP)).alias("part"))
    return found.groupBy(*keys).agg(F.concat(*(F.max(F.when(F.col("salt") == x, F.col("part"))) for x in salts)).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two signatures have in common."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.substr(a, k * 4 + 1, F.lit(4)) == F.substr(b, k * 4 + 1, F.lit(4)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.lit(float(SAMPLES)))


def _block_of(splits: list[tuple[int, int]]) -> Column:
    """How many of the ascending splits are at most (o, q), by binary search."""
    if not splits:
        return F.lit(0)
    first, second = (F.lit(np.array(x, np.int64)) for x in zip(*splits))
    steps = F.lit(np.array([1 << k for k in reversed(range(len(splits).bit_length()))], np.int32))

    def reached(at: Column) -> Column:
        o, q = F.get(first, at), F.get(second, at)
        return F.coalesce((o < F.col("o")) | (o == F.col("o")) & (q <= F.col("q")), F.lit(False))

    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step - 1), at + step).otherwise(at))


def _placed(docs: DataFrame) -> DataFrame:
    """docs(o, text) with q and block: ranges of (o, q) of about BLOCK_ROWS rows, the first in order being the last block.

    q is 0 but for an id that holds several quantiles of the rows: there it falls as the text's first seven bytes rise, so that
    such an id has blocks of its own.
    """
    blocks = max(1, min(BLOCKS, docs.count() // BLOCK_ROWS))
    cuts = np.arange(1, blocks) / blocks
    quantiles = docs.agg(F.percentile_approx("o", F.lit(cuts), 10 * blocks).alias("s")).first().s if len(cuts) else None
    times = Counter(quantiles or [])
    hot = sorted(o for o, n in times.items() if n > 1)
    head = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    docs = docs.withColumn("q", F.when(F.col("o").isin(hot), F.lit(1 << 56) - head).otherwise(F.lit(0)) if hot else F.lit(0).cast("long"))
    splits = {(o, 0) for o in times}
    if hot:
        parts = F.lit(np.arange(1, HOT_PARTS) / HOT_PARTS)
        for r in docs.filter(F.col("o").isin(hot)).groupBy("o").agg(F.percentile_approx("q", parts, 10 * HOT_PARTS).alias("s")).collect():
            wanted = min(times[r.o] + 1, HOT_PARTS)
            splits |= {(r.o, r.s[k * HOT_PARTS // wanted - 1]) for k in range(1, wanted)}
    return docs.withColumn("block", _block_of(sorted(splits)).cast("int"))


def _guests(docs: DataFrame) -> DataFrame:
    """(block, o, text): for each block of docs(block, o, q, text) the first document of the one it is followed by; the last is followed by the first."""
    heads = docs.groupBy("block").agg(F.max(F.struct("o", "q")).alias("head"))
    order = Window.orderBy(F.desc("head"))  # BLOCKS rows at most
    last = F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = heads.select(F.col("head.o").alias("head_o"), F.col("head.q").alias("head_q"), F.coalesce(F.lag("block").over(order), last).alias("before"))
    firsts = docs.select("o", "q", "text").join(F.broadcast(follow), (F.col("o") == F.col("head_o")) & (F.col("q") == F.col("head_q")))
    return firsts.groupBy("before", "o").agg(F.min("text").alias("text")).select(F.col("before").alias("block"), "o", "text")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next smaller id, after the last one the first. Rows that share an id follow
    each other by text; a null id comes last. A single document is its own next. Null texts are empty; texts without
    words share a fingerprint of their own. Empty input gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("o", F.coalesce("doc_id", F.lit(_LEAST)))
    docs = _placed(docs)
    guests = _guests(docs).select("block", F.lit(1).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "o", "text")
    every = docs.select("block", F.lit(0).alias("guest"), "doc_id", "o", "text").unionByName(guests)

    order = Window.partitionBy("block").orderBy("guest", F.desc("o"), "text")
    rows = every.select("block", "guest", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("after"))
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.when(F.col("guest") == 0, F.concat(F.left(F.col("text"), size - cut), F.left(F.coalesce("after", F.lit("")), cut)))
    rows = rows.select("block", "guest", "rn", "doc_id", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    both = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("own"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("own"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha")),
    )
    versions = rows.select("block", "guest", "rn", "doc_id", "n_chars", F.inline(both)).filter((F.col("guest") == 0) | (F.col("version") == 0))
    keys = ["block", "rn", "version", "guest", "doc_id", "n_chars", "sha"]
    prints = signatures(versions, keys, "own")

    by_row = Window.partitionBy("block").orderBy("rn", "version")
    met = prints.select(*keys, "sig", F.lead("sha").over(by_row).alias("edited_sha256"), F.lead("sig").over(by_row).alias("edited_sig"), F.lead("sig", 2).over(by_row).alias("next_sig"))
    return met.filter("version = 0 and guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", F.col("sig").alias("fingerprint"), F.col("edited_sig").alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
