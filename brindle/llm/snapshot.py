"""The difference of two snapshots of a table, with rows that changed their key, by invertible Bloom lookup tables.

Every row is an entry: its key and a 128-bit digest of key and columns. Entries are dealt by their digest to partitions whose number
follows the tables' sizes, so that a hot key is spread too. A partition's table has three ranges of cells; an entry is added to one cell of each, the earlier snapshot's with a
plus and the later one's with a minus, as sums of the entry's parts and of checks on them. These sums are merged as any aggregate
is: what both snapshots hold cancels out, and no row meets its partner for it. A cell that holds copies of a single entry tells it;
taken out of its other cells, it lays bare more. Where cells are left, the table was too small: those partitions are sketched
again with four times the cells. The entries found are the rows that differ, with how often.

Then rows are compared exactly, by the SHA-256 of each column: those found pair within their key, and what is left over pairs by the
content rank, the i-th smallest earlier key of a text with the i-th smallest later one. Ranks are running counts by prefix scan, so that
neither a key nor a text is numbered by one task. Columns leave the scan as digests; nothing that grows with the tables is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import partitions, spool
from brindle.operators.scan import running

#: Rows of both snapshots in a partition, on average, and the cells that its table starts with.
PARTITION_ROWS = 1 << 16
FIRST_CELLS = 3 << 12
#: Rows in a range of a scan.
_RANGE_ROWS = 20_000
_PRIME = (1 << 31) - 1
_SUMS = ["z", "k_hi", "k_lo", "a_hi", "a_lo", "b_hi", "b_lo", "c1", "c2"]
_PEELED = "p long, ok boolean, key long, a long, b long, n long"


def _slim(df: DataFrame, key: str, columns: list[str], side: int) -> DataFrame:
    """(side, key, a, b, d0.., row): digests of the columns, of the entry (a, b), and of the whole row."""
    values = [F.col(c).cast("string") for c in columns]
    row = F.concat_ws("\n", *(F.coalesce(v, F.lit("~")) for v in values))
    out = df.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("key"), *(F.unhex(F.sha2(v, 256)).alias(f"d{i}") for i, v in enumerate(values)), F.unhex(F.sha2(row, 256)).alias("row"))
    # a null does not change xxhash64, so that it is told by a mark
    told = [x for i in range(len(columns)) for x in (F.col(f"d{i}").isNull(), F.col(f"d{i}"))]
    return out.withColumns({h: F.xxhash64(F.lit(seed), F.col("key").isNull(), "key", *told) for h, seed in (("a", 1), ("b", 2))})


def _checks(a_hi, a_lo, b_hi, b_lo, k_lo):
    """Two numbers below 2^31 that no mixture of entries gives but by chance; of columns or of arrays."""
    low = lambda x: x % (1 << 31)
    return (low(a_lo) * low(b_lo) + low(k_lo)) % _PRIME, (low(a_hi) * low(b_hi) + low(b_lo)) % _PRIME


def _cells(entries: DataFrame, m: int) -> DataFrame:
    """(p, cell, n, sums): the partitions' tables of three times m cells. Halves of 32 bits, so that no sum overflows."""
    high = lambda c: F.shiftrightunsigned(c, 32)
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    parts = entries.select("p", F.col("side").cast("long").alias("n"), F.col("key").isNull().cast("long").alias("z"), F.coalesce("key", F.lit(0)).alias("key"), "a", "b")
    parts = parts.select("p", "n", "z", high("key").alias("k_hi"), low("key").alias("k_lo"), high("a").alias("a_hi"), low("a").alias("a_lo"), high("b").alias("b_hi"), low("b").alias("b_lo"))
    c1, c2 = _checks(*(F.col(c) for c in ("a_hi", "a_lo", "b_hi", "b_lo", "k_lo")))
    places = F.array(F.col("a_lo") % m, F.col("a_hi") % m + m, F.col("b_lo") % m + 2 * m)
    spread = parts.withColumns({"c1": c1, "c2": c2}).withColumn("cell", F.explode(places))
    return spread.groupBy("p", "cell").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in _SUMS))


def _peel(cell: np.ndarray, n: np.ndarray, sums: dict[str, np.ndarray], m: int) -> tuple[bool, dict[str, np.ndarray]]:
    """Whether a table gave all of its entries, and these with how often (n, below 0 for the later snapshot's)."""
    count = np.zeros(3 * m, np.int64)
    count[cell] = n
    table = {c: np.zeros(3 * m, np.int64) for c in _SUMS}
    for c in _SUMS:
        table[c][cell] = sums[c]
    found: list[dict[str, np.ndarray]] = []
    look = np.unique(cell)
    while len(look):
        look = look[count[look] != 0]
        own = count[look]
        whole = np.ones(len(look), bool)
        v = {}
        for c in _SUMS:
            v[c], rest = np.divmod(table[c][look], own)
            whole &= (rest == 0) & (v[c] >= 0) & (v[c] < 1 << 32)
        look, own, v = look[whole], own[whole], {c: x[whole] for c, x in v.items()}
        c1, c2 = _checks(v["a_hi"], v["a_lo"], v["b_hi"], v["b_lo"], v["k_lo"])
        place = np.stack([v["a_lo"] % m, v["a_hi"] % m + m, v["b_lo"] % m + 2 * m])
        pure = (c1 == v["c1"]) & (c2 == v["c2"]) & (place == look).any(0)
        own, place, v = own[pure], place[:, pure], {c: x[pure] for c, x in v.items()}
        # an entry that is alone in several cells comes once
        _, first = np.unique(np.stack([v[c] for c in _SUMS], 1), axis=0, return_index=True) if len(own) else (None, np.zeros(0, np.int64))
        own, place, v = own[first], place[:, first], {c: x[first] for c, x in v.items()}
        for at in place:
            np.subtract.at(count, at, own)
            for c in _SUMS:
                np.subtract.at(table[c], at, own * v[c])
        found.append(v | {"n": own})
        look = np.unique(place)
    empty = not count.any() and not any(x.any() for x in table.values())
    return empty, {c: np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in (*_SUMS, "n")}


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)).view(np.int64)


def _decoder(m: int):
    def decode(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("cell", "n", *_SUMS)}
        ok, out = _peel(column.pop("cell"), column.pop("n"), column, m)
        at = table.column("p")[0].as_py()
        if not ok or not len(out["n"]):
            rows = [[at], [ok], [None], [None], [None], [None]]
        else:
            key = pa.array(_joined(out["k_hi"], out["k_lo"]), mask=out["z"] > 0)
            rows = [[at] * len(key), [True] * len(key), key, _joined(out["a_hi"], out["a_lo"]), _joined(out["b_hi"], out["b_lo"]), out["n"]]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, kinds)], names=["p", "ok", "key", "a", "b", "n"])

    return decode


def _differing(rows: DataFrame) -> DataFrame:
    """(key, a, b, n): the entries by which the snapshots differ; n > 0 copies more in the earlier one, or -n in the later."""
    p = max(1, -(-rows.count() // PARTITION_ROWS))
    entries = rows.select("side", "key", "a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(p)).alias("p"))
    m, found = FIRST_CELLS // 3, None
    while True:
        # cells that cancelled out are in no entry
        left = _cells(entries, m).filter(" or ".join(f"{c} != 0" for c in ("n", *_SUMS)))
        peeled = spool(left.groupBy("p").applyInArrow(_decoder(m), _PEELED), "peeled", few=True)
        done = peeled.filter("ok and n is not null").select("key", "a", "b", "n")
        found = done if found is None else found.unionByName(done)
        failed = peeled.filter("not ok").select(F.col("p").alias("again"))
        if failed.isEmpty():
            return found
        entries = entries.join(failed, F.col("p") == F.col("again"), "left_semi")
        m *= 4


def _numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    ranges = min(partitions(rows.sparkSession), max(1, rows.count() // _RANGE_ROWS))
    return running(rows, by, order, {name: ("count", F.lit(1))}, ranges)


def _paired(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """One row for each of `by`: the structs e and l, null where only one side has it. Two rows of a key meet, never more."""
    of = lambda side, name: F.first(F.when(F.col("side") == side, F.struct(*keep)), ignorenulls=True).alias(name)
    return rows.groupBy(*by).agg(of(1, "e"), of(-1, "l"))


def _changed(columns: list[str]) -> Column:
    return F.concat_ws(",", *(F.when(~F.col(f"e.d{i}").eqNullSafe(F.col(f"l.d{i}")), F.lit(c)) for i, c in enumerate(columns)))


def difference(earlier: DataFrame, later: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("text", "lang", "source")) -> DataFrame:
    """One row per pair of rows or unpaired row: key (later, else earlier), old_key (earlier, else null), op, changed, row_sha256.

    Equal keys pair: op `same`, or `update` with the names of the columns that differ, comma-joined in the given order. Among the rows
    without a partner, those with equal first columns pair by the rank of their key: `rekey`. The others are `insert` and `delete`.
    row_sha256 is of the later row's columns joined by line feeds, null as `~`; null for a delete. Columns are
    compared as strings, by their SHA-256.

    Nulls equal nulls alone, in keys as in columns; a null key is the smallest. Rows that share a key: those with equal columns
    pair first, the rest in the order of a hash of their columns. Repeated rows are rows each. Where a table is
    empty, all rows of the other are inserts or deletes. Further columns are ignored, whatever their names.
    """
    columns = list(columns)
    digests = [f"d{i}" for i in range(len(columns))]
    rows = spool(_slim(earlier, key, columns, 1).unionByName(_slim(later, key, columns, -1)), "snapshots")
    found = _differing(rows).select(F.col("key").alias("f_key"), F.col("a").alias("f_a"), F.col("b").alias("f_b"), "n")
    met = rows.join(found, F.col("key").eqNullSafe(F.col("f_key")) & (F.col("a") == F.col("f_a")) & (F.col("b") == F.col("f_b")), "left")
    met = spool(met.select(*rows.columns, "n"), "met")
    # of copies of one row, as many differ as were found
    copies = spool(_numbered(met.filter("n is not null"), ["side", "key", "a", "b"], [], "copy"), "copies")
    same = met.filter("n is null and side = -1").select("key", "row").unionByName(copies.filter("side = -1 and copy > -n").select("key", "row"))
    differ = copies.filter("copy <= side * n")
    keyed = _paired(_numbered(differ, ["key", "side"], ["a", "b"], "i"), ["key", "i"], [*digests, "row"])
    keyed = spool(keyed, "keyed")
    alone = keyed.filter("e is null or l is null").select(F.when(F.col("l").isNull(), 1).otherwise(-1).alias("side"), "key", F.coalesce("e", "l").alias("r")).select("side", "key", "r.*")
    alone = _paired(_numbered(alone, ["d0", "side"], ["key"], "i"), ["d0", "i"], ["key", *digests, "row"])
    hexed = lambda c: F.lower(F.hex(c)).alias("row_sha256")
    both = F.col("e").isNotNull() & F.col("l").isNotNull()
    op = F.when(both, "rekey").when(F.col("e").isNull(), "insert").otherwise("delete").alias("op")
    blank = F.lit("")
    return (
        same.select("key", F.col("key").alias("old_key"), F.lit("same").alias("op"), blank.alias("changed"), hexed("row"))
        .unionByName(keyed.filter(both).select("key", F.col("key").alias("old_key"), F.lit("update").alias("op"), _changed(columns).alias("changed"), hexed("l.row")))
        .unionByName(alone.select(F.when(F.col("l").isNull(), F.col("e.key")).otherwise(F.col("l.key")).alias("key"), F.col("e.key").alias("old_key"), op, F.when(both, _changed(columns)).otherwise(blank).alias("changed"), hexed("l.row")))
    )


def stated_later(docs: DataFrame) -> DataFrame:
    """The later snapshot that the contract states: rows change by crc32 of the decimal doc_id modulo 16. A null id changes nothing."""
    m = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 16, F.lit(-1))
    rows = docs.select("doc_id", "text", "lang", "source", m.alias("m")).filter("m != 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("m") == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    swapped = F.col("m") == 2
    return rows.select(
        F.when(F.col("copy") | F.col("m").isin(3, 4), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("m") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swapped, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(swapped, F.col("lang")).when(F.col("m") == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )
