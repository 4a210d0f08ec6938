import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import snapshot

SCHEMA = "doc_id long, text string, lang string, source string, n int, side int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def order(x):
    return (x is not None, x)


def sha(row):
    return hashlib.sha256("\n".join("~" if x is None else x for x in row).encode()).hexdigest()


def brute(earlier, later):
    """Copies pair first; what is left of a key pairs in some order, so that only keys of one row on each side have a stated partner."""
    out, gone, fresh = [], [], []
    e, l = Counter(earlier), Counter(later)
    for r in e & l:
        out += [(r[0], r[0], "same", "", sha(r[1:]))] * min(e[r], l[r])
    left = defaultdict(lambda: ([], []))
    for side, rows in enumerate((e - l, l - e)):
        for r, n in rows.items():
            left[r[0]][side].extend([r[1:]] * n)
    for k, (a, b) in left.items():
        assert len(a) <= 1 and len(b) <= 1 or not (a and b), "the pairing is not stated"
        if a and b:
            out.append((k, k, "update", ",".join(n for n, x, y in zip(("text", "lang", "source"), a[0], b[0]) if x != y), sha(b[0])))
        else:
            gone += [(k, *x) for x in a]
            fresh += [(k, *x) for x in b]
    by_text = defaultdict(lambda: ([], []))
    for side, rows in enumerate((gone, fresh)):
        for r in rows:
            by_text[r[1]][side].append(r)
    for a, b in by_text.values():
        a.sort(key=lambda r: order(r[0]))
        b.sort(key=lambda r: order(r[0]))
        for x, y in zip(a, b):
            out.append((y[0], x[0], "rekey", ",".join(n for n, p, q in zip(("text", "lang", "source"), x[1:], y[1:]) if p != q), sha(y[1:])))
        out += [(x[0], x[0], "delete", "", None) for x in a[len(b) :]] + [(y[0], None, "insert", "", sha(y[1:])) for y in b[len(a) :]]
    return sorted(out, key=repr)


def got(spark, earlier, later):
    return sorted(map(tuple, snapshot.difference(frame(spark, earlier), frame(spark, later)).collect()), key=repr)


@pytest.mark.parametrize("cells", [snapshot.FIRST_CELLS, 12])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(snapshot, "FIRST_CELLS", cells)  # 12 cells fail and are enlarged
    monkeypatch.setattr(snapshot, "PARTITION_ROWS", 100)
    rng = random.Random(3)
    texts = ["a", "b", "a\nb", "", None, "same text", "x" * 100_000]
    earlier = [(k, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["s", "t", None])) for k in range(150)]
    later = []
    for k, text, lang, source in earlier:
        kind = rng.randrange(8)
        if kind == 1:
            later.append((k, (text or "") + "+", lang, source))
        elif kind == 2:
            later.append((k, text, source, lang))
        elif kind == 3:
            later.append((-1 - k, text, lang, rng.choice([source, None])))
        elif kind == 4:
            later += [(k, text, lang, source), (-1000 - k, text, lang, source)]
        elif kind != 0:
            later.append((k, text, lang, source))
    # repeated rows, more or fewer of them later, and keys that are null or the least and greatest
    earlier += [(900, "r", "en", "s")] * 5 + [(901, "r", None, None)] * 2 + [(None, "null key", "en", None)] + [(2**63 - 1, "far", "en", "s"), (-(2**63), "far", "en", "s")]
    later += [(900, "r", "en", "s")] * 3 + [(901, "r", None, None)] * 4 + [(None, "null key", "en", "s")] + [(2**63 - 1, "far+", "en", "s"), (7000, "far", "en", "s")]
    assert got(spark, earlier, later) == brute(earlier, later)


def test_rows_that_share_a_key_pair_one_to_one(spark):
    earlier = [(1, f"e{i}", "en", "s") for i in range(4)] + [(1, "kept", "en", "s")]
    later = [(1, "kept", "en", "s")] + [(1, f"l{i}", "en", "s") for i in range(6)]
    rows = snapshot.difference(frame(spark, earlier), frame(spark, later)).collect()
    assert Counter(r.op for r in rows) == {"same": 1, "update": 4, "insert": 2}
    assert sorted(r.row_sha256 for r in rows) == sorted(sha(r[1:]) for r in later)


def test_a_hot_key_and_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "PARTITION_ROWS", 200)
    monkeypatch.setattr(snapshot, "_RANGE_ROWS", 100)
    earlier = [(k, "hot", "en", "s") for k in range(1000)] + [(5000, f"t{i}", "en", "s") for i in range(400)]
    later = [(-1 - k, "hot", "en", None if k % 2 else "s") for k in range(990)] + [(5000, f"t{i}", "en", "s") for i in range(400)]
    assert got(spark, earlier, later) == brute(earlier, later)


def test_empty_tables(spark):
    rows = [(1, "a", "en", "s"), (2, None, None, None)]
    assert got(spark, [], []) == []
    assert [r[2] for r in got(spark, rows, [])] == ["delete"] * 2 and {r[2] for r in got(spark, [], rows)} == {"insert"}
    assert {r[2] for r in got(spark, rows, rows)} == {"same"}


def test_a_table_that_is_too_small_says_so_and_a_large_one_gives_all():
    rng = np.random.default_rng(1)
    m = 64
    entries = {c: rng.integers(0, 1 << 32, 60) for c in ("k_hi", "k_lo", "a_hi", "a_lo", "b_hi", "b_lo")} | {"z": np.zeros(60, np.int64)}
    entries["c1"], entries["c2"] = snapshot._checks(*(entries[c] for c in ("a_hi", "a_lo", "b_hi", "b_lo", "k_lo")))
    times = rng.choice([1, -1, 3, -2], 60)
    for size, want in ((m, True), (8, False)):
        at = [entries["a_lo"] % size, entries["a_hi"] % size + size, entries["b_lo"] % size + 2 * size]
        n, sums = np.zeros(3 * size, np.int64), {c: np.zeros(3 * size, np.int64) for c in snapshot._SUMS}
        for place in at:
            np.add.at(n, place, times)
            for c in snapshot._SUMS:
                np.add.at(sums[c], place, times * entries[c])
        ok, found = snapshot._peel(np.arange(3 * size), n, sums, size)
        assert ok == want
        if ok:
            assert sorted(zip(found["a_lo"], found["k_hi"], found["n"])) == sorted(zip(entries["a_lo"], entries["k_hi"], times))


def test_the_stated_snapshot(spark):
    docs = [(k, None if k == 3 else f"t{k}", "en", "s") for k in range(200)] + [(None, "no id", "en", "s")]
    want = []
    for k, text, lang, source in docs:
        m = -1 if k is None else zlib.crc32(str(k).encode()) % 16
        if m == 0:
            continue
        want.append((k if m not in (3, 4) else -1 - k, (text or "") + "+" if m == 1 else text, source if m == 2 else lang, lang if m == 2 else None if m == 4 else source))
        if m == 5:
            want.append((-1 - k, text, lang, source))
    later = snapshot.stated_later(frame(spark, docs))
    assert sorted(map(tuple, later.collect()), key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got(spark, docs, want)} == {"same", "update", "rekey", "insert", "delete"}
    assert snapshot.difference(frame(spark, docs), later).filter(F.col("op") == "same").count() == sum(r in set(docs) for r in want)
