import hashlib
import random
from functools import partial

import numpy as np
import pytest

from brindle.llm import substring
from brindle.llm.substring import gaps_decoded, gaps_encoded, windows, without_repeats

SCHEMA = "doc_id long, text string, hash string, kind int"


def brute(rows, size):
    place = lambda d: (d is None, d or 0)
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, ((True, 1 << 62), 0)), (place(d), i))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (place(d), i):
                gone |= set(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    v = [f"w{i}é" for i in range(300)]
    shared = [rng.choices(v, k=12) for _ in range(5)]
    rows = []
    for d in range(120):
        words = rng.choices(v, k=rng.randint(0, 60))
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = s if rng.random() < 0.7 else s[:7]
        rows.append((d * 7 % 120, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    rows += [(600, "again and " * 50), (601, None), (602, ""), (603, "few words")]
    rows += [(700, rows[5][1] + " x"), (700, rows[5][1] + " x"), (700, "other text of this id " + " ".join(shared[0])), (None, " ".join(shared[1] * 2)), (None, rows[8][1])]
    return rows


@pytest.mark.parametrize(("cells", "held"), [(28, 4 << 20), (9, 4 << 20), (20, 40)])
def test_against_brute_force(spark, monkeypatch, cells, held):
    monkeypatch.setattr(substring, "HELD", held)
    monkeypatch.setattr(substring, "GRAM", 3)
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    got = without_repeats(frame, 5, cells).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 5)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_sketch_flags_every_repeat_and_few_others(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("cast(text as binary) as text").repartition(3)
    h1, _, _, _, key, _ = windows([t and t.encode() for _, t in rows], 5, 3)
    hashes, at, counts = np.unique(h1, return_index=True, return_counts=True)
    grams = np.unique(key[at][counts == 1]).size
    assert grams > 100
    for bits_log2, most in ((22, 0.2), (12, 1.0)):
        bits = substring.repeated_cells(frame, partial(substring.window_keys, size=5, gram=3), bits_log2)
        flagged = substring.flagged_cells(key[at], bits, bits_log2)
        assert flagged[counts > 1].all()
        assert flagged[counts == 1].mean() <= most


def test_equal_windows_at_different_places_count_twice():
    """Also in texts that repeat themselves, where neighbours share a key."""
    for text in (b"a " * 40, b"a b " * 30, b"x a b c " * 9, b"a b c d e f " * 2):
        h1, _, _, _, key, _ = windows([text], 5, 3)
        keys, counts = np.unique(substring.window_keys([text], 5, 3), return_counts=True)
        often = dict(zip(keys.tolist(), counts.tolist()))
        for h in np.unique(h1):
            assert often[int(key[h1 == h][0])] >= (h1 == h).sum() > 0


def test_packed_places():
    docs = np.zeros(4, substring.Places.kind)
    docs["id"] = [5, 9, -3, 7]
    index, start = np.array([0, 0, 2, 3, 3, 3]), np.array([4, 900, 0, 0, 1, 70_000])
    got, counts, back, (extra,) = substring.Places.unpack(substring.Places.pack(docs, index, start, start.astype("<u8")), "<u8")
    assert got["id"].tolist() == [5, -3, 7] and counts.tolist() == [2, 1, 3] and back.tolist() == start.tolist() == extra.tolist()
    assert len(substring.Places.unpack(substring.Places.pack(docs, index[:0], start[:0]))[2]) == 0


def test_gap_code():
    rng = np.random.default_rng(1)
    for cells in ([], [0], [0, 0], [254], [255], [256, 510, 510, 511, 5000], np.sort(rng.integers(0, 1 << 20, 5000))):
        cells = np.array(cells, np.int64)
        assert np.array_equal(gaps_decoded(gaps_encoded(cells)), cells)


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    got = without_repeats(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).first()
    assert (got.n_words, got.n_removed, got.kept) == (0, 0, "")


def test_very_long_texts_and_a_passage_in_a_third_of_all_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"{d}-a {d}-b" + (f" {passage} " if d % 3 == 0 else " ") + f"{d}-c", "", 0) for d in range(600)]
    rows += [(5000, " ".join(f"l{i}" for i in range(50_000)), "", 0), (5001, "w " * 40_000, "", 0)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got[0] == (63, 0) and all(got[d] == ((63, 60) if d % 3 == 0 else (3, 0)) for d in range(1, 600))
    assert got[5000] == (50_000, 0) and got[5001] == (40_000, 39_999)


def test_shards_sorted_in_parts(monkeypatch):
    """A shard beyond the bound gives the removals that it gives whole."""
    texts = [t and t.encode() for _, t in corpus()]
    h1, h2, index, start, _, _ = windows(texts, 5, 3)
    docs = np.zeros(len(texts), substring.Places.kind)
    docs["id"] = np.arange(len(texts))
    packs = []
    for k in range(7):
        own = index % 7 == k
        packs.append(substring.Places.pack(docs, index[own], start[own], h1[own], h2[own].astype("<u4")))
    batch = substring._batch([(0, 0, p) for p in packs])

    def removed():
        out = set()
        for b in substring._settle(3)(iter([batch])):
            for data in b.column("data").to_pylist():
                own, counts, at, _ = substring.Places.unpack(data)
                out |= set(zip(np.repeat(own["id"], counts).tolist(), at.tolist()))
        return out

    whole = removed()
    first = {}
    for i, s, a, b in zip(index.tolist(), start.tolist(), h1.tolist(), h2.tolist()):
        first.setdefault((a, b & 0xFFFFFFFF), (i, s))
    assert whole == {(i, s) for i, s, a, b in zip(index.tolist(), start.tolist(), h1.tolist(), h2.tolist()) if first[a, b & 0xFFFFFFFF] != (i, s)} and len(whole) > 1000
    monkeypatch.setattr(substring, "SORTED", 500)
    assert len(list(substring.sorted_parts(packs))) > 50
    assert removed() == whole
