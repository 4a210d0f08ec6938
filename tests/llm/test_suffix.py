import random
from functools import partial

import numpy as np
import pytest

from brindle.llm import substring, suffix
from brindle.llm.substring import sliding_least, window_keys, windows
from brindle.llm.suffix import repeated_passages

SCHEMA = "doc_id long, text string, hash string, start int"


def brute(rows, size):
    """Passages by their definition, with every place of their first stretch in earlier documents."""
    place = lambda d: (d is None, d or 0)
    split = {(d, t): (t or "").encode().split() for d, t in rows}
    where = {}
    for (d, t), w in split.items():
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(w[i : i + size]), []).append((place(d), d, i))
    out = {}
    for (d, t), w in split.items():
        stop = None
        for i in range(len(w) - size + 1):
            earlier = [(x, k) for p, x, k in where[tuple(w[i : i + size])] if p < place(d)]
            if not earlier:
                continue
            if stop is None or i > stop:
                key = [d, i, size, set(earlier)]
                out.setdefault((d, t), []).append(key)
            key[2] = i + size - key[1]
            stop = i + size
    return [x for v in out.values() for x in v]


def corpus():
    rng = random.Random(8)
    v = [f"w{i}é" for i in range(200)]
    shared = [rng.choices(v, k=n) for n in (12, 20, 35, 11, 14)]
    rows = []
    for d in range(100):
        words = rng.choices(v, k=rng.randint(0, 70))
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = s if rng.random() < 0.7 else s[3:]
        rows.append((d * 7 % 100, " ".join(words)))
    rows += [(500 + i, rows[3][1]) for i in range(30)]
    rows += [(600, "again and " * 40), (601, None), (602, ""), (700, rows[5][1] + " x"), (700, rows[5][1] + " x"), (700, "other " + " ".join(shared[1])), (None, " ".join(shared[2] * 2))]
    return rows


@pytest.mark.parametrize(("cells", "held"), [(24, 4 << 20), (8, 4 << 20), (20, 60)])
def test_against_brute_force(spark, monkeypatch, cells, held):
    monkeypatch.setattr(substring, "HELD", held)
    monkeypatch.setattr(suffix, "GRAM", 4)
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    got = repeated_passages(frame, 10, cells).collect()
    want = brute(rows, 10)
    assert sorted((str(r.doc_id), r.start, r.n_words) for r in got) == sorted((str(d), a, n) for d, a, n, _ in want)
    sources = {(str(d), a, n): s for d, a, n, s in want}
    for r in got:
        assert (r.source_doc_id, r.source_start) in sources[str(r.doc_id), r.start, r.n_words]


def test_equal_stretches_select_equal_minimisers():
    rng = np.random.default_rng(3)
    assert all(np.array_equal(sliding_least(x, w), [x[i : i + w].min() for i in range(len(x) - w + 1)]) for w in (1, 2, 3, 7, 8, 35) for x in [rng.integers(0, 1 << 60, 80).astype(np.uint64)])
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"{' '.join(f'{c}{i}' for i in range(n))} {shared} end {c}".encode() for c, n in (("a", 40), ("b", 77))]
    h1, _, owner, start, least, _ = windows(texts, 50, 16)
    one, two = ({int(h): int(m) for h, m, o in zip(h1, least, owner) if o == k} for k in (0, 1))
    both = set(one) & set(two)
    assert len(both) == 12 and all(one[h] == two[h] for h in both)
    assert len(window_keys(texts, 50, 16)) < len(h1) / 6


def test_long_passages_across_documents(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    planted = words(51)
    rows = [(i, f"{words(300)} {planted if i in (3, 40, 77) else words(49)} {words(200)}", "", 0) for i in range(90)]
    got = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.start, r.n_words, r.source_doc_id, r.source_start) for r in got} == {(d, 300, 51, 3, 300) for d in (40, 77)}
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("cells", "held"), [(24, 4 << 20), (8, 4 << 20), (20, 60)])
def test_repeats_within_a_document(spark, monkeypatch, cells, held):
    """All stretches that start earlier, in an earlier document or the same one, against brute force."""
    monkeypatch.setattr(substring, "HELD", held)
    monkeypatch.setattr(suffix, "GRAM", 4)
    rows = [r for r in corpus() if r[0] != 700]
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(25)]
    for d in range(800, 820):
        rows.append((d, " ".join(x for k in range(5) for x in [*passage[rng.randint(0, 9) :], *(f"{d}-{k}-{i}" for i in range(5))])))
    words = {d: (t or "").encode().split() for d, t in rows}
    place = lambda d: (d is None, d or 0)
    first = {}
    for d in sorted(words, key=place):
        for i in range(len(words[d]) - 9):
            first.setdefault(tuple(words[d][i : i + 10]), []).append((place(d), i, d))
    want = {}
    for d, w in words.items():
        found = []
        for i in range(len(w) - 9):
            earlier = {(x, k) for p, k, x in first[tuple(w[i : i + 10])] if (p, k) < (place(d), i)}
            if earlier and found and i <= found[-1][0] + found[-1][1]:
                found[-1][1] = i + 10 - found[-1][0]
            elif earlier:
                found.append([i, 10, earlier])
        want |= {(d, i, n): s for i, n, s in found}
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    got = repeated_passages(frame, 10, cells, within=True).collect()
    assert {(r.doc_id, r.start, r.n_words) for r in got} == set(want) and len(got) == len(want)
    assert all((r.source_doc_id, r.source_start) in want[r.doc_id, r.start, r.n_words] for r in got)
    assert any(r.source_doc_id == r.doc_id for r in got)


def test_query_reports_repeats_within_a_document(spark, tmp_path):
    from brindle.llm.queries import op5_suffix_dedup

    unique = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, f"{unique('p', 60)} {unique('x', 40)} {unique('p', 60)}"), (2, f"{unique('q', 55)} one"), (2, f"{unique('q', 55)} other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op5_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == [(1, 100, 60, 1, 0), (2, 0, 55, 2, 0)]


def test_suffix_array_compares_as_brute_force():
    """The order of the words, the common prefixes of neighbours, and the first of equal stretches, over words that repeat a lot."""
    rng = np.random.default_rng(11)
    gram, reach = 2, 5
    for words in (2, 4, 30):
        hashes = rng.integers(1, words + 1, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        places = np.unique(rng.integers(reach, 400 - gram - reach, 120))
        own = suffix.Suffixes.at(hashes, substring.rolling(hashes, gram, substring.M1), places, gram, reach)
        place, common = own.array()
        text = [tuple(hashes[p : p + gram + reach].tolist()) for p in places]
        order = np.argsort(place)
        key = [(int(own.gram[k]), *text[k][gram:]) for k in order]
        assert key == sorted(key)
        for x, y, n in zip(key, key[1:], common[1:]):
            same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), reach + 1)
            assert n == same - 1
        at, back = np.divmod(rng.permutation(len(places) * (reach + 1))[:500], reach + 1)
        rank, start = rng.integers(0, 6, 500), rng.permutation(500)
        later, first = own.compare(at, back, rank, start, True)
        stretch = [(int(j), tuple(hashes[places[k] - j : places[k] - j + gram + reach].tolist())) for k, j in zip(at, back)]
        for i, s in enumerate(stretch):
            equals = [k for k, o in enumerate(stretch) if o == s]
            head = min(equals, key=lambda k: (rank[k], start[k]))
            assert first[i] == head and later[i] == (i != head)


def test_a_passage_in_a_third_of_all_rows_and_very_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(d, " ".join(f"{d}-{i}" for i in range(60)) + (f" {passage} " if d % 3 == 0 else " ") + " ".join(f"{d}+{i}" for i in range(60)), "x", 0) for d in range(900)]
    rows += [(5000, " ".join(f"l{i}" for i in range(60_000)), "", 0), (5001, " ".join(f"l{i}" for i in range(30_000, 60_000)), "", 0), (5002, "w " * 30_000, "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {(r.doc_id, r.start, r.n_words) for r in repeated_passages(frame, within=True).collect()}
    assert got == {(d, 60, 120) for d in range(3, 900, 3)} | {(5001, 0, 30_000), (5002, 1, 29_999)}


def test_edges_of_a_common_passage_are_dealt_apart(spark, monkeypatch):
    """Shards of what crosses the edges of a passage that all documents share are about even, and results the same."""
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(d, " ".join(f"{d}-{i}" for i in range(40)) + f" {passage} " + " ".join(f"{d}+{i}" for i in range(40)), "x", 0) for d in range(800)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(80)
    docs = frame.selectExpr("doc_id", "cast(text as binary) as text", "xxhash64(text) as hash")
    share = spark.sparkContext.broadcast
    bits, often = substring.sketched(docs, partial(window_keys, size=50, gram=16), 24)
    most = {}
    for name, flags in (("apart", often), ("together", np.zeros_like(often))):
        sent = docs.mapInArrow(suffix._candidates(50, 16, 24, share(bits), share(flags), 16, True), suffix._SENT).filter("kind = 0")
        sizes = [len(substring.gathered([bytes(r.data) for r in v])[1]) for v in _by_key(sent.collect()).values()]
        most[name] = max(sizes) / sum(sizes) * 16
    assert most["apart"] < 1.3 and most["together"] > 2
    assert {(r.doc_id, r.start, r.n_words) for r in repeated_passages(frame).collect()} == {(d, 40, 120) for d in range(1, 800)}


def _by_key(sent):
    out = {}
    for r in sent:
        out.setdefault(r.key, []).append(r)
    return out


def test_the_source_is_the_earliest_place_however_rows_are_dealt(spark):
    rng = random.Random(4)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = [words(12) for _ in range(6)]
    rows = []
    for d in rng.sample(range(1000), 120):
        text = words(rng.randint(0, 9))
        for k in rng.sample(range(6), 2):
            text += shared[k] + words(rng.randint(1, 4))
        rows.append((d, " ".join(text), "x", 0))
    first = {}
    for d, t, _, _ in sorted(rows):
        w = t.split()
        for i in range(len(w) - 9):
            first.setdefault(tuple(w[i : i + 10]), (d, i))
    frame = spark.createDataFrame(rows, SCHEMA)
    seen = set()
    for n in (1, 4, 13):
        got = repeated_passages(frame.repartition(n), 10, 20).collect()
        text = {d: t.split() for d, t, _, _ in rows}
        for r in got:
            assert (r.source_doc_id, r.source_start) == first[tuple(text[r.doc_id][r.start : r.start + 10])]
        seen.add(tuple(sorted(map(tuple, got))))
    assert len(seen) == 1 and len(next(iter(seen))) > 100
