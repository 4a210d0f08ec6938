import random

import pytest

from brindle.llm import decontam
from brindle.llm.decontam import contamination, uncontaminated

DOCS = "doc_id long, text string, items string, _spans int"
ITEMS = "item_id long, text string, n_words int"


def words(text):
    return __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", __import__("re").sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            own = words(t)
            n = min(13, len(own))
            for s in range(len(own) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("" if i is None else str(i))
        out.append((str(d), len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    v = ["the", "a", "of", "x1", "Éa", "zoë", "big", "RED", "sun"]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 3, 9, 13, 14, 30])))) for i in range(12)]
    items += [(3, "an item that repeats an id of another"), (None, "no id at all here"), (50, None), (51, "..."), (52, "lonely")]
    docs = []
    for d in range(60):
        text = rng.choices(v, k=rng.randint(0, 80))
        for _, t in rng.sample(items[:12], 2) if d % 3 == 0 else ():
            p = rng.randint(0, len(text))
            text[p:p] = (t or "").upper().split()
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(90, None), (91, ""), (92, "No ID at all here"), (92, "No ID at all here"), (None, "lonely")]
    return docs, items


@pytest.mark.parametrize("block", [4 << 20, 64])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    if block < 100:
        d = d.drop("_spans")
    got = contamination(d, b).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got) == brute(docs, items)
    kept = uncontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in brute(docs, items) if not x[5])


def test_empty_tables(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(d, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).count() == 0
    got = contamination(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS), b).collect()
    assert len(got) == len(docs) and not any(r.n_hit or r.contaminated for r in got)


@pytest.mark.parametrize("block", [4 << 20, 60_000])
def test_very_long_texts_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    item = " ".join(f"b{k}" for k in range(40))
    long = " ".join(f"w{k}" for k in range(40_000))
    docs = [(1, f"{long} {item} {long}"), (2, item + " end"), (3, long), *((10 + k, f"copy {item}") for k in range(50))]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).drop("_spans")
    b = spark.createDataFrame([(7, item, 0), (8, long, 0), (9, "not here at all", 0)], ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(d, b).collect()}
    assert got[1] == (80_040, 80_040, ["7", "8"], True) and got[2] == (41, 40, ["7"], True) and got[3] == (40_000, 40_000, ["8"], True)
    assert all(got[10 + k] == (41, 40, ["7"], True) for k in range(50))
    assert uncontaminated(d, b).count() == 0
