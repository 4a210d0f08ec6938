import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import lexical

DOCS = "doc_id long, text string, leaf int, shard int, term string, score string"
ITEMS = "item_id long, text string, item string, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            score = 0
            for t in terms(text):
                if c[t]:
                    df = sum(t in x for _, x in held)
                    m = 100 - 25 + 25 * c.total() * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(n=300):
    rng = random.Random(8)
    topics = [[f"{t}w{i}" for i in range(40)] for t in "abcd"]
    docs = []
    for d in range(n):
        words = rng.choices(rng.choice(topics), k=rng.choice([0, 1, 5, 40, 120])) + rng.choices(["the", "Of", "zoë", "X1", "ÄB"], k=rng.randint(0, 20))
        rng.shuffle(words)
        docs.append((d * 7 % 1000, rng.choice([" ", ", ", "\n-"]).join(words)))
    docs += [(5000 + i, "aw1 aw2 the aw3") for i in range(60)] + [(9, "aw1 aw1")] * 3 + [(None, "aw1 aw2"), (None, None), (77, None), (78, "... ---"), (79, "aw1 " * 20_000)]
    items = [(i, " ".join(rng.choices(rng.choice(topics) + ["the", "of", "unknown"], k=rng.choice([1, 3, 10])))) for i in range(25)]
    items += [(0, items[0][1]), (0, "THE the the"), (None, "aw1 aw2"), (90, None), (91, "!!"), (92, "nowhere"), (93, "äb zoë")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z", 3) for i in items], ITEMS)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard,items_a_task", [(8 << 20, 2048), (1 << 10, 3)])
def test_against_brute_force(spark, monkeypatch, shard, items_a_task):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "ITEMS", items_a_task)
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    index = lexical.build(d, fitted=8)
    assert rows(lexical.search(index, i)) == brute(docs, items)
    assert index.table.filter("term is null").selectExpr("sum(size(ids))").first()[0] == len(docs), "every row is indexed"
    assert rows(lexical.search(index, i, k=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(20)
    d, i = frames(spark, docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("text is null"), i)):
        got = lexical.search(lexical.build(a), b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_bisection_parts_topics_and_spares_visits(spark):
    rng = random.Random(2)
    docs = [lexical._features([f"{t}{i}".encode() for i in rng.sample(range(200), 40)]) for t in "pqrs" for _ in range(40)]
    order = list(range(len(docs)))
    rng.shuffle(order)
    weights, above = lexical.bisect([docs[i] for i in order], 2)
    leaf = [lexical._leaf(f, weights, above) for f in docs]
    groups = [Counter(leaf[40 * t : 40 * t + 40]).most_common(1)[0] for t in range(4)]
    assert all(n >= 36 for _, n in groups) and len({g for g, _ in groups}) == 4
    # a document that was not fitted finds the leaf of its topic
    assert lexical._leaf(lexical._features([f"r{i}".encode() for i in range(30)]), weights, above) == groups[2][0]


def test_copies_alone_leave_one_half_empty():
    weights, above = lexical.bisect([np.array([1, 2, 3])] * 20, 3)
    assert {lexical._leaf(np.array([1, 2, 3]), weights, above)} == {0}


def test_bounds_hold_for_every_document(spark):
    docs, items = corpus()
    index = lexical.build(frames(spark, docs, items)[0], fitted=8)
    found = index.table.collect()
    sizes = {r.shard: np.array(r.sizes) for r in found if r.term is None}
    postings = [r for r in found if r.term is not None]
    assert postings and {r.leaf for r in postings} != {0}
    for r in postings:
        parts = lexical._greatest(np.array(r.counts), sizes[r.shard][r.places], index.n, index.length)
        assert r.top == parts.max() and r.df == len(r.places) and r.places == sorted(set(r.places))


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_postings_that_no_item_asks_for_are_not_shuffled(spark, monkeypatch, most):
    """However large Spark takes the asked terms for; where they are too many to broadcast, the rows are the same."""
    monkeypatch.setattr(lexical, "ASKED", most, raising=False)
    docs = [(i, " ".join([f"own{i}x{j}" for j in range(100)] + [f"some{i % 10}"] * (i % 7 + 1))) for i in range(200)]
    items = [(i, f"some{i} own{i}x1") for i in range(10)]
    d, i = frames(spark, docs, items)
    index = lexical.build(d, fitted=8)
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(lexical.search(index, i)) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not most or shuffled(spark) - before < 20_000, "there are 20,000 postings of words that one document holds"
