import random
import string

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brindle.llm import simhash
from brindle.llm.simhash import components, near_duplicates

SCHEMA = "doc_id long, text string, fingerprint int, cell string"


def print_of(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), f"{prints[i]:016x}", str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def made(spark, rows):
    return near_duplicates(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA))


def test_against_all_pairs(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices(string.ascii_letters + "éß", k=rng.randint(1, 8))) for _ in range(400)]
    rows = []
    for d in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        rows.append((d, " ".join(words)))
        for e in range(rng.choice([0, 0, 1, 6])):
            near = list(words)
            if near:
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * d + e, rng.choice([" ", "\n", "\t"]).join(near)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5003, "A b"), (None, "A b"), (None, "only here")]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in made(spark, rows).collect())
    assert got == brute(rows)
    assert len({x[2] for x in got}) < len(rows) - 20


def test_bit_flips_chain(spark):
    """Fingerprints within 4 bits are found wherever the bits are; 5 bits apart are not linked."""
    from brindle.llm.simhash import links

    rng = random.Random(2)
    centers = [rng.getrandbits(64) for _ in range(60)]
    points = set(centers)
    for c in centers:
        for n in (1, 2, 3, 4, 5):
            x = c
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            points.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(links(frame)).collect()}
    label = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for x in signed:
            for y in signed:
                if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4 and label[y] < label[x]:
                    label[x], changed = label[y], True
    assert {x: roots.get(x, x) for x in signed} == label


def test_cells_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = 0x0123456789ABCDEF
    points = [base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    frame = spark.createDataFrame([(x,) for x in points], "fp long")
    roots = simhash.components(simhash.links(frame)).collect()
    assert len(roots) == len(points) - 1 and {r.root for r in roots} == {min(points)}


def test_empty_and_one_group(spark):
    assert made(spark, []).count() == 0
    rows = [(i, "the same words in each of them") for i in range(300)]
    assert made(spark, rows).select(F.min("component_id"), F.max("component_id"), F.count_distinct("fingerprint")).first() == (0, 0, 1)


def test_representatives_of_edited_texts(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for d in range(60):
        text = rng.choices(words, k=300)
        rows.append((d, " ".join(text), "x"))
        for e in range(3):
            near = list(text)
            for at in rng.sample(range(300), 4):
                near[at] = rng.choice(words)
            rows.append((1000 + 3 * d + e, " ".join(near), "x"))
    rows += [(5000, " ".join(rng.choices(words, k=300)), "x")] + [(6000 + k, rows[0][1], "x") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == {*range(60), 5000}
    assert simhash.representatives(docs.limit(0)).collect() == []


def jaccard_groups(texts, least=0.8):
    """The least place of each text's group, by all pairs."""
    sets = [set(simhash.shingles(t.encode()).tolist()) for t in texts]
    label = list(range(len(sets)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= round(10 * least) * len(sets[i] | sets[j])]
    while True:
        new = list(label)
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def test_representatives_are_exact(spark, monkeypatch):
    """Pairs at, just above and just below 0.8, lines and passages that many texts share, and groups of several blocks."""
    rng = random.Random(6)
    word = iter(f"w{k}" for k in range(10**6))
    fresh = lambda n: [next(word) for _ in range(n)]
    line, texts = fresh(30), []
    for n in range(60):
        # sets of m shingles and of the same with k more: m / (m + k)
        m = 4 * rng.randint(10, 60)
        text = fresh(m + 4)
        texts += [" ".join(text), " ".join(text + fresh(m // 4 + n % 3 - 1))]
    base = fresh(204)
    for _ in range(60):
        near = list(base)
        near[rng.randrange(204)] = next(word)
        texts.append(" ".join(near))
    texts += [" ".join(fresh(rng.randint(1, 8)) + line) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string")
    want = set(jaccard_groups(texts))
    assert {r.doc_id for r in simhash.representatives(docs, log2_cells=20).collect()} == want
    monkeypatch.setattr(simhash.exact_links, "__defaults__", (16,))
    assert {r.doc_id for r in simhash.representatives(docs, log2_cells=8).collect()} == want


def test_counts_of_segments_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 30, 200, 40_000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, n // 9, np.uint64)])
        x, y = (simhash._embedding(s).astype(int) for s in (a, b))
        assert x.max() <= 255 and np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_representatives_of_odd_tables(spark):
    """Two columns only, a map and a struct, clashing names, rows that repeat and nothing but nulls."""
    two = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.representatives(two).collect())) == [(1, "a b"), (2, None)]
    odd = spark.createDataFrame([(1, "a b", {"y": 2}, (None,), 1), (1, "a b", {"x": 1}, (3,), 2), (5, "a b", None, None, 3)], "doc_id long, text string, node map<string,int>, cell struct<e0:int>, `_k` int")
    assert [r["_k"] for r in simhash.representatives(odd).collect()] == [2]
    nulls = spark.createDataFrame([(None, None), (None, None), (None, "")], two.schema)
    assert simhash.representatives(nulls).count() == 1
    assert simhash.representatives(two.limit(0)).columns == ["doc_id", "text"]


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w " * 50_000), (4, "short")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [1, 3, 4]
    by = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert by[2].component_id == 1 and by[3].fingerprint == f"{print_of('w ' * 50_000):016x}"


def test_cells_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "BROADCASTABLE", 0)
    points = [int(k) for k in {1 << a | 1 << b for a in range(12) for b in range(12)}]
    roots = components(simhash.links(spark.createDataFrame([(x,) for x in points], "fp long"), 2)).collect()
    assert len(roots) == len(points) - 1 and {r.root for r in roots} == {min(points)}


def shuffled(spark):
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_that_lack_company_are_not_shuffled_whole(spark):
    """However many shingles there are for a sketch's cells: long texts of a common line alone have no cells, near copies are found."""
    rng = random.Random(9)
    word = iter(f"v{k}" for k in range(10**6))
    line = [next(word) for _ in range(24)]
    texts = [[next(word) for _ in range(1200)] for _ in range(40)]
    for text in texts:
        at = rng.randrange(1200)
        text[at:at] = line
    near = list(texts[7])
    near[600] = next(word)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([*texts, near])], "doc_id long, text string")
    before = shuffled(spark)
    assert {r.doc_id for r in simhash.representatives(docs, log2_cells=8).select("doc_id").collect()} == set(range(40))
    assert shuffled(spark) - before < 2 * sum(len(" ".join(t)) for t in texts)
