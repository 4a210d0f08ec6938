import random
import re
from collections import Counter

from brindle.llm import licenses

SCHEMA = "doc_id long, text string, label string, word int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, templates, phrases=licenses.PHRASES):
    out = []
    for d, text in docs:
        w = words(text)
        base = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(words(p))] == words(p)]
        found = {}
        for label, t in templates:
            tokens, reach = set(words(t)), 2 * len(words(t))
            best = max((len(tokens & set(w[i : i + reach])) for i in range(len(w))), default=0)
            if tokens and 5 * best >= 4 * len(tokens):
                found[label] = max(found.get(label, 0), best / len(tokens))
        own = {x for _, x in base}
        starts = [i for i, _ in base]
        out.append((d, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(found))), 1.0 if base else max(found.values(), default=0.0)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.drop("blocks").collect()), key=repr)


def corpus(templates):
    rng = random.Random(6)
    vocabulary = sorted({w for _, t in templates for w in words(t)}) + [f"x{i}" for i in range(60)]
    docs = []
    for d in range(150):
        text = rng.choices(vocabulary, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            t = words(rng.choice(templates)[1])
            t = [w for w in t if rng.random() > rng.choice([0, 0.1, 0.3])]
            for _ in range(rng.randint(0, len(t))):
                t.insert(rng.randint(0, len(t)), "noise")
            p = rng.randint(0, len(text))
            text[p:p] = t
        if d % 5 == 0:
            text[3:3] = rng.choice(["MIT License", "the Apache-License", "General Public License", "mit\nlicense", "general public mit license"]).split(" ")
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(900, None), (901, ""), (902, "MIT License"), (902, "MIT License"), (None, "General  PUBLIC license, apache license"), (903, "mit"), (904, "licensed under " * 5000 + " ".join(words(templates[1][1])) + " word" * 20_000)]
    return docs


def test_against_brute_force(spark):
    docs = corpus(licenses.TEMPLATES)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    got = rows(licenses.scan(df))
    assert got == brute(docs, licenses.TEMPLATES)
    assert sum(bool(r[6]) for r in got) > 40
    for r in licenses.scan(df).collect():
        w = words(dict(docs)[r.doc_id]) if r.doc_id is not None and r.doc_id != 902 else None
        for b in r.blocks if w else ():
            shares = [len(set(words(t)) & set(w[b.start : b.stop])) / len(set(words(t))) for label, t in licenses.TEMPLATES if label == b.label]
            assert b.share in shares and b.share >= 0.8


def test_own_templates_and_hot_documents(spark):
    templates = [("t", "one two three four five"), ("u", "a a a"), ("empty", "...")]
    docs = [(i, "one two x three x x four") for i in range(200)] + [(500, "one two three"), (501, "a"), (502, "four three x x x x x x two one")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert rows(licenses.scan(df, templates, [])) == brute(docs, templates, [])
    assert Counter(r[6] for r in rows(licenses.scan(df, templates, []))) == {"t": 201, "u": 1, "": 1}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "MIT License", "x", 1)], SCHEMA)
    assert licenses.scan(df.limit(0)).count() == 0
    assert rows(licenses.scan(df, [], [])) == [(1, 2, 0, None, None, "", "", 0.0)]
