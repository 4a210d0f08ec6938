import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import language
from brindle.llm.language import Model, fit, has_letter, identify, trigrams


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, fit(docs)).join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "lang", "score").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, fit(docs)


def test_mixtures_find_the_shares(spark):
    docs, model = corpus(spark)
    by = {r.lang: r.t.encode() for r in docs.filter("n_chars > 3000").groupBy("lang").agg(F.max("text").alias("t")).collect()}
    en, fr = by["en"][:3000], by["fr"][:1500]
    while (fr[-1] & 0xC0) == 0x80 or fr[-1] >= 0xC0:
        fr = fr[:-1]
    shares = dict(zip(model.langs, model.mixtures([en + b" " + fr])[0]))
    assert abs(shares["en"] - 2 / 3) < 0.08 and abs(shares["fr"] - 1 / 3) < 0.08
    alone = dict(zip(model.langs, model.mixtures([en])[0]))
    assert alone["en"] > 0.95 and abs(sum(alone.values()) - 1) < 1e-9
    assert abs(model.mixtures([by["de"], en, by["es"]])[1] - model.mixtures([en])[0]).max() < 1e-9


def test_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, "aaa bbb" if i % 2 else "ccc", "x" if i % 2 else "y", 0) for i in range(40)], "doc_id long, text string, lang string, chunk int").repartition(3)
    model = fit(docs)
    counts = {}
    for i in range(40):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            ids, _ = trigrams([b"aaa bbb" if i % 2 else b"ccc"])
            own = counts.setdefault("x" if i % 2 else "y", [0] * 65536)
            for k in ids:
                own[k] += 1
    import numpy as np

    assert np.allclose(model.logs, Model({k: np.array(v) for k, v in counts.items()}).logs)


def test_odd_rows(spark):
    _, model = corpus(spark)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (4, "é"), (None, "the and of that"), (6, "日本"), (7, "the " * 100_000)]
    got = identify(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang_pred string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert all(by[i].lang_pred in model.langs and 0 < by[i].score <= 1 for i in (4, None, 6, 7))
    assert by[7].lang_pred == "en" and not by[None].held_out
    assert has_letter("²é".encode()) and not has_letter("²½ ٣".encode())
    none = fit(spark.createDataFrame([(1, "a", None), (None, "b", "x"), (5, None, "x")], "doc_id long, text string, lang string"))
    assert none.langs == [] and {r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()} == {"und"}
    assert identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_shares_are_those_of_plain_em(spark):
    """The mixture by one loop over units, for the set of languages that the model selected."""
    docs, model = corpus(spark)
    texts = [r.text.encode() for r in docs.orderBy("doc_id").limit(12).collect()]
    texts += [texts[0][:500] + b" " + texts[1][:400] + b" " + texts[2][:700]]
    for t, fast in zip(texts, model.mixtures(texts)):
        ids, _ = trigrams([t])
        unit = [model.logs[ids[k : k + language.UNIT]].sum(0, dtype=float) for k in range(0, len(ids), language.UNIT)]
        odds = np.exp([u - u.max() for u in unit])
        best = None
        for subset in [(a,) for a in range(4)] + [(a, b) for a in range(4) for b in range(a)] + [(a, b, c) for a in range(4) for b in range(a) for c in range(b)] + [(0, 1, 2, 3)]:
            share = np.array([1 / len(subset) if k in subset else 0 for k in range(4)])
            for _ in range(3000):
                part = share * odds
                share = (part / part.sum(1, keepdims=True)).mean(0)
            value = np.log((share * odds).sum(1)).sum() - (len(subset) - 1) * (0.5 * np.log(len(unit)) + 1)
            if best is None or value > best[0] + 1e-9:
                best = value, share
        assert np.abs(best[1] - fast).max() < 0.02, (best, fast)


def test_mixture_column_and_too_many_languages(spark):
    docs, model = corpus(spark)
    for r in identify(docs, model).limit(50).collect():
        parts = [x.split("=") for x in r.mixture.split(",")]
        assert parts[0][0] == r.lang_pred and abs(float(parts[0][1]) - r.score) < 0.001 and abs(sum(float(x) for _, x in parts) - 1) < 0.01
    many = spark.createDataFrame([(i, "text", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5"):
        fit(many, languages=5)


def test_documents_of_more_than_four_languages():
    """The set of languages grows as far as the likelihood tells: the shares of six are found."""
    rng = np.random.default_rng(5)
    names = ["aa", "bb", "cc", "dd", "ee", "ff"]
    write = lambda k, n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwx"[4 * k : 4 * k + 4] + " "), n)).encode()
    counts = {name: np.bincount(language.trigrams([write(k, 20_000)])[0], minlength=language.BUCKETS) for k, name in enumerate(names)}
    lengths = [3000, 1000, 1000, 1000, 1000, 1000]
    shares = language.Model(counts).mixtures([b" ".join(write(k, n) for k, n in enumerate(lengths))])[0]
    assert np.allclose(shares, np.array(lengths) / sum(lengths), atol=0.03)
