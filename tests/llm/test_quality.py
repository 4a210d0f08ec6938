import zlib

import numpy as np

from brindle.llm.quality import WIDTH, Network, accepted, fit, score


def slow_score(net, text):
    """The network by its definition: one byte position and one chunk at a time."""
    x = (text or b"\0") + bytes(WIDTH - 1)
    n = max(1, len(text))
    act = [sum(net.p["e"][x[i + j]].astype(float) @ net.p["w"][j] for j in range(WIDTH)) for i in range(n + WIDTH - 1 - WIDTH + 1)]
    blocks = [np.maximum(np.max(act[i : i + 512], axis=0) + net.p["b"], 0) for i in range(0, n, 512)]
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks
    logits = [np.maximum(c @ net.p["h"] + net.p["c"], 0) @ net.p["o"] + net.p["d"][0] for c in chunks]
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_network_is_its_definition():
    net = Network(1)
    rng = np.random.default_rng(0)
    texts = [b"", b"a", *(bytes(rng.integers(32, 120, n, np.uint8)) for n in (5, 511, 512, 513, 1024, 1500, 3000))]
    fast = net.score(texts)
    for t, s in zip(texts, fast):
        assert abs(slow_score(net, t) - s) < 1e-4, len(t)
    assert np.allclose(fast, [net.score([t])[0] for t in texts], atol=1e-5)


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(2)
    good = [b" ".join(rng.choice([b"the", b"red", b"house"], 60)) for _ in range(40)]
    bad = [b"### ".join(rng.choice([b"the", b"red", b"house"], 60)) for _ in range(20)]
    net = Network()
    y = np.r_[np.ones(40), np.zeros(20)].astype(np.float32)
    net.train(good + bad, y, epochs=6)
    s = net.score(good + bad)
    assert s[:40].min() > 0.5 > s[40:].max()


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, fit(docs, labels))
    assert got.count() == docs.count()
    rows = got.filter("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad])
    assert auc > 0.9, auc
    assert np.mean([r.predicted == 1 for r in good]) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, "b" * 100_000, 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {(r.doc_id, r.held_out): r.score for r in score(docs, fit(docs, none)).collect()}
    assert set(got.values()) == {0.5}
    net = Network()
    rows = score(docs, net).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert accepted(docs, net, 0.0).columns == docs.columns and accepted(docs, net, 0.0).count() == 5
    assert score(docs.limit(0), net).count() == 0


def test_the_sample_is_bounded_and_of_one_text_for_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Network, "train", lambda self, texts, labels: seen.append((list(texts), labels.tolist())))
    docs = spark.createDataFrame([(k, f"text {k} " * 20) for k in range(60)] + [(1, f"again {k}") for k in range(200)] + [(2, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2 + [(None, 1), (999, 1)], "doc_id long, quality int")
    fit(docs, labels)
    texts, kinds = seen.pop()
    want = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert len(texts) == len(want) and sorted(kinds) == sorted(float(k % 2) for k in want)
    fit(docs, labels, most_bytes=2000)
    assert 0 < sum(map(len, seen[0][0])) <= 2000
    fit(docs, labels, per_class=3)
    assert len(seen[1][0]) == 6
    assert fit(docs, labels, most_bytes=0).score([b"x"])[0] == 0.5
