import zlib

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import quality, secret_scan, simhash
from brindle.llm.decontam import words_of
from brindle.llm.packing import Tokenizer, default_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output rows, as the driver runs them: written and read again."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((name, docs, out))
        docs = out
    return {name: (a, b) for name, a, b in seen}


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (docs, out) in list(stages.items())[:-1]:
        assert sorted(out.columns) == sorted(COLUMNS), name


def test_quality_stage_drops_what_the_model_rejects(spark, sf, stages):
    docs, out = stages["quality_classifier"]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r["doc_id"] for r in rows(docs) if model.score([r["text"].encode()])[0] >= 0.3}
    assert {r["doc_id"] for r in rows(out)} == want and 0 < len(want) < docs.count()


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def test_dedup_stage_keeps_one_of_each_group(stages):
    """Of each group by all pairs of five-word shingle sets at 0.8, the document of the least id."""
    docs, out = stages["simhash_near_dedup"]
    own = sorted(rows(docs), key=lambda r: r["doc_id"])
    sets = [shingles(r["text"]) for r in own]
    label = list(range(len(own)))
    near = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)]
    while True:
        new = list(label)
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            break
        label = new
    kept = {r["doc_id"] for r in rows(out)}
    assert kept == {own[k]["doc_id"] for k in set(label)} and len(kept) < len(own)


def test_decontamination_stage(spark, sf, stages):
    docs, out = stages["benchmark_decontamination"]
    items = [words_of(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12)) if w}
    keep = set()
    for r in rows(docs):
        w, hit = words_of(r["text"].encode()), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            keep.add(r["doc_id"])
    assert {r["doc_id"] for r in rows(out)} == keep


def test_secret_stage_redacts_and_keeps_rows(stages):
    docs, out = stages["secret_scan"]
    after = {r["doc_id"]: r for r in rows(out)}
    assert len(after) == docs.count()
    for r in rows(docs):
        base = secret_scan.base_spans(r["text"])
        want = secret_scan.redacted(r["text"], base + secret_scan.random_spans(r["text"], base))
        assert after[r["doc_id"]]["text"] == want and after[r["doc_id"]]["n_chars"] == len(want)
        assert all(r["text"][a:b] not in want for a, _, b in base)


def test_packing_stage_round_trip(stages):
    docs, out = stages["best_fit_packing"]
    encode = Tokenizer(*default_files())
    packed = rows(out)
    for r in rows(docs):
        ids = np.array([*encode(r["text"]), 2], "<u4")
        own = sorted((p for p in packed if p["doc_id"] == r["doc_id"]), key=lambda p: p["piece"])
        assert sum(p["length"] for p in own) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)
    by = {}
    for p in packed:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(sum(n for _, n in s) <= 1024 for s in by.values())


def test_run_is_its_stages(spark, sf, stages):
    _, out = stages["best_fit_packing"]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == out.columns
    assert sorted(map(str, rows(got.select("doc_id", "piece", "length", "ids_crc32")))) == sorted(map(str, rows(out.select("doc_id", "piece", "length", "ids_crc32"))))
    for packed in (rows(got), rows(out)):
        by = {}
        for p in packed:
            by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert len(by) == len({p["sequence_id"] for p in rows(out)})
        for own in by.values():
            own.sort()
            assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, documents, labels=(), benchmark=()):
    spark.createDataFrame(list(documents), DOCUMENTS + ", extra map<string,int>").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0


def test_run_on_nulls_repeats_and_very_long_texts(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(50_000))
    item = " ".join(f"b{k}" for k in range(20))
    documents = [(None, None, None, None, None, None)] * 3 + [(7, "a text that is here five times", "en", "x", 30, {"a": 1})] * 5 + [(8, "", "en", None, 0, None), (9, long, "en", "x", len(long), None), (10, long + " more", None, "x", 0, None)]
    documents += [(11, f"{item} tail", "en", "x", 1, None), (12, "my password=hunter2222 is here", "en", "x", 2, {"b": 2}), (13, None, "de", "y", None, None)]
    labels = [(7, 1, 0), (7, None, 0), (None, 1, 0), (99, 0, 1)]
    sf = written(spark, tmp_path, documents, labels, [(1, item), (1, item), (None, None), (2, "...")])
    packed = rows(corpus_pipeline.run(spark, sf))
    # 11 is in the benchmark, 10 is a copy of 9; of the wordless texts that of the least id stays
    assert {p["doc_id"] for p in packed} == {7, 8, 9, 12} and sum(p["doc_id"] == 7 for p in packed) == 1
    encode = Tokenizer(*default_files())
    assert sum(p["length"] for p in packed if p["doc_id"] == 12) == len(encode("my [SECRET] is here")) + 1
    assert sum(p["length"] for p in packed if p["doc_id"] == 9) == len(encode(long)) + 1


def test_every_stage_alone_on_nulls_and_nothing(spark, tmp_path):
    sf = written(spark, tmp_path, [], [], [(1, "one two three four five six seven")])
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "", "x", "y", 0), (1, "", "x", "y", 0)], DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name
        assert stage(spark, odd, sf).count() == {"simhash_near_dedup": 1}.get(name, 4), name


def test_representatives(spark):
    docs = spark.createDataFrame([(2, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (None, "a b c d e", "z"), (None, "other words", "z"), (5, None, "q"), (6, "", "q")], "doc_id long, text string, fingerprint string")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, "a b c d e", "y"), (None, "other words", "z"), (5, None, "q")], docs.schema).collect()))
