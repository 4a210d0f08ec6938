import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.packing import Tokenizer, default_files, pack, relax, solve, tokenized_pieces


@pytest.fixture(scope="module")
def reference():
    import tokenizers

    return tokenizers.Tokenizer.from_file(default_files()[0])


def check(rows, docs, reference, capacity):
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append([*reference.encode(t or "", add_special_tokens=False).ids, 2])
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    for d, lists in ids.items():
        want = []
        for x in lists:
            x = np.array(x, "<u4")
            first = len(x) % capacity or capacity
            cuts = [0, *range(first, len(x) + 1, capacity)]
            want += [(k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(by_doc[d]) == sorted(want)
    assert set(by_doc) == set(ids)
    return len(by_sequence), sum(n for s in by_sequence.values() for _, n in s)


def test_round_trip(spark, reference):
    rng = random.Random(5)
    v = ["the", "Éclair", "of", "1234", "naïve", "\n\n", "###", "日本語", "<|endoftext|>", "xyzzy"]
    docs = [(d, " ".join(rng.choices(v, k=rng.choice([0, 1, 5, 30, 300, 2500])))) for d in range(300)]
    docs += [(900 + i, "the same text") for i in range(200)] + [(5, None), (5, None), (None, "no id")]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, length int")
    n, total = check(pack(frame).collect(), docs, reference, 1024)
    assert n <= -(-total // 1024) + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_json_file(text):
    import tokenizers

    files = default_files()
    global _pair
    if "_pair" not in globals():
        _pair = Tokenizer(*files), tokenizers.Tokenizer.from_file(files[0])
    assert _pair[0](text) == _pair[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_each_piece_once_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 101, 4000), rng.integers(30, 60, 5000), np.full(3000, 34), rng.integers(51, 101, 900), np.r_[np.full(500, 60), np.full(500, 40), np.full(900, 25)], np.minimum(100, rng.geometric(0.05, 8000))][seed]
    histogram = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True))}
    plan = solve(histogram, 100)
    used: dict = {}
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 100 and times > 0
        for n, k in pattern.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
    bins = sum(t for _, t in plan)
    assert bins <= best_fit(lengths.tolist(), 100)
    sizes, need = (np.array(x) for x in zip(*sorted(histogram.items())))
    assert relax(sizes, need.astype(float), 100, 500)[2] <= bins


def best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bins += room == capacity
        bisect.insort(rooms, room - n)
    return bins


def test_ids_are_the_json_tokenizers_over_the_corpus():
    """The rank file gives the named tokenizer's ids for every text of sf0.1, and for long runs of one kind."""
    import pyarrow.parquet as pq
    import tokenizers

    ours, named = Tokenizer(*default_files()), tokenizers.Tokenizer.from_file(default_files()[0])
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += ["a" * 50_000, " " * 50_000, "\n" * 9000 + "x", "é" * 20_000, "1" * 20_000, "日本語" * 5000, "à‍👩‍👩‍👧 \x00﻿�", "don't I'LL we've 'S", "x<|endoftext|>y"]
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        assert [ours(t) for t in part] == [e.ids for e in named.encode_batch_fast(part, add_special_tokens=False)]


def test_equal_rows_are_dealt_apart(spark):
    rows = [(7, "the same text in a third of all rows")] * 900 + [(None, "no id")] * 300 + [(k, "") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    deals = tokenized_pieces(docs.repartition(3)).select("deal").distinct().count()
    packed = pack(docs).collect()
    assert deals > 300 and len(packed) == len(rows)
    by = {}
    for p in packed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
