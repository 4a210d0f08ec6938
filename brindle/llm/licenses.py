"""License scans by an exact set-similarity join of template token sets with text blocks.

A block is a stretch of consecutive words of a document, twice as long as the template at most. It meets the template if it holds 0.8 of the
template's distinct tokens. Tokens are ordered by their frequency in all documents, rarest first. A template of n tokens of which `need`
must be met has a prefix of n - need + 1 tokens, one of which stands in every block that meets it: only the surroundings
of prefix tokens are looked at. There, a stretch of fewer words than need is left out (length), and so is one whose rarest
token of the template leaves fewer than need after it in that order (position). What is left is counted exactly, by a window
that slides over the places of the template's tokens. No block is missed, and no document is shuffled: the templates are a parameter, and
they and the counts of their tokens are all that reaches the driver or is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_bytes
from brindle.llm.decontam import words_of

# The phrases and labels of the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices as their licenses give them.
TEMPLATES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)

_REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, start: long, stop: long, share: double>>"


class Template:
    """A template's tokens in the order of their frequency, how many a block must hold, and how long a block may be."""

    def __init__(self, label: str, text: str, threshold: tuple[int, int], counts: dict[bytes, int]):
        words = words_of(text.encode())
        self.label, self.reach = label, 2 * len(words)
        self.tokens = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(self.tokens)}
        self.need = max(1, -(-threshold[0] * len(self.tokens) // threshold[1]))
        self.prefix = self.tokens[: len(self.tokens) - self.need + 1]

    def blocks(self, words: list[bytes], places: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, stop, tokens held) of the best block around each run of prefix tokens that are within reach of one another."""
        runs: list[list[int]] = []
        for i in places:
            low, high = max(0, i - self.reach + 1), min(len(words), i + self.reach)
            if runs and low < runs[-1][1]:
                runs[-1][1] = high
            else:
                runs.append([low, high])
        for low, high in runs:
            if high - low < self.need:
                continue
            at = [i for i in range(low, high) if words[i] in self.rank]
            if len(self.tokens) - min(self.rank[words[i]] for i in at) < self.need:
                continue
            best, held, start = (0, 0, 0), Counter(), 0
            for stop, i in enumerate(at):
                held[words[i]] += 1
                while i - at[start] >= self.reach:
                    gone = words[at[start]]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    start += 1
                if len(held) > best[0]:
                    best = len(held), at[start], i + 1
            if best[0] >= self.need:
                yield best[1], best[2], best[0]


def _counter(vocabulary: frozenset[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(filter(vocabulary.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return count


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, i, n = [], -1, len(phrase)
    try:
        while True:
            i = words.index(phrase[-1], i + 1)
            if i >= n - 1 and words[i - n + 1 : i + 1] == phrase:
                out.append(i - n + 1)
    except ValueError:
        return out


class Scanner:
    def __init__(self, phrases, templates: list[Template]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        self.templates = templates
        self.probe: dict[bytes, list[int]] = {}
        for k, t in enumerate(templates):
            for w in t.prefix:
                self.probe.setdefault(w, []).append(k)

    def __call__(self, text: bytes | None) -> tuple:
        words = words_of(text)
        base = [(i, label) for phrase, label in self.phrases for i in _places(words, phrase)]
        near: dict[int, list[int]] = {}
        if not self.probe.keys().isdisjoint(words):
            for i, w in enumerate(words):
                for k in self.probe.get(w, ()):
                    near.setdefault(k, []).append(i)
        blocks = [(t.label, a, b, n / len(t.tokens)) for k, t in enumerate(self.templates) if k in near for a, b, n in t.blocks(words, near[k])]
        own, starts = sorted({label for _, label in base}), [i for i, _ in base]
        labels = sorted({*own, *(b[0] for b in blocks)})
        score = 1.0 if base else max((b[3] for b in blocks), default=0.0)
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(labels), score, [dict(zip(("label", "start", "stop", "share"), b)) for b in sorted(blocks)]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: tuple[int, int] = (4, 5), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Base: places where a phrase's words stand one after another (n_base of them, first_word and last_word the least and the greatest start,
    null without any). labels adds those of templates of which a block holds threshold (a fraction) of the distinct tokens; blocks are
    the best such stretch of each run of surroundings, words from start to stop, with the share of tokens. score is 1 with a phrase,
    else the greatest share, else 0. A null or empty text has no words and no labels. Rows that repeat are reported each, a
    null doc_id stays null, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    templates = [(label, t) for label, t in templates if words_of(t.encode())]
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))
    counted = rows.select("text").mapInArrow(_counter(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in counted.collect()}
    scanner = spark.sparkContext.broadcast(Scanner(phrases, [Template(label, t, threshold, counts) for label, t in templates]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        for batch in batches:
            for a, b in by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                found = [scanner.value(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names)

    return rows.mapInArrow(work, _REPORT)
