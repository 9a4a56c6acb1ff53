"""License scans: patience alignment of texts with license templates.

A stretch of a document can only cover a template if enough of its words occur in the template; running
counts of such words show these stretches without any alignment, for all templates at once. In each
stretch, words that are unique in both it and the template are anchors; the longest increasing
subsequence of anchors is kept, and the gaps between them are aligned the same way again. Coverage
is the share of the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.words import WORD_CHARS, hash_words, slices, text_words, utf8, words
from patternloom.session import ship

COVERAGE = 0.8
STRETCH = 1.25  # words of a stretch for one of the template

#: Notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        ' writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
        " either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in"
        " the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        ' "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []  # place of each pile's top
    back = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[pile], piles[pile] = v, k
        back[k] = piles[pile - 1] if pile else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text, template) places in order."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(text[a:b], a) if w in place]
        kept = [anchors[k] for k in increasing([t for _, t in anchors])]
        out += kept
        if kept:
            for (p, q), (r, s) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Library:
    """Templates as numbers of their words, and which words each holds."""

    def __init__(self, templates: Mapping[str, str]):
        vocabulary: dict[bytes, int] = {}
        listed = {n: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in text_words(t, WORD_CHARS)] for n, t in sorted(templates.items())}
        self.templates = {n: w for n, w in listed.items() if w}
        hashes = hash_words(list(vocabulary))
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.holds = {n: np.isin(np.arange(len(vocabulary) + 1), w) for n, w in self.templates.items()}

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashed), np.int64)
        near = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[near] == hashed, self.by_hash[near] + 1, 0)

    def scan(self, numbers: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, str, float, int, int]]:
        """(document, template, coverage, first word, last word + 1); ``first`` is where each document's words begin."""
        for name, template in self.templates.items():
            need = int(np.ceil(coverage * len(template) - 1e-9))
            wide = max(len(template), int(np.ceil(STRETCH * len(template))))
            held = self.holds[name][numbers]
            total = np.concatenate(([0], np.cumsum(held)))
            at = np.flatnonzero(held)
            doc = np.searchsorted(first, at, side="right") - 1
            end = np.minimum(at + wide, first[doc + 1])
            count = total[end] - total[at]
            likely = np.flatnonzero(count >= need)
            upto = -1
            # The stretches of a document from left to right; one that covers the template ends before the next begins.
            for k in likely:
                if at[k] < upto:
                    continue
                pairs = align(numbers[at[k] : end[k]].tolist(), template)
                if len(pairs) >= need:
                    upto = int(at[k]) + pairs[-1][0] + 1
                    begin = first[doc[k]]
                    yield int(doc[k]), name, len(pairs) / len(template), int(at[k] + pairs[0][0] - begin), int(upto - begin)


def _scan(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = shared.value
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                starts, _, hashed = words(buf[offsets[lo] : offsets[hi]], own, WORD_CHARS)
                first = np.searchsorted(starts, own)
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for doc, name, share, a, b in library.scan(library.numbers(hashed), first, coverage):
                    found[doc].append({"license": name, "coverage": share, "start": a, "end": b})
                for f in found:
                    f.sort(key=lambda x: (x["start"], x["license"]))
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column("id").slice(lo, hi - lo), "n_words": pa.array(np.diff(first), pa.int64()), "licenses": pa.array(found, FOUND_ARROW)}
                )

    return run


FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words and ``licenses``, every stretch that covers a template.

    A stretch is at most ``STRETCH`` times as long as its template and is given by words, end exclusive, with
    the share of the template that is aligned, at least ``coverage``. Words are lowered in A-Z. Null and
    empty texts have none. Repeated rows are scanned one by one; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Library(templates))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("licenses", T._parse_datatype_string(FOUND))])
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(shared, coverage), schema)
    return found.select(F.col("id").alias(id_col), "n_words", "licenses")
