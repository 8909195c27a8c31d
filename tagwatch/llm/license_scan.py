"""License scans by winnowed fingerprints and banded alignment.

Templates are split into words; of every window of W word K-grams the least
hash is kept (Schleimer et al. 2003), in an inverted index from fingerprint to
template positions.  Any K + W - 1 words that a text shares with a template
hold a common fingerprint.  The diagonals of a text's hits pick candidate
regions, and a local alignment within a band around them counts the matched
words.  The index is as large as the templates, which ship with the program;
the documents are only mapped over.

Defined results: a null or empty text has no words and no rows; repeated
documents are each reported; overlapping reports of different templates all
stay; spans are word positions, the end excluded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagwatch.llm.decontamination import runs_of
from tagwatch.llm.scratch import as_binary, blocks, map_arrow
from tagwatch.llm.words import alnum_words, mixed

K, W = 3, 3
#: Share of a template's words that must match.
COVERAGE = 0.8

# Notices as their licenses word them: fixed values.
TEMPLATES = {
    "Apache-2.0 reference": "Licensed under the Apache License, Version 2.0",
    "MIT reference": "Released under the MIT License",
    "GPL-3.0 reference": "licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0 reference": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 reference": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT disclaimer": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "BSD disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
}


def grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of the K-grams of word ids."""
    n = max(0, len(ids) - K + 1)
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    return mixed(value)


def winnowed(ids: np.ndarray) -> list[tuple[int, int]]:
    """(hash, position) of the rightmost least K-gram of each window; of all, where there are fewer than W."""
    values = grams(ids).tolist()
    if not values:
        return []
    kept = {}
    for at in range(max(1, len(values) - W + 1)):
        window = values[at : at + W]
        least = min(window)
        kept[at + len(window) - 1 - window[::-1].index(least)] = least
    return [(h, at) for at, h in kept.items()]


class Index:
    def __init__(self, templates: Mapping[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.templates: list[tuple[str, list[int]]] = []
        self.places: dict[int, list[tuple[int, int]]] = {}
        for name, text in templates.items():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text.encode())]
            self.templates.append((name, ids))
            for value, at in winnowed(np.array(ids, np.int64)):
                self.places.setdefault(value, []).append((len(self.templates) - 1, at))

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, lowest and highest diagonal) of groups of nearby hits; a diagonal is where the template would start."""
        hits: dict[int, list[int]] = {}
        for start, end in zip(*(x.tolist() for x in runs_of(ids, K)), strict=True):
            for value, at in winnowed(ids[start:end]):
                for template, place in self.places.get(value, ()):
                    hits.setdefault(template, []).append(start + at - place)
        for template, diagonals in hits.items():
            band = band_of(len(self.templates[template][1]))
            diagonals.sort()
            low = high = diagonals[0]
            for d in diagonals[1:]:
                if d - high > band:
                    yield template, low, high
                    low = d
                high = d
            yield template, low, high


def band_of(words: int) -> int:
    """Insertions or deletions that an alignment may have."""
    return max(2, words // 5)


def align(template: list[int], text: list[int], low: int, high: int, band: int) -> tuple[int, int, int]:
    """Matched words, start and end of the best local alignment near diagonals low to high.

    A match counts 1, a mismatch or gap -1; of equal scores the first end is taken.
    """
    none = (0, 0, -1, 0)
    best = (0, 0, 0, 0)
    row: dict[int, tuple[int, int, int, int]] = {}
    for i, word in enumerate(template):
        new: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + low - band), min(len(text), i + high + band + 1)):
            score, matched, start, _ = row.get(j - 1, none)
            if text[j] == word:
                cell = (score + 1, matched + 1, j if start < 0 else start, j + 1)
            else:
                cell = (score - 1, matched, start, j + 1)
            for score, matched, start, end in (row.get(j, none), new.get(j - 1, none)):
                if score - 1 > cell[0]:
                    cell = (score - 1, matched, start, end)
            if cell[0] > 0:
                new[j] = cell
                if cell[0] > best[0] and text[j] == word:
                    best = cell
        row = new
    return best[1], best[2], best[3]


def scan_words(ids: np.ndarray, index: Index, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(template, start, end, matched, coverage) of a text's word ids, in order."""
    found = set()
    text: list[int] | None = None
    for template, low, high in index.candidates(ids):
        text = ids.tolist() if text is None else text
        name, words = index.templates[template]
        matched, start, end = align(words, text, low, high, band_of(len(words)))
        if matched >= coverage * len(words):
            found.add((name, start, end, matched, matched / len(words)))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, span in words, matched words and coverage of the template."""
    index = Index(templates)
    schema = "doc_id long, license string, start long, end long, n_matched long, coverage double"
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocabulary.get
        for batch in blocks(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), strict=True):
                words = alnum_words(text)
                ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                rows += [(doc_id, *x) for x in scan_words(ids, index, coverage)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_arrow(docs.select("doc_id", "text"), kernel, schema)
