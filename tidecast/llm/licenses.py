"""Operator 6: license scans by winnowed fingerprints, an inverted index and banded alignment.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Of each template, of every ``WINDOW`` neighbouring runs of
``GRAM`` words the one with the least hash (the last of equals) goes into an inverted index; a text that has ``WINDOW + GRAM - 1`` = 5 of a template's words
in a row is sure to meet the index. The runs of a document that are in it name its candidates: a template and a diagonal (place in the document less
place in the template). Around groups of diagonals the template is aligned with the document in a band of ``BAND`` words to
either side: the longest common subsequence within the band, of those the one that spans least. Coverage is the share of the template's words that are matched;
``COVERAGE`` or more is a finding. Of findings that overlap, the one with more matched words stays, of equals the
shorter template, then the shorter span, then the first license by name.

Templates are few and bounded (``TEMPLATES_CHARS`` characters), so their index is broadcast; documents are passed once, whole, without a shuffle. Results: a row
for each finding, spans in code points. Null and empty texts have none; repeated rows repeat theirs; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm._shared import byte_codes, byte_pieces, ngram_hashes, span_hashes, word_spans

GRAM, WINDOW = 3, 3
BAND = 8
COVERAGE = 0.8
TEMPLATES_CHARS = 5_000_000

# Well-known license statements, license: texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CODES = byte_codes(fold=True)
_SIEVE = (1 << 20) - 1


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window, of equals the last."""
    if len(hashes) == 0:
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def align(template: np.ndarray, document: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Matched words of the longest common subsequence within the band around a diagonal, and its first and last word in the document (-1: none)."""
    width = 2 * BAND + 1
    none = (0, -1, -1)
    above = [none] * (width + 1)  # cell k: document place row + diagonal - BAND + k
    best = none
    for row in range(len(template)):
        here, left = [], none
        word = template[row]
        for k in range(width):
            at = row + diagonal - BAND + k
            value = max(left, above[k + 1], key=lambda c: c[:2])  # of as many matches the one that begins last
            if 0 <= at < len(document) and document[at] == word:
                before = above[k]
                taken = (before[0] + 1, at if before[1] < 0 else before[1], at)
                if taken[:2] > value[:2]:
                    value = taken
            here.append(value)
            left = value
            if value[0] > best[0] or (value[0] == best[0] > 0 and value[2] - value[1] < best[2] - best[1]):
                best = value
        above = [*here, none]
    return best


class Index:
    def __init__(self, templates: dict[str, list[str]]):
        if sum(len(t) for ts in templates.values() for t in ts) > TEMPLATES_CHARS:
            raise ValueError("the templates are more than the index is made for; scan with parts of them")
        self.names = [(name, k) for name in sorted(templates) for k in range(len(templates[name]))]
        self.words: list[np.ndarray] = []
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        texts = [templates[name][k] for name, k in self.names]
        for first, end, data, offsets in byte_pieces(pa.array(texts, pa.string())):
            starts, ends, docs = word_spans(data, offsets, _BREAK)
            words = span_hashes(data, starts, ends, _CODES)
            for k in range(end - first):
                own = words[docs == k]
                self.words.append(own)
                grams, at = ngram_hashes(own, np.zeros(len(own), np.int64), GRAM)
                for p in winnow(grams, WINDOW):
                    self.posts[int(grams[p])].append((first + k, int(at[p])))
        self.sieve = np.zeros(_SIEVE + 1, bool)
        for h in self.posts:
            self.sieve[h & _SIEVE] = True

    def find(self, words: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, matched, first word, last word) in one document; ``hits``: (place, hash)."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for place, h in hits:
            for t, at in self.posts.get(h, ()):
                diagonals[t].add(place - at)
        found = []
        for t, some in diagonals.items():
            template, centre = self.words[t], None
            for d in sorted(some):
                if centre is not None and d - centre <= BAND:
                    continue
                centre = d + BAND // 2  # the band reaches from the group's first diagonal to those after it
                lo = max(0, centre - BAND)
                part = words[lo : centre + BAND + len(template) + 1]
                matched, first, last = align(template, part, centre - lo)
                if matched >= COVERAGE * len(template):
                    found.append((t, matched, first + lo, last + lo))
        out: list[tuple[int, int, int, int]] = []
        for f in sorted(found, key=lambda f: (-f[1], len(self.words[f[0]]), f[3] - f[2], f[0], f[2])):
            if all(f[3] < g[2] or g[3] < f[2] for g in out):
                out.append(f)
        return sorted(out, key=lambda f: f[2])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, template, coverage, matched, start, end."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    names = ["doc_id", "license", "template", "coverage", "matched", "start", "end"]
    types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = []
            for first, end, data, offsets in byte_pieces(b.column(1)):
                starts, ends, docs_of = word_spans(data, offsets, _BREAK)
                words = span_hashes(data, starts, ends, _CODES)
                grams, at = ngram_hashes(words, docs_of, GRAM)
                hit = np.flatnonzero(index.sieve[(grams & np.uint64(_SIEVE)).astype(np.int64)])
                hit = hit[[int(g) in index.posts for g in grams[hit].tolist()]] if len(hit) else hit
                cut = np.searchsorted(docs_of, np.arange(end - first + 1))
                by_doc: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for h in hit.tolist():
                    k = int(docs_of[at[h]])
                    by_doc[k].append((int(at[h] - cut[k]), int(grams[h])))
                for k, hits in by_doc.items():
                    for t, matched, lo, hi in index.find(words[cut[k] : cut[k + 1]], hits):
                        text = data[offsets[k] : offsets[k + 1]]
                        count = lambda p, text=text: int(((text[:p] & 0xC0) != 0x80).sum())
                        s, e = (int(x) - int(offsets[k]) for x in (starts[cut[k] + lo], ends[cut[k] + hi]))
                        rows.append((first + k, *index.names[t], matched / len(index.words[t]), matched, count(s), count(e)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types))], names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, license string, template int, coverage double, matched long, start long, `end` long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
