"""License scan by patience alignment of license notices with whole texts.

A region of a text is aligned with a template on words that are unique to both; the longest increasing
run of those anchors stays, and the gaps between anchors are aligned in the same way, down to gaps
without anchors, whose longest common subsequence is taken. The share of the template's words that are aligned
is its coverage. Regions are the stretches of a text that hold enough of a template's words at all, so
no text is too long, and notices that occur several times are each found.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.common import table

# License notices as they are commonly published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "GPL-2.0-or-later-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 "
        "Universal Public Domain Dedication."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
#: Share of a template's words that must be aligned; a region spans at most so many times the template's words.
COVERAGE, SPREAD = 0.8, 1.6
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by their first number, that rises in the second (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect.bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
        before.append(piles[at - 1] if at else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence: the longest rising run of the places where the lists agree, each a's from the last."""
    at: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        at.setdefault(b[j], []).append(j)
    return _increasing([(i, j) for i, w in enumerate(a) for j in at.get(w, ())])


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        anchors = _increasing([(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in at_b])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _regions(words: list[str], need: Counter, total: int, coverage: float, spread: float) -> list[tuple[int, int]]:
    """Stretches of words, merged where they overlap, of at most spread * total words that hold coverage of the template's words."""
    hits = [i for i, w in enumerate(words) if w in need]
    span, have, got, first, out = int(spread * total) + 1, Counter(), 0, 0, []
    for i in hits:
        w = words[i]
        have[w] += 1
        got += have[w] <= need[w]
        while i - hits[first] >= span:
            v = words[hits[first]]
            got -= have[v] <= need[v]
            have[v] -= 1
            first += 1
        if got >= coverage * total:
            if out and hits[first] < out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((hits[first], i + 1))
    return out


def scan_text(text: str, templates: dict[str, list[str]], coverage: float = COVERAGE, spread: float = SPREAD) -> list[tuple]:
    """(license, coverage, start, end, words) of each notice found in text; offsets in code points."""
    words = words_of(text)
    present, out, at = set(words), [], None
    for name, template in templates.items():
        need = Counter(template)
        if sum(n for w, n in need.items() if w in present) < coverage * len(template):
            continue
        for a0, a1 in _regions(words, need, len(template), coverage, spread):
            while a0 < a1:
                end = min(a1, a0 + int(spread * len(template)) + 1)
                aligned = patience(words[a0:end], template)
                if len(aligned) < coverage * len(template):
                    # No alignment is longer than the longest common subsequence, which gains at most one word a step.
                    missing = coverage * len(template) - len(_common(words[a0:end], template))
                    a0 += max(1, math.ceil(missing))
                    continue
                at = at or [m.span() for m in _WORD.finditer(text)]
                out.append((name, len(aligned) / len(template), at[a0 + aligned[0][0]][0], at[a0 + aligned[-1][0]][1], len(aligned)))
                a0 += aligned[-1][0] + 1
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per notice found: id_col, license, coverage, start, end, words, in whole texts.

    Null and empty texts, and an empty table, give no rows; repeated rows give repeated rows. A text that
    fits several templates has a row for each. Ids are integers. Other columns are not read.
    """
    known = {k: words_of(v) for k, v in (templates or TEMPLATES).items()}

    def run(batches):
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for hit in scan_text(t, known, coverage)]
            if rows:
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "license", "coverage", "start", "end", "words"])

    schema = "doc long, license string, coverage double, start long, end long, words long"
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def op8_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
