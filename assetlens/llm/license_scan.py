"""License scans: winnowed template fingerprints in an inverted index, then banded sequence alignment.

A template's k-gram hashes are winnowed and indexed. A document's hashes are looked up there; the hits of a
template are grouped by diagonal into candidate regions, and each region is aligned with the template within a band
around its diagonal. The result says how much of the template the document matches, and where.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Words of a hashed run, and runs of a winnowing window.
GRAM, WINDOW = 3, 3
#: Templates of up to SHORT words are indexed by every run of SHORT_GRAM words (or their only word), because of a
#: copy with a quarter of its words changed perhaps no longer run is left.
SHORT, SHORT_GRAM = 24, 2
#: Words by which an alignment may leave its diagonal.
BAND = 4
#: A match has this share of the template's words, or LEAST_WORDS of a longer template in one stretch.
LEAST_COVERAGE, LEAST_WORDS = 0.75, 25
#: What a word left out or put in costs in an alignment; a word matched gives 1. Of a match's span, DENSE are matched.
GAP, DENSE = 0.25, 0.6
#: Letters of a word that a run of a long template has, if it is indexed: a text without such words is not looked at.
LONG = 6
WORDS = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*").finditer

#: Notices by which texts state their license, and whole license texts, with the identifier they mean.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORDS(text)]


def winnow(ranks: list, window: int = WINDOW) -> set[int]:
    """Places of the kept runs: the last smallest of every window."""
    if len(ranks) < window:
        return set(range(len(ranks)))
    return {min(range(i, i + window), key=lambda j: (ranks[j], -j)) for i in range(len(ranks) - window + 1)}


def least_words(size: int) -> int:
    """Words that a match of a template of so many words has at least."""
    return min(-int(-LEAST_COVERAGE * size // 1), LEAST_WORDS)


class Index:
    """Inverted index: run of words -> (template, place); built from the templates alone."""

    def __init__(self, templates: dict[str, str]):
        self.words = {k: [w for w, *_ in tokens(t)] for k, t in sorted(templates.items())}
        self.post: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        triggers: set[str] = set()
        for name, words in self.words.items():
            gram = min(len(words), SHORT_GRAM if len(words) <= SHORT else GRAM)
            runs = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)] if words else []
            if gram == GRAM:
                kept = winnow([order_of(r) for r in runs])
                kept = {i for i in kept if max(map(len, runs[i])) >= LONG} or kept
                triggers.update(max(runs[i], key=len) for i in kept)
            else:
                kept = range(len(runs))
                # Of so many words of the template, any match has one at least.
                triggers.update(sorted(set(words), key=lambda w: (-len(w), w))[: len(words) - least_words(len(words)) + 1])
            for i in kept:
                self.post[runs[i]].append((name, i))
        self.sizes = sorted({len(r) for r in self.post})
        self.starts = {r[0] for r in self.post}
        #: A text without any of these has no match.
        self.triggers = sorted(triggers, key=lambda w: (-len(w), w))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, matched words, words, first character, end character) of every match, in order of place.

        Regions of one template that overlap are one match, the better one. Of different templates that overlap the
        one with more matched words stays, or the higher coverage; equals all stay, as the text doesn't tell them apart.
        """
        if not text:
            return []
        lowered = text.lower()
        if not any(w in lowered for w in self.triggers):
            return []
        found = tokens(text)
        words = [w for w, *_ in found]
        regions = defaultdict(set)
        for i, w in enumerate(words):
            if w in self.starts:
                for n in self.sizes:
                    for name, j in self.post.get(tuple(words[i : i + n]), ()):
                        regions[name].add(i - j)
        out = []
        for name, diagonals in regions.items():
            template = self.words[name]
            least, taken = least_words(len(template)), []
            for d in sorted(diagonals):
                # An alignment this near covers the diagonal, if it has found enough; else this one is tried too.
                if taken and d - taken[-1][0] <= BAND and taken[-1][1][0] >= least or not may_match(template, words, d, least):
                    continue
                taken.append((d, align(template, words, d)))
            best = []
            for matched, first, last in sorted((x for _, x in taken if x[0] >= max(least, DENSE * (x[2] - x[1] + 1))), key=lambda x: x[1]):
                if best and first <= best[-1][2]:
                    best[-1] = max(best[-1], (matched, first, last))
                else:
                    best.append((matched, first, last))
            out += [(name, m / len(template), m, len(template), found[a][1], found[b][2]) for m, a, b in best]
        return sorted(best_of_overlaps(out), key=lambda x: (x[4], -x[1], x[0]))


def best_of_overlaps(matches: list[tuple]) -> list[tuple]:
    """The matches that overlap no better one that stays."""
    out, chain, end = [], [], 0

    def settle() -> None:
        kept = []
        for m in sorted(chain, key=lambda m: (-m[2], -m[1], m[4])):
            if not any(k[4] < m[5] and m[4] < k[5] and (k[2], k[1]) > (m[2], m[1]) for k in kept):
                kept.append(m)
        out.extend(kept)
        chain.clear()

    for m in sorted(matches, key=lambda m: m[4]):
        if chain and m[4] >= end:
            settle()
        end = max(end, m[5]) if chain else m[5]
        chain.append(m)
    settle()
    return out


def order_of(run: tuple[str, ...]) -> tuple[bool, int]:
    """Rank of a run in its window: those with a long word first, then by a hash that is the same in every process."""
    return max(map(len, run)) < LONG, zlib.crc32(" ".join(run).encode())


def may_match(template: list[str], words: list[str], diagonal: int, least: int, band: int = BAND) -> bool:
    """Whether enough of the template's words stand anywhere in reach of the diagonal's band."""
    near = set(words[max(0, diagonal - band) : diagonal + len(template) + band])
    return sum(w in near for w in template) >= least


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """The best local alignment within the band around words[i + diagonal] = template[i]: how many words it matches, and
    the first and last of them. A match gives 1; a word of either side left out costs GAP, so that words far apart don't
    add up to a match."""
    cells = [(0.0, 0, -1, -1)] * (2 * band + 1)  # score, matched, first, last; cell b is word i + diagonal + b - band
    best = (0.0, 0, -1, -1)
    nothing = (0.0, 0, -1, -1)
    for i, t in enumerate(template):
        new = []
        for b in range(2 * band + 1):
            k = i + diagonal + b - band
            score, matched, first, _ = cells[b]
            if 0 <= k < len(words) and words[k] == t:
                here = (score + 1, matched + 1, k if first < 0 else first, k)
            else:
                here = (score - 2 * GAP, *cells[b][1:])  # both left out
            if b < 2 * band and cells[b + 1][0] - GAP > here[0]:  # a template word left out: the word is kept
                here = (cells[b + 1][0] - GAP, *cells[b + 1][1:])
            if new and new[-1][0] - GAP > here[0]:  # a word of the text left out
                here = (new[-1][0] - GAP, *new[-1][1:])
            new.append(here if here[0] > 0 else nothing)
            if new[-1][:2] > best[:2]:
                best = new[-1]
        cells = new
    return best[1:]


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and matches, an array of (template, coverage, matched, words, start, end).

    start and end are character places of the matched span in the original text. Whole texts are scanned. A null or
    empty text has no matches; no templates give no matches; rows are scanned one by one, repeated keys too; an empty
    table stays empty; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    @F.pandas_udf("array<struct<template:string,coverage:double,matched:int,words:int,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, fields = index_of(chosen), ("template", "coverage", "matched", "words", "start", "end")
        for batch in batches:
            yield pd.Series([[dict(zip(fields, m, strict=True)) for m in index.scan(t)] for t in batch], dtype=object)

    return docs.select(F.col(key).alias("doc_id"), scan(F.col(text)).alias("matches"))
