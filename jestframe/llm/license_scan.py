"""Operator 2: license scan by winnowed fingerprints and banded alignment.

Templates and documents are sequences of lower-cased words.  Every template's
GRAM-word grams are hashed and winnowed (the smallest hash of each run of RUN
grams), into an inverted index fingerprint -> (template, position).  All grams
of a whole document are looked up in it, so a shared run of GRAM + RUN - 1 words
is never missed; hits of a template on nearby diagonals make a candidate, which
a banded local alignment (up to BAND words to either side) turns into a span with its
matched words.  ``coverage`` is matched words / words of the template, and a span is
``complete`` from COMPLETE on.  Spans of LEAST_SPAN matched words or more are
reported whatever their coverage, shorter ones if they are complete.  Of
overlapping spans the one with more matched words stays (then more coverage,
then the template's name), so of two licences that share most words the one whose own
words are there is named.

The templates are a bounded parameter, sent to the workers; documents are
neither shuffled nor collected.  Defined results: null and empty texts have no
spans; every row is scanned, so repeated rows each report; an empty table or an
empty template list gives an empty result; kept columns with the names of the
operator's give way to them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jestframe.llm.common import free_name, others

GRAM, RUN = 3, 2
BAND = 8
COMPLETE = 0.8
LEAST_MATCHED = 4
LEAST_SPAN = 20
WORD = re.compile(r"[^\W_]+")

# Notices of public licences.
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + BSD_DISCLAIMER,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def gram_hashes(words: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(" ".join(g)) for g in zip(*(words[k:] for k in range(GRAM)), strict=False)]


def winnowed(hashes: list[int]) -> set[int]:
    """Positions of the smallest hash (the last of equals) of each run of RUN grams."""
    if not hashes:
        return set()
    runs = range(max(1, len(hashes) - RUN + 1))
    return {min(range(i, min(i + RUN, len(hashes))), key=lambda j: (hashes[j], -j)) for i in runs}


def band_of(size: int) -> int:
    """Words a template of ``size`` words may shift within a span."""
    return min(BAND, max(1, size // 4))


def aligned(template: list[str], words: list[str], start: int, stop: int, diagonal: int) -> tuple[int, int, int]:
    """(matched words, first, last word matched) of the best local alignment of
    the template with words[start:stop] near the diagonal (document position
    less template position): match 2, replaced, left out or inserted word -1."""
    best, before, band = (0, 0, 0, 0), {}, band_of(len(template))
    for i in range(start, stop):
        row = {}
        for j in range(max(0, i - diagonal - band), min(len(template), i - diagonal + band + 1)):
            score, matched, first, last = before.get(j - 1, (0, 0, i, i))
            if words[i] == template[j]:
                cell = (score + 2, matched + 1, first if matched else i, i)
            else:
                cell = (score - 1, matched, first, last)
            for s, m, f, l in filter(None, (before.get(j), row.get(j - 1))):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, f, l)
            row[j] = cell if cell[0] > 0 else (0, 0, i, i)
            if row[j][:2] > best[:2]:
                best = row[j]
        before = row
    return best[1:]


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.templates = {name: [w.lower() for w in WORD.findall(text)] for name, text in templates.items()}
        self.index: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.grams: dict[tuple[str, ...], int] = {}  # the indexed grams' words, so that documents need no hashing
        for name, words in self.templates.items():
            hashes = gram_hashes(words)
            for at in winnowed(hashes):
                self.index[hashes[at]].append((name, at))
                self.grams[tuple(words[at:at + GRAM])] = hashes[at]
        self.first = {g[0] for g in self.grams}

    def spans(self, text: str | None, complete: float, least_span: int) -> list[dict]:
        """Non-overlapping spans, in document order."""
        if not text:
            return []
        words = [w.lower() for w in WORD.findall(text)]  # words of the text itself: places stay places in it
        if self.first.isdisjoint(words):
            return []
        hits = defaultdict(list)  # template -> (diagonal, document position)
        for at, gram in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if gram in self.grams:
                for name, place in self.index[self.grams[gram]]:
                    hits[name].append((at - place, at))
        found = []
        for name, own in hits.items():
            own.sort(key=lambda h: (h[1], h[0]))
            size = len(self.templates[name])
            band = band_of(size)
            groups: list[list[tuple[int, int]]] = []
            for diagonal, at in own:
                group = next((g for g in reversed(groups[-4:]) if abs(g[-1][0] - diagonal) <= band and at - g[0][1] <= size + band), None)
                if group is None:
                    groups.append([(diagonal, at)])
                else:
                    group.append((diagonal, at))
            for group in groups:
                diagonal = sorted(d for d, _ in group)[len(group) // 2]
                matched, first, last = aligned(self.templates[name], words, max(0, diagonal - band), min(len(words), diagonal + size + band), diagonal)
                if matched >= min(LEAST_MATCHED, size) and (matched >= complete * size or matched >= least_span):
                    found.append((matched, matched / size, name, first, last))
        found.sort(key=lambda f: (-f[0], -f[1], f[2], f[3]))
        kept: list[tuple] = []
        for f in found:
            if all(f[4] < k[3] or f[3] > k[4] for k in kept):
                kept.append(f)
        if not kept:
            return []
        offsets = [m.span() for m in WORD.finditer(text)]
        return [{"license": name, "coverage": coverage, "complete": coverage >= complete, "matched_words": matched, "first_word": first, "last_word": last, "span_start": offsets[first][0], "span_end": offsets[last][1]}
                for matched, coverage, name, first, last in sorted(kept, key=lambda k: k[3])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, text_col: str = "text", keep: list[str], complete: float = COMPLETE, least_span: int = LEAST_SPAN) -> DataFrame:
    """The columns ``keep`` with license, coverage, complete, matched_words,
    first_word, last_word and the span in characters of the text, a row per span."""
    templates = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)
    fields = [("license", pa.string()), ("coverage", pa.float64()), ("complete", pa.bool_()), *((n, pa.int64()) for n in ("matched_words", "first_word", "last_word", "span_start", "span_end"))]
    keep = others(keep, [n for n, _ in fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates.value)
        for batch in batches:
            rows, spans = [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                own = index.spans(text, complete, least_span)
                rows += [i] * len(own)
                spans += own
            kept = batch.take(pa.array(rows, pa.int64())).columns[:len(keep)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([s[n] for s in spans], t) for n, t in fields)], names=[*keep, *(n for n, _ in fields)])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).alias(free_name(docs, "text_"))).mapInArrow(
        search, f"{schema}license string, coverage double, complete boolean, matched_words long, first_word long, last_word long, span_start long, span_end long")
