"""License scans: winnowed template fingerprints pick candidates, banded alignment reports what matches."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.util import sliced, strings

# Notices by which works state their license, in their publishers' words.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD notice": "Released under the BSD License.",
    "CC0 notice": "Released under CC0 1.0 Universal.",
    "CC-BY notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LGPL-2.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE_END = 'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'
# Whole texts: the short ones here, the long ones in files.
TEMPLATES |= {
    "BSD-2-Clause full": f"{TEMPLATES['BSD']} {_BSD_END}",
    "BSD-3-Clause full": f"{TEMPLATES['BSD']} {_BSD_THIRD} {_BSD_END}",
    "ISC full": f"{TEMPLATES['ISC']} {_ISC_END}",
    "MIT full": f"{TEMPLATES['MIT']} {_MIT_END}",
    "Unlicense full": f"{TEMPLATES['Unlicense']} {_UNLICENSE_END}",
}
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}

#: Of a template of over 128 words, the share of its fingerprints that a text must hold to be aligned with it.
LEAST_HITS = 0.1
#: Words by which an alignment may reach beyond the outermost hits of its diagonal.
REACH = 128

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(_lowered(text))


def gram(of: list[int], at: int, k: int) -> int:
    """The hash of ``k`` words, by their numbers."""
    return xxhash.xxh64_intdigest(b"%d " * k % tuple(of[at : at + k]))


def winnow(hashes: list[int], window: int) -> set[int]:
    """Positions kept by winnowing: of each window of hashes the smallest, of equals the last."""
    if len(hashes) <= window:
        return {min(range(len(hashes)), key=lambda i: (hashes[i], -i))} if hashes else set()
    return {min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)}


class Index:
    """Templates as numbered words, and an inverted index from winnowed fingerprints to template and position."""

    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 2):
        self.names, self.k = list(templates), k
        texts = [words(t) for t in templates.values()]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.templates = [[self.vocabulary[w] for w in t] for t in texts]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.fingerprints = []
        for t, of in enumerate(self.templates):
            kept = winnow([gram(of, i, k) for i in range(len(of) - k + 1)], window)
            self.fingerprints.append(len(kept))
            for i in kept:
                self.postings[gram(of, i, k)].append((t, i))


def align(template: list[int], text: list[int | None], start: int, band: int) -> tuple[int, int, int, int, int, int] | None:
    """The best local alignment of a template around one diagonal: (score, matched words, first, end) in the text, (first, end) in the template.

    ``start`` is where the template's first word falls in the text; an
    alignment may stray ``band`` words from that diagonal. A match scores 1, a
    mismatch or a gap -1. Equal scores go to the one that ends first.
    """
    # of a row only the cells above 0: most words of a text have no match near the diagonal, and their rows are empty
    row: dict[int, tuple[int, int, tuple[int, int]]] = {}
    best = (0, 0, 0, 0, 0, 0)
    for i, word in enumerate(template):
        low = start + i - band
        window = text[max(low, 0) : max(low + 2 * band + 1, 0)]
        hits = {c for c, w in enumerate(window, max(low, 0) - low) if w == word} if word in window else ()
        if not row and not hits:
            continue
        new: dict[int, tuple[int, int, tuple[int, int]]] = {}
        edge = len(text) - low
        for c in sorted({*hits, *row, *(c - 1 for c in row)}):
            while True:
                if 0 <= c <= 2 * band and 0 <= low + c and c < edge:
                    same = c in hits
                    score, matched, begun = row.get(c, (0, 0, None))
                    top = (score + (1 if same else -1), matched + same, begun or (low + c, i))
                    if c + 1 in row and (row[c + 1][0] - 1, row[c + 1][1]) > top[:2]:
                        top = (row[c + 1][0] - 1, *row[c + 1][1:])
                    if c - 1 in new and (new[c - 1][0] - 1, new[c - 1][1]) > top[:2]:
                        top = (new[c - 1][0] - 1, *new[c - 1][1:])
                    if top[0] > 0:
                        new[c] = top
                        if top[0] > best[0]:
                            best = (top[0], top[1], top[2][0], low + c + 1, top[2][1], i + 1)
                # a gap may go on to the right of what is looked at anyway
                if c not in new or new[c][0] < 2 or c + 1 > 2 * band or c + 1 in row or c + 1 in hits or c + 2 in row:
                    break
                c += 1
        row = new
    return best if best[0] else None


def scan(text: str, index: Index, least_coverage: float = 0.6, band: int = 8) -> list[dict]:
    """Licenses found in a text, by start: ``license``, ``coverage``, ``matched``, ``start``, ``stop`` (code points).

    Words in a row that make one of a template's fingerprints are a hit. Hits
    whose diagonals lie close together are aligned together, within a band
    (a quarter of the template at most) around the most frequent of them.
    Alignments that follow each other in the text and in the template are one
    match, whatever stands between them, up to as many words as the template has.
    ``coverage`` is the share of the template's words that match. Of matches that overlap,
    the one with the highest alignment score stays, then the better covered.
    """
    k = index.k
    found_words = list(WORD.finditer(_lowered(text)))
    numbers = [index.vocabulary.get(m[0]) for m in found_words]
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    known = 0
    for at, n in enumerate(numbers):
        known = known + 1 if n is not None else 0
        if known >= k:
            for t, i in index.postings.get(gram(numbers, at - k + 1, k), ()):
                hits[t].append((at - k + 1, i))
    found = []
    for t, own in hits.items():
        template = index.templates[t]
        if len(template) > 128 and len({i for _, i in own}) < LEAST_HITS * index.fingerprints[t]:
            continue
        near = max(1, min(band, len(template) // 4))
        for score, matched, first, end in _chains(_pieces(template, numbers, own, near), near, len(template)):
            if matched / len(template) >= least_coverage:
                found.append((-score, -matched / len(template), t, matched, first, end))
    kept: list[tuple] = []  # by place, so that only its neighbours can overlap a match
    for f in sorted(set(found)):
        at = bisect_left(kept, f[4], key=lambda o: o[4])
        if (not at or kept[at - 1][5] <= f[4]) and (at == len(kept) or f[5] <= kept[at][4]):
            kept.insert(at, f)
    if not kept:
        return []
    spans = [m.span() for m in found_words]
    out = [{"license": index.names[t], "coverage": -c, "matched": m, "start": spans[a][0], "stop": spans[b - 1][1]} for _, c, t, m, a, b in kept]
    return sorted(out, key=lambda d: d["start"])


def _lowered(text: str) -> str:
    """Lower case of the same length, so that positions stay true."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _diagonals(hits: list[tuple[int, int]], band: int) -> list[int]:
    """Where templates may start, one for each cluster of hits (text position, template position)."""
    starts, out, near = Counter(at - i for at, i in hits), [], []
    for start, _ in starts.most_common():
        k = bisect_left(near, start - band)
        if k == len(near) or near[k] > start + band:
            near.insert(k, start)
            out.append(start)
    return out


def _pieces(template: list[int], text: list[int | None], hits: list[tuple[int, int]], band: int) -> list[tuple]:
    """Local alignments of a template, as ``align`` gives them, that hold all hits: by diagonal, and on both sides of what was found on it."""
    out, taken, on = [], set(), defaultdict(list)
    for at, i in hits:
        on[at - i].append((i, at))
    for start in _diagonals(hits, band):
        own = sorted(h for d in range(start - band, start + band + 1) for h in on.get(d, ()))
        todo = [(0, len(template))]
        while todo:
            low, high = todo.pop()
            inside = [i for i, at in own if low <= i < high and at not in taken]
            if not inside:
                continue
            low, high = max(low, inside[0] - REACH), min(high, inside[-1] + REACH)
            piece = align(template[low:high], text, start + low, band)
            if not piece:
                continue
            out.append((*piece[:4], piece[4] + low, piece[5] + low))
            taken.update(range(piece[2], piece[3]))
            todo += [(low, piece[4] + low), (piece[5] + low, high)]
    return out


def _chains(pieces: list[tuple], band: int, reach: int) -> list[tuple[int, int, int, int]]:
    """Pieces joined where one follows another in text and template, ``reach`` words of text between them at most: (score, matched, first, end).

    Words between two pieces cost 1 each, ``band`` at most; words that both hold count once.
    """
    order = sorted(set(pieces), key=lambda p: (p[2], p[3], p[4]))
    best: list[tuple] = []
    for at, (score, matched, first, end, begin, stop) in enumerate(order):
        top = (score, matched, first, -1)
        for j in range(at - 1, -1, -1):
            before = order[j]
            if first - before[2] > 2 * reach + band:
                break
            both = max(0, before[3] - first, before[5] - begin)
            gap = first - before[3]
            if gap > reach or both > min(score, before[0]) // 2 or before[4] >= begin or before[5] >= stop or before[3] >= end:
                continue
            joined = best[j][0] + score - both - max(0, min(gap, band))
            if joined > max(top[0], best[j][0]):
                top = (joined, best[j][1] + matched - both, best[j][2], j)
        best.append(top)
    out, used = [], set()
    for at in sorted(range(len(order)), key=lambda i: (-best[i][0], i)):
        path, j = [], at
        while j >= 0 and j not in used:
            path.append(j)
            j = best[j][3]
        if path and j < 0:
            out.append((best[at][0], best[at][1], best[at][2], order[at][3]))
            used.update(path)
        elif path:  # what it would follow belongs to a better chain
            out += [(order[i][0], order[i][1], order[i][2], order[i][3]) for i in path]
            used.update(path)
    return out


SCHEMA = "array<struct<license:string,coverage:double,matched:int,start:int,stop:int>>"


def with_licenses(docs: DataFrame, text_col: str = "text", name: str = "licenses", templates: dict[str, str] = TEMPLATES, least_coverage: float = 0.6) -> DataFrame:
    """All columns of ``docs`` and the licenses found in the whole text, an empty list where there is none.

    Null and empty texts have none; repeated rows stay repeated; an empty table
    stays empty; a column ``name`` is replaced. A template appears once for each place.
    The index, of bounded templates, goes to the tasks; documents aren't shuffled.
    """
    docs = docs.drop(name)
    at, kind = docs.columns.index(text_col), T._parse_datatype_string(SCHEMA)
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in sliced(batches):
            found = [scan(t, sent.value, least_coverage) for t in strings(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, to_arrow_type(kind))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
