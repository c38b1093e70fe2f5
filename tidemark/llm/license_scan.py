"""License scans by patience alignment.

A text's words are aligned with each template's: words that occur once in both are anchors, the longest
increasing subsequence of their places is kept, and the gaps between are aligned in the same way (a
gap without anchors by its equal ends). Coverage is the share of words aligned, of the template's
words and half of those that the text has between them.

A template has required phrases, which tell its licence from its siblings: a match must hold them word
by word. A match lies within SPAN times the template's length. Places that may hold one are those where so many words
in a row have at least COVERAGE of the template's length among them; only these are aligned, so whole
texts are read but few aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

COVERAGE, SPAN = 0.8, 1.5
#: Words of a notice that a word before it can deny.
SHORT = 12


class Template(NamedTuple):
    """A licence's wording and the phrases (as lower-case words) that a match must hold."""

    license: str
    text: str
    required: tuple[str, ...]


# Names and wordings of public licences.
GNU = {"gpl": ("GNU General Public License", ("1", "2", "3")), "lgpl": ("GNU Lesser General Public License", ("2.1", "3")), "agpl": ("GNU Affero General Public License", ("3",))}
CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
NAMED = {"mit": "MIT License", "bsd": "BSD License", "isc": "ISC License", "zlib": "zlib License", "bsl-1.0": "Boost Software License", "unlicense": "Unlicense", "artistic-2.0": "Artistic License 2.0", "epl-2.0": "Eclipse Public License 2.0", "apache-2.0": "Apache License, Version 2.0", "apache-1.1": "Apache License, Version 1.1", "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License", "mpl-2.0": "Mozilla Public License, v. 2.0", "mpl-1.1": "Mozilla Public License, v. 1.1"}
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS = {
    "apache-2.0-header": Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license version 2 0",)),
    "bsd-2-clause-text": Template("bsd-2-clause", f"{_REDISTRIBUTION} {_AS_IS}", ("source and binary forms",)),
    "bsd-3-clause-text": Template("bsd-3-clause", f"{_REDISTRIBUTION} {_ENDORSE} {_AS_IS}", ("source and binary forms", "to endorse or promote products")),
    "bsd-grant": Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    "gpl-3.0-header": Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "version 3")),
    "gpl-2.0-header": Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license", "version 2")),
    "agpl-3.0-header": Template("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu affero general public license", "version 3")),
    "isc-text": Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("without fee",)),
    "mit-text": Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("hereby granted",)),
    "mit-grant": Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("hereby granted",)),
    "unlicense-text": Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("public domain",)),
}
# The heads of licences, the standard notices of others, and names in tags.
HEADS = {
    "gpl-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu general public license version 3 29 june 2007",)),
    "gpl-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("gnu general public license version 2 june 1991",)),
    "lgpl-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu lesser general public license version 3",)),
    "lgpl-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", ("gnu lesser general public license version 2 1",)),
    "agpl-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ("gnu affero general public license version 3",)),
    "apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("apache license version 2 0 january 2004",)),
    "mpl-2.0": ("Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\"", ("mozilla public license version 2 0",)),
    "eupl-1.2": ("EUROPEAN UNION PUBLIC LICENCE v. 1.2 EUPL © the European Union 2007, 2016", ("european union public licence v 1 2",)),
    "cc0-1.0": ("CC0 1.0 Universal", ("cc0 1 0 universal",)),
}
NOTICES = {
    "lgpl-2.1-header": Template("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license", "version 2 1")),
    "lgpl-3.0-header": Template("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", ("gnu lesser general public license", "version 3")),
    "mpl-2.0-header": Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license v 2 0",)),
    "cc0-1.0-waiver": Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    "eupl-1.2-name": Template("eupl-1.2", "Licensed under the EUPL, Version 1.2", ("eupl version 1 2",)),
    "eupl-1.2-short": Template("eupl-1.2", "Licensed under the EUPL", ("the eupl",)),
}
TAGS = ("MIT", "ISC", "Zlib", "BSL-1.0", "Unlicense", "Artistic-2.0", "EPL-2.0", "EUPL-1.2", "MPL-2.0", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def named_templates() -> dict[str, Template]:
    """Short notices: how texts name each licence and, by its version, its siblings."""
    plain = lambda *phrases: tuple(" ".join(words_of(p)) for p in phrases)
    out = {}
    for kind, (name, versions) in GNU.items():
        for v in versions:
            own = f"{kind}-{v if '.' in v else v + '.0'}"
            out[f"{own}-version"] = Template(own, f"under the {name}, version {v}", plain(name, f"version {v}"))
            out[f"{own}-v"] = Template(own, f"under the {name} v{v}", plain(f"{name} v{v}"))
    for kind, name in CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            own = f"cc-{kind}-{v}"
            out[f"{own}-short"] = Template(own, f"under CC {kind} {v}", plain(f"CC {kind} {v}"))
            out[f"{own}-long"] = Template(own, f"licensed under a Creative Commons {name} {v} International License", plain(f"Creative Commons {name} {v}"))
    for own, name in NAMED.items():
        out[f"{own}-name"] = Template(own, f"Licensed under the {name}", plain(name))
        out[f"{own}-released"] = Template(own, f"Released under the {name}", plain(name))
        out[f"{own}-distributed"] = Template(own, f"Distributed under the terms of the {name}", plain(name))
    for tag in TAGS:
        out[f"{tag.lower()}-tag"] = Template(tag.lower(), f"SPDX-License-Identifier: {tag}", plain(f"SPDX-License-Identifier: {tag}"))
    for own, (head, phrases) in HEADS.items():
        out[f"{own}-head"] = Template(own, head, phrases)
    for kind, (_, versions) in GNU.items():
        for v in versions:
            own = f"{kind}-{v if '.' in v else v + '.0'}"
            out[f"{own}-abbreviated"] = Template(own, f"under the GNU {kind.upper()} v{v}", plain(f"GNU {kind} v{v}"))
    return out


TEMPLATES = named_templates() | TEXTS | NOTICES


class Prepared(NamedTuple):
    """A template's words, its required phrases between spaces, and the words of these."""

    license: str
    words: list[str]
    own: frozenset[str]
    phrases: list[str]
    must: frozenset[str]


def prepare(templates: dict[str, Template]) -> dict[str, Prepared]:
    out = {}
    for name, t in sorted(templates.items()):
        words = words_of(t.text)
        out[name] = Prepared(t.license, words, frozenset(words), [f" {p} " for p in t.required], frozenset(w for p in t.required for w in p.split()))
    return out


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        back[i] = at[k - 1] if k else -1
        ends[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if cb[w] == 1}
        once = [(p, where[w]) for p, w in enumerate(a[i:j], i) if ca[w] == 1 and w in where]
        kept = [once[x] for x in _increasing([y for _, y in once])]
        if not kept:
            continue
        out += kept
        edges = [(i - 1, k - 1), *kept, (j, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def share(aligned: int, template: int, between: int) -> float:
    """Aligned words, of the template's and half of those between them."""
    return aligned / (template + between / 2)


def trimmed(pairs: list[tuple[int, int]], template: int) -> list[tuple[int, int]]:
    """The pairs without those at either end that are so far away that they lower the coverage."""
    between = lambda a, b: pairs[b][1] - pairs[a][1] + 1 - (b - a + 1)
    first, last = 0, len(pairs) - 1
    first = max(range(len(pairs)), key=lambda i: (share(last - i + 1, template, between(i, last)), -i))
    last = max(range(first, len(pairs)), key=lambda i: (share(i - first + 1, template, between(first, i)), i))
    return pairs[first : last + 1]


def negated(words: list[str], first: int, size: int) -> bool:
    """Whether a short notice is denied: `not` or the like among the three words before it."""
    before = words[max(0, first - 3) : first]
    denied = [i for i, w in enumerate(before) if w in ("not", "never", "cannot") or w == "t" and i and before[i - 1] in ("isn", "aren", "wasn", "don", "doesn", "won", "can")]
    return size <= SHORT and bool(denied) and (before + ["" if first >= len(words) else words[first]])[denied[-1] + 1] != "only"


def scan(text: str | None, templates: dict[str, Prepared], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, last word + 1) of all matches that reach `coverage`, without those that overlap a heavier one; by template and place."""
    words = words_of(text or "")
    present = set(words)
    templates = {k: t for k, t in templates.items() if t.must <= present}
    if not templates:
        return []
    vocabulary = frozenset().union(*(t.own for t in templates.values()))
    hits = [(i, w) for i, w in enumerate(words) if w in vocabulary]
    found: list[tuple[int, int, int, str, int, float, int, int]] = []
    seen: set[tuple[str, int, int]] = set()

    def seek(name: str, low: int, high: int) -> None:
        template = templates[name]
        size = len(template.words)
        if high - low < coverage * size or (name, low, high) in seen:
            return
        seen.add((name, low, high))
        pairs = align(template.words, words[low:high])
        if not pairs:
            return
        pairs = trimmed(pairs, size)
        first, end = low + pairs[0][1], low + pairs[-1][1] + 1
        part = share(len(pairs), size, end - first - len(pairs))
        held = " " + " ".join(words[first:end]) + " "
        if part >= coverage and all(p in held for p in template.phrases):
            heappush(found, (-len(pairs), end - first, first, name, end, part, low, high))

    for name, template in templates.items():
        size = len(template.words)
        need, reach = max(1, int(-(-coverage * size // 1))), int(SPAN * size)
        at = [i for i, w in hits if w in template.own]
        regions: list[list[int]] = []
        for x in range(len(at) - need + 1):
            if at[x + need - 1] - at[x] < reach:
                low, high = at[x], min(len(words), at[x] + reach)
                if regions and low <= regions[-1][1] - size:
                    if at[x + need - 1] >= regions[-1][1] or low - regions[-1][0] < size:
                        regions[-1][1] = max(regions[-1][1], at[x + need - 1] + 1)
                        continue
                regions.append([low, high])
        for low, high in regions:  # a match is shorter than `reach`, so it lies in one of these pieces whole
            for x in range(low, max(low + 1, high - reach), reach):
                seek(name, x, min(high, x + 2 * reach))
    # of matches that share words, the one with the most aligned words stands, then the one with fewer words between;
    # the other notice is sought again in what the first leaves of its region
    kept: list[tuple[int, int, str, float]] = []  # in order of place, as none overlap
    while found:
        _, _, first, name, end, part, low, high = heappop(found)
        at = bisect_left(kept, (first,))
        near = [o for o in kept[max(0, at - 1) : at + 1] if o[0] < end and first < o[1]]
        if not near:
            kept.insert(at, (first, end, name, part))
        over = near[0] if near else kept[at]
        seek(name, low, over[0])
        seek(name, over[1], high)
    return sorted(((name, part, first, end) for first, end, name, part in kept if not negated(words, first, len(templates[name].words))), key=lambda m: (m[0], m[2]))


@cache
def _default() -> dict[str, Prepared]:
    return prepare(TEMPLATES)


def scan_documents(docs: DataFrame, templates: dict[str, Template] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and matches (array of license, template, coverage, first_word, end_word; by license and place) of every row of `docs`.

    Null, empty and license-free texts have an empty array. Texts of any length are read whole. Of matches that
    overlap, the one with most aligned words stands; of equal ones the one with fewer words between, then the earlier, then
    the first template by name. Repeated rows each get their row; an empty table gives none; further columns are ignored.
    """
    names = ("license", "template", "coverage", "first_word", "end_word")
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _default() if templates is None else prepare(templates)
        for b in batches:
            found = [sorted(((known[m[0]].license, *m) for m in scan(t, known, coverage)), key=lambda m: (m[0], m[3])) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(names, m)) for m in x] for x in found], kind)], ["doc_id", "matches"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, matches array<struct<license string, template string, coverage double, first_word long, end_word long>>")
