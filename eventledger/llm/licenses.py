"""Licence notices in texts: an inverted index of winnowed fingerprints, then alignment.

Of a template's word shingles winnowing keeps the smallest hash of each window; the index
holds these with their places. A text's shingles that hit the index vote for a template and
a diagonal. Around each diagonal a banded alignment of the template's words with the text's
counts the words that match in order, and where the match begins and ends. Of overlapping
matches the one with most matched words stays, of equal ones that with the greatest coverage, then
the first in the text, then the first by name.

Templates that share most of their words, as the headers of one family's versions do, are told
apart by the words that one has and the other has not: a match must hold most of these
for each such sibling. A text that none of the known versions fits is not named after a sibling.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import WORD_BYTES, long_id
from eventledger.llm.simhash import known_id
from eventledger.llm.substrings import WordCodes

SHINGLE = 3
WINNOW = 4
BAND = 8  # words by which a match may drift from its diagonal
COVERAGE = 0.8  # of a template's words that a match must hold
SHORT = 10  # templates with fewer words must match whole
SIBLING = 0.8  # of the smaller one's words that two siblings share
TELLING = 0.6  # of the words that tell a template from a sibling, which a match must hold

# Wordings of public licences and of the notices that refer to them.
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the {name} as published by "
    "the Free Software Foundation{end} either version {version} of the License, or (at your option) any later version."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "BSD-2-Clause conditions": _BSD_GRANT,
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "BSD-3-Clause conditions": f"{_BSD_GRANT} {_BSD_NAMES}",
    "BSD notice": "Licensed under the BSD License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0": "This work is licensed under the GNU General Public License version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License version 3",
    "AGPL-3.0 header": _GNU.format(what="program", sign=":", name="GNU Affero General Public License", end=",", version="3"),
    "GPL-2.0 header": _GNU.format(what="program", sign=";", name="GNU General Public License", end=";", version="2"),
    "GPL-3.0 header": _GNU.format(what="program", sign=":", name="GNU General Public License", end=",", version="3"),
    "LGPL-2.1 header": _GNU.format(what="library", sign=";", name="GNU Lesser General Public License", end=";", version="2.1"),
    "LGPL-3.0 header": _GNU.format(what="library", sign=":", name="GNU Lesser General Public License", end=",", version="3"),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "
        "Published under CC0 1.0 Universal Public Domain Dedication"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "ISC": f"{_ISC_GRANT} {_ISC_DISCLAIMER}",
    "ISC permission": _ISC_GRANT,
    "MIT notice": "Released under the MIT License",
    "MIT": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "MIT permission": _MIT_GRANT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_EDGES = b".,;:!?\"'()[]{}<>*#/-"


class FoldedCodes(WordCodes):
    """Codes of words without case and the punctuation around them; 0 for none."""

    def __missing__(self, word: bytes) -> int:
        folded = word.lower().strip(_EDGES)
        if not folded:
            self[word] = 0
            return 0
        code = self[word] = super().__missing__(folded)
        return code


def _shingles(codes, size: int):
    import numpy as np

    n = max(0, len(codes) - size + 1)
    value = np.zeros(n, np.uint64)
    for i in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return value


class Index:
    """Winnowed shingles of all templates, sorted, with template and place."""

    def __init__(self, templates: dict[str, str]):
        import numpy as np

        self.folds = FoldedCodes()
        self.names = sorted(templates)
        self.words = [c[c > 0] for c in (self.codes(WORD_BYTES.findall(templates[n].encode())) for n in self.names)]
        marks = []
        for t, words in enumerate(self.words):
            values = _shingles(words, SHINGLE)
            for i in range(max(1, len(values) - WINNOW + 1)):
                part = values[i : i + WINNOW]
                if len(part):
                    at = i + len(part) - 1 - int(part[::-1].argmin())  # the rightmost smallest
                    marks.append((int(values[at]), t, at))
        marks = sorted(set(marks))
        self.keys = np.array([m[0] for m in marks], np.uint64)
        self.template = np.array([m[1] for m in marks], np.int64)
        self.place = np.array([m[2] for m in marks], np.int64)
        sets = [set(words.tolist()) for words in self.words]
        # For each template and sibling the words that the sibling has not.
        self.telling = [
            [a - b for j, b in enumerate(sets) if i != j and a - b and len(a & b) >= SIBLING * min(len(a), len(b))]
            for i, a in enumerate(sets)
        ]

    def codes(self, words: list[bytes]):
        import numpy as np

        found = np.fromiter(map(self.folds.__getitem__, words), np.uint64, len(words))
        return found

    def tells(self, t: int, codes) -> bool:
        """Whether the words of a match tell its template from all siblings."""
        held = set(codes.tolist())
        return all(len(words & held) >= TELLING * len(words) for words in self.telling[t])

    def band(self, t: int) -> int:
        """Narrow for short templates, so that notices side by side stay apart."""
        return min(BAND, len(self.words[t]) // 2)

    def candidates(self, codes):
        """(template, diagonal) pairs that shingles of the text vote for, near ones as one."""
        import numpy as np

        values = _shingles(codes, SHINGLE)
        first = np.searchsorted(self.keys, values, "left")
        n = np.searchsorted(self.keys, values, "right") - first
        hit = np.flatnonzero(n)
        if not len(hit):
            return []
        entry = np.repeat(first[hit], n[hit]) + np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
        pairs = np.unique(np.stack((self.template[entry], np.repeat(hit, n[hit]) - self.place[entry]), axis=1), axis=0)
        out, last = [], None
        for t, d in pairs.tolist():
            if last is None or t != last[0] or d > last[1] + self.band(t):
                out.append((t, d))
                last = (t, d)
        return out


def align(template, text, band: int):
    """(matched, first, last) of the longest common sequence within ``band`` of the diagonal.

    ``text`` begins ``band`` words before the template's first word is expected.
    """
    n, width = len(text), 2 * band + 1
    none = (-1, 0, 0)
    # best[w]: (matched, first, -last) when i template words and i + w of the text are used up
    best = [(0, 0, 0)] * width
    for i, word in enumerate(template):
        new: list[tuple] = []
        for w in range(width):
            j = i + w
            skip_template = best[w + 1] if w + 1 < width else none
            skip_text = new[-1] if w else none
            found = max(skip_template, skip_text)
            if j < n and word == text[j]:
                matched, first, _ = best[w]
                found = max(found, (matched + 1, first if matched else j, -(j + 1)))
            new.append(found)
        best = new
    matched, first, last = max(best)
    return matched, first, -last


def scan_text(text: bytes, index: Index):
    """Matches of a text: (template number, matched, first word, last word, begin byte, end byte)."""
    words = WORD_BYTES.findall(text)
    if not words:
        return []
    codes = index.codes(words)
    real = codes.nonzero()[0]  # places of words that are more than punctuation
    packed = codes[real]
    found = []
    for t, diagonal in index.candidates(packed):
        template = index.words[t]
        band = index.band(t)
        lo = diagonal - band
        part = packed[max(lo, 0) : max(0, diagonal + len(template) + band)].tolist()
        part = [None] * max(0, -lo) + part
        matched, first, last = align(template.tolist(), part, band)
        need = len(template) if len(template) < SHORT else COVERAGE * len(template)
        if matched >= need and index.tells(t, packed[lo + first : lo + last]):
            found.append((matched, t, lo + first, lo + last))
    found.sort(key=lambda f: (-f[0], -f[0] / len(index.words[f[1]]), f[2], f[1]))
    chosen: list[tuple] = []
    begins: list[int] = []  # of the chosen, ascending; they do not overlap
    for match in found:
        at = bisect_left(begins, match[2])
        before, after = chosen[at - 1] if at else None, chosen[at] if at < len(chosen) else None
        if (before is None or before[3] <= match[2]) and (after is None or match[3] <= after[2]):
            chosen.insert(at, match)
            begins.insert(at, match[2])
    if not chosen:
        return []
    spans = [m.span() for m in WORD_BYTES.finditer(text)]
    out = []
    for matched, t, first, last in chosen:
        a, b = int(real[first]), int(real[last - 1])
        out.append((t, matched, a, b + 1, spans[a][0], spans[b][1]))
    return out


def _scan(batches, templates: dict[str, str]):
    import pyarrow as pa

    index = Index(templates)
    names = ["_key", "license", "matched", "coverage", "first_word", "last_word", "first_char", "last_char"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4)
    for batch in batches:
        rows = []
        for key, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            for t, matched, first, last, begin, end in scan_text(text, index):
                chars = len(text[:begin].decode("utf-8", "replace"))
                size = len(text[begin:end].decode("utf-8", "replace"))
                rows.append((key, index.names[t], matched, matched / len(index.words[t]), first, last, chars, chars + size))
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def scan(
    documents: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per match: id, license, matched words, coverage of the template, and its span.

    Spans are [first, last) in words and in characters of the text. Null and empty texts
    match nothing; a template of fewer than three words raises; rows that repeat each give their matches; a
    null id stays null. Templates are an argument, so the index has a known size.
    """
    wanted = TEMPLATES if templates is None else templates
    short = [name for name, text in wanted.items() if len(re.findall(r"\w\S*", text)) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    rows = documents.select(long_id(id_col).alias("_key"), F.col(text_col).cast("binary").alias("_text")).where("_text IS NOT NULL")
    kinds = "_key long, license string, matched long, coverage double, first_word long, last_word long, first_char long, last_char long"
    found = rows.mapInArrow(lambda b: _scan(b, wanted), kinds)
    return found.select(known_id("_key").alias(id_col), *found.columns[1:])
