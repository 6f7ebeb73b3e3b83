"""License notices by conditional compression.

Texts are read as words, so wrapped lines, comment marks and punctuation do not matter. A region (words of the templates'
vocabulary, close together) is compressed alone and with each template as a raw zstandard dictionary; the templates that
shrink it are ranked by the bytes they save, and the best is confirmed by the exact differences in wording. What lies
outside its place is then looked at in the same way.

A confirmed notice has VARIANT of its template's words, hence at least one of its rarest words beyond the remainder: regions
without any such word are left out, which loses none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, batches_of, lower_words, text_bytes, word_hashes, word_spans

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: (license, paragraph, words it must hold). Short notices as they head files, and the paragraphs of the licenses themselves.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information.", "mit"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', ""),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public 2"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gnu general public"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser 2"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu affero"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ""),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ""),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ""),
    ("BSD", _AS_IS, ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons sharealike 4"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons noncommercial 4"),
    ("Proprietary", "All rights reserved.", "all rights reserved"),
    *((name, f"SPDX-License-Identifier: {name}", "spdx " + " ".join(re.findall("[a-z0-9]+", name.lower()))) for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0")),
)
#: Least share of a template's words that a block must hold, in order, to be a variant of it.
VARIANT = 0.7
#: Foreign words that may stand between words of a region; words of the window that slides over a longer region, by half its width.
GAP, WIDE = 12, 400
#: Words so common in prose that they are the last to be waited for.
COMMON = frozenset("the of to and or in is a this be as for any with by at it are not that you on from all an use may its if out no was one can name more way but has form above without do so work person other source including public free data file author specific under see terms".split())

FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("saved", T.LongType()), T.StructField("differences", T.StringType())]))
_FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("saved", pa.int64()), ("differences", pa.string())]))


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(word_hashes(data, *word_spans(data, np.array([0, len(data)]), ALNUM)))


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.entries = []
        cues: set[str] = set()
        for name, wording, must in templates:
            want = [w.decode() for w in lower_words(wording.encode())]
            low = " ".join(want).encode()
            d = zstandard.ZstdCompressionDict(low * (1 + 8 // len(low)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.entries.append((name, want, Counter(want), frozenset(must.split()), zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False)))
            # Any VARIANT of the words has one of the rest, whichever words the rest is made of: the rarest.
            rest = len(want) - int(np.ceil(VARIANT * len(want))) + 1
            need = sorted(must.split(), key=lambda w: (w in COMMON, -len(w)))[:1]
            cues |= set(need) if need else set(sorted(want, key=lambda w: (w in COMMON, -len(w)))[:rest])
        self.cues = cues
        self.cue_hashes, self.known = _hashes(sorted(cues)), _hashes(sorted({w for e in self.entries for w in e[1]}))
        self.seen: dict[tuple[str, ...], tuple | None] = {}

    def classify(self, words: tuple[str, ...]) -> tuple[str, str, int, str, int, int] | None:
        """(license, exact / contains / variant, bytes saved, wording differences, first word, end) of the best confirmed template."""
        if words in self.seen:
            return self.seen[words]
        have = Counter(words)
        likely = [e for e in self.entries if all(w in have for w in e[3]) and sum((e[2] & have).values()) >= VARIANT * len(e[1])]
        best = None
        if likely:
            raw = " ".join(words).encode()
            base = len(self.alone.compress(raw))
            ranked = sorted(((base - len(e[4].compress(raw)), e) for e in likely), key=lambda x: -x[0])
            for gain, (name, want, _, must, _) in ranked:
                if gain <= 0:
                    break
                got = self._confirm(words, want, must)
                if got is None:
                    continue
                kind, missing, extra, note, a, b = got
                # The longer of two that fit as well says more.
                rank = (("exact", "contains", "variant").index(kind), missing / len(want), extra, -len(want), -gain)
                if best is None or rank < best[0]:
                    best = (rank, (name, kind, gain, note, a, b))
        out = best[1] if best else None
        if len(self.seen) < 50_000:  # notices repeat; the memory only saves time
            self.seen[words] = out
        return out

    @staticmethod
    def _confirm(words: tuple[str, ...], want: list[str], must: frozenset[str]) -> tuple[str, int, int, str, int, int] | None:
        blocks = [m for m in SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks() if m.size]
        if not blocks:
            return None
        # Strays far from the longest run are not part of the notice.
        k = max(range(len(blocks)), key=lambda i: blocks[i].size)
        lo = hi = k
        near = max(GAP, len(want) // 2)
        while lo and blocks[lo].b - (blocks[lo - 1].b + blocks[lo - 1].size) <= near:
            lo -= 1
        while hi + 1 < len(blocks) and blocks[hi + 1].b - (blocks[hi].b + blocks[hi].size) <= near:
            hi += 1
        blocks = blocks[lo : hi + 1]
        a, b = blocks[0].b, blocks[-1].b + blocks[-1].size
        common = sum(m.size for m in blocks)
        missing, extra = len(want) - common, b - a - common
        if common < VARIANT * len(want) or not must <= set(words[a:b]):
            return None
        notes, i, j = [], 0, a
        for m in [*blocks, None]:
            to, at = (m.a, m.b) if m else (len(want), b)
            if to > i or at > j:
                notes.append(f"{' '.join(want[i:to])}>{' '.join(words[j:at])}")
            if m:
                i, j = m.a + m.size, m.b + m.size
        kind = "variant" if missing or extra else "exact" if b - a == len(words) else "contains"
        return kind, missing, extra, "; ".join(notes), a, b

    def regions(self, known: np.ndarray, cue: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, end) of runs of known words, no more than GAP others between them, that hold a cue; in windows of WIDE words."""
        at = np.flatnonzero(known)
        if not len(at):
            return
        cut = np.flatnonzero(np.diff(at) > GAP + 1)
        cues = np.concatenate([[0], np.cumsum(cue)])
        for a, b in zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist()):
            for p in range(a, max(a + 1, b - WIDE // 2), WIDE // 2):
                q = min(b, p + WIDE)
                if cues[q] > cues[p]:
                    yield p, q

    def notices(self, words: tuple[str, ...], at: int) -> Iterator[tuple[int, int, tuple]]:
        """(first word, end, what) of every notice: the best one, then those of the words before and after it."""
        rest = [(words, at)]
        while rest:
            part, a = rest.pop()
            if got := self.classify(part):
                yield a + got[4], a + got[5], got
                rest += [(p, b) for p, b in ((part[: got[4]], a), (part[got[5] :], a + got[5])) if self.cues & set(p)]

    def scan_batch(self, column: pa.Array) -> list[list[dict]]:
        data, offsets = text_bytes(column)
        s, e = word_spans(data, offsets, ALNUM)
        first = np.searchsorted(s, offsets)
        h = word_hashes(data, s, e)
        cue = np.isin(h, self.cue_hashes)
        sums = np.concatenate([[0], np.cumsum(cue)])
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for i in np.flatnonzero(sums[first[1:]] > sums[first[:-1]]).tolist():
            a, b = int(first[i]), int(first[i + 1])
            found: list[tuple[int, int, tuple]] = []
            for p, q in self.regions(np.isin(h[a:b], self.known), cue[a:b]):
                words = tuple(LOWER[data[s[k] : e[k]]].tobytes().decode() for k in range(a + p, a + q))
                found += self.notices(words, p)
            # Windows overlap: of notices that do, the one with more words stays.
            taken: list[tuple[int, int, tuple]] = []
            for x in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
                if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
                    taken.append(x)
            begin, done, chars = int(offsets[i]), 0, 0
            for p, q, got in sorted(taken):
                start, end = int(s[a + p]) - begin, int(e[a + q - 1]) - begin
                end += data[begin + end : begin + end + 1].tobytes() == b"." and begin + end < int(offsets[i + 1])
                chars += len(data[begin + done : begin + start].tobytes().decode())
                size = len(data[begin + start : begin + end].tobytes().decode())
                out[i].append({"license": got[0], "start": chars, "end": chars + size, "kind": got[1], "saved": got[2], "differences": got[3]})
                done, chars = end, chars + size
        return out

    def scan(self, text: str | None) -> list[dict]:
        return self.scan_batch(pa.array([text], pa.string()))[0]


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, found): every confirmed notice with its place (code points), kind and wording differences. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for whole in batches:
            for batch in batches_of(whole, text):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scanner.scan_batch(batch.column(1)), _FOUND_ARROW)], names=[id_col, "found"])

    return docs.select(id_col, text).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("found", FOUND)]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices, licenses (distinct, sorted, comma-joined), spans (license:kind:start:end) for every document.

    Null and empty texts have no notice; repeated rows a row each; texts of any length are read whole; other columns are
    not read; an empty table gives no row.
    """
    found = scan_licenses(docs)
    part = lambda f: F.concat_ws(":", f["license"], f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("found", part), ",").alias("spans"),
    )
