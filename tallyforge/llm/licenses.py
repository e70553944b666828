"""Licence scans: the Dice coefficient of word bigrams against licence templates.

Texts and templates are lower-cased runs of letters and digits. A template of n words is compared
with every run of n consecutive words of a document (with the whole document if that is shorter);
the score is the largest 2 * |A & B| / (|A| + |B|) over the sets of distinct bigrams. Bounds prune
templates: for a score of t a document needs at least t * |B| / (2 - t) bigrams, that many of the
template's bigrams, and so does a run of words. Distinct bigrams of all runs come from one pass: one
counts in the runs that begin after its equal before it.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bytetext import ALNUM, U64, Words, ranges, text_buffer
from tallyforge.llm.common import documents, map_blocks

THRESHOLD = 0.8

# Public licence texts and notices; longer ones are files of the folder `templates`.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-line": "Released under the MIT License.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def whole_texts(folder: Path = Path(__file__).parent / "templates") -> dict[str, str]:
    """Licence texts from the files of a folder, by file name; read on the driver."""
    return {p.stem: p.read_text() for p in sorted(folder.glob("*.txt"))}


class Templates:
    """Sorted distinct bigram hashes of all templates, and which template holds which."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.names = sorted(texts)
        w = Words(*text_buffer(pa.array([texts[n] for n in self.names], pa.string())), ALNUM, lower=True)
        at, h = w.grams(2)
        self.words = w.counts
        self.keys, place = np.unique(h, return_inverse=True)
        self.holds = np.zeros((len(self.keys), len(self.names)), bool)
        self.holds[place, np.searchsorted(w.first, at, "right") - 1] = True
        self.bigrams = self.holds.sum(axis=0)
        # The templates of each key, one key after the other.
        self.many = self.holds.sum(axis=1)
        self.first, self.of = np.cumsum(self.many) - self.many, np.nonzero(self.holds)[1]
        self.slots = np.zeros(1 << 20, bool)
        self.slots[self.keys & U64((1 << 20) - 1)] = True
        # Fewest common bigrams, and so fewest bigrams of a text, for the threshold.
        self.need = np.maximum(1, np.ceil(threshold * self.bigrams / (2 - threshold) - 1e-9)).astype(np.int64)


def _earlier(h: np.ndarray) -> np.ndarray:
    """Place of the equal value before each, or -1."""
    out = np.full(len(h), -1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _distinct(earlier: np.ndarray, at: np.ndarray, length: int, starts: int) -> np.ndarray:
    """For each of `starts` runs of `length` values, how many distinct ones of those at `at` it holds."""
    low, high = np.maximum(np.maximum(earlier[at] + 1, at - length + 1), 0), np.minimum(at, starts - 1)
    low, high = low[low <= high], high[low <= high]
    return np.cumsum(np.bincount(low, minlength=starts + 1) - np.bincount(high + 1, minlength=starts + 1))[:starts]


def find(templates: Templates, w: Words, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, template, score, first word, words) of each template that reaches the threshold; the earliest of equal runs."""
    at, h = w.grams(2)
    maybe = np.flatnonzero(templates.slots[h & U64((1 << 20) - 1)])
    place = np.searchsorted(templates.keys, h[maybe])
    place[place == len(templates.keys)] = 0
    good = templates.keys[place] == h[maybe]
    hit, key = at[maybe[good]], place[good]
    text = np.searchsorted(w.first, hit, "right") - 1
    both = np.unique(text * len(templates.keys) + key)
    n, width = len(w.first) - 1, len(templates.names)
    one, of = both // len(templates.keys), both % len(templates.keys)
    cell = np.repeat(one * width, templates.many[of]) + templates.of[ranges(templates.first[of], templates.many[of])]
    common = np.bincount(cell, minlength=n * width).reshape(n, width)
    fits = (common >= templates.need) & (w.counts[:, None] - 1 >= templates.need)
    out = []
    if fits.any():
        full = np.zeros(len(w), U64)
        full[at] = h
        first_hit = np.searchsorted(text, np.arange(n + 1))
        for d in np.flatnonzero(fits.any(axis=1)):
            own = slice(first_hit[d], first_hit[d + 1])
            size = int(w.counts[d])
            earlier, every = _earlier(full[w.first[d] : w.first[d] + size - 1]), np.arange(size - 1)
            for t in np.flatnonzero(fits[d]):
                run = min(int(templates.words[t]), size)
                shared = _distinct(earlier, hit[own][templates.holds[key[own], t]] - w.first[d], run - 1, size - run + 1)
                if shared.max() < templates.need[t]:
                    continue
                score = 2.0 * shared / (_distinct(earlier, every, run - 1, size - run + 1) + templates.bigrams[t])
                where = int(np.argmax(score))
                if score[where] >= threshold:
                    out.append((int(d), int(t), float(score[where]), where, run))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, best (licence name or null), score (0 without one), matches (array of name, score, start, words; by name) for every row.

    The best match has the largest score; of equals the longer template, then the first by name. A
    null or empty text, or one of a single word, matches nothing. Equal rows match alike, each by
    itself; no rows give no rows. Ids are integers or cast to them. Without `templates`, TEMPLATES and
    whole_texts() are looked for. Only the two named columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES | whole_texts(), threshold))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own: Templates = sent.value
        w = Words(*text_buffer(batch.column(1)), ALNUM, lower=True)
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for d, t, score, start, words in find(own, w, threshold):
            found[d].append({"name": own.names[t], "score": score, "start": start, "words": words, "long": -int(own.words[t])})
        best = [min(x, key=lambda m: (-m["score"], m["long"], m["name"])) if x else None for x in found]
        kind = pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))
        listed = [[{k: m[k] for k in ("name", "score", "start", "words")} for m in x] for x in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([b and b["name"] for b in best], pa.string()), pa.array([b["score"] if b else 0.0 for b in best]), pa.array(listed, kind)],
            ["doc_id", "best", "score", "matches"],
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_blocks(rows, "doc_id long, best string, score double, matches array<struct<name:string,score:double,start:long,words:long>>", each)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "best", "score", F.array_join(F.transform("matches", lambda m: m["name"]), ",").alias("licenses"), F.size("matches").cast("long").alias("n_licenses"))
