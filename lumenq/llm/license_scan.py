"""License notices in texts, by patience alignment with templates.

Text and template are compared as lower-case words without outer punctuation. In a region of the text,
words that occur once there and once in the template are anchors; the longest increasing subsequence of
the anchors (patience sorting) is kept, and the gaps between them are aligned in the same way. A gap
without anchors falls back to the longest common subsequence. Coverage is the share of the template's
words that are matched; a notice counts from ``coverage`` (0.8) on. The words that tell a licence from its
relatives (``REQUIRED``) must be among the matched ones; in a short template that leaves only such words as
"released" or "the" free to be missing. Of notices that overlap the one with the most matched words
counts, so a licence whose words contain those of another is not taken for it.

Regions: a long template's longest required word is its key. Without one, a notice that counts lacks at most
so many of the template's words that it holds one of any one more of them; the template's rarest such words
are its keys. A region is first the stretch around a key that the template would cover, a quarter more to either side; where no notice
is there, the neighbourhood of one template length to either side (in steps where neighbourhoods run together), so that every notice
lies in one, and a notice that is repeated is found each time, however closely.

Null and empty texts have no notices; an empty table gives no rows; very long texts are scanned whole, in time about linear in
their length; repeated rows are scanned each; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import table

COVERAGE = 0.8

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def _gnu(name: str, version: str, what: str = "program") -> list[str]:
    """The notices of a licence of GNU: short, opening and whole."""
    opening = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License"
    return [f"This work is licensed under the GNU {name}, version {version}.", opening, f"{opening}, or (at your option) any later version. This {what} {_WARRANTY} See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see"]


def _cc(code: str, name: str) -> list[str]:
    return [f"Licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License."]


#: Identifier and wording of common notices. BSD is the opening that all BSD licences share, where no more of one is there.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", _MIT,
        f'{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        "Released under the ISC License.", "Licensed under the ISC License.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": _gnu("General Public License", "3"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "library"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-2.0": _gnu("Library General Public License", "2", "library"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD": [_BSD],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD_2} {_AS_IS}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", f"{_BSD_2} 3. {_ENDORSE} {_AS_IS}"],
    "BSD-4-Clause": [f"{_BSD_2} {_ADVERTISING} 4. {_ENDORSE} {_AS_IS}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Words that tell a licence from its relatives: where a template has one, it must be among the matched words.
REQUIRED = {
    "MIT": "mit license sublicense", "ISC": "isc license fee", "Apache-2.0": "apache 2.0", "MPL-2.0": "mozilla 2.0", "GPL-3.0": "general 3", "GPL-2.0": "general 2", "LGPL-3.0": "lesser 3", "LGPL-2.1": "lesser 2.1", "LGPL-2.0": "library 2", "AGPL-3.0": "affero 3",
    "BSD-2-Clause": "bsd 2-clause redistributions", "BSD-3-Clause": "bsd 3-clause redistributions endorse", "BSD-4-Clause": "redistributions endorse advertising", "Unlicense": "unencumbered",
    "CC-BY-4.0": "cc by attribution 4.0", "CC-BY-NC-4.0": "cc by-nc attribution-noncommercial 4.0", "CC-BY-SA-4.0": "cc by-sa attribution-sharealike 4.0", "CC-BY-ND-4.0": "cc by-nd attribution-noderivatives 4.0",
    "CC-BY-NC-SA-4.0": "cc by-nc-sa attribution-noncommercial-sharealike 4.0", "CC-BY-NC-ND-4.0": "cc by-nc-nd attribution-noncommercial-noderivatives 4.0",
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}\"'«»“”"


def normal(text: str) -> list[str]:
    """Words as they are compared; what is only punctuation stays as it is, so positions are those of the text."""
    return [w.strip(_EDGE) or w for w in _WORD.findall(text.lower())]


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) that increases in both."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile:
            back[k] = last[pile - 1]
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        na, nb = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {b[j]: j for j in range(j0, j1) if nb[b[j]] == 1 and na.get(b[j]) == 1}
        anchors = patience([(i, at[a[i]]) for i in range(i0, i1) if a[i] in at])
        if anchors:
            i, j = i0, j0
            for x, y in [*anchors, (i1, j1)]:
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            out.extend(anchors)
            continue
        where = defaultdict(list)
        for j in range(j1 - 1, j0 - 1, -1):
            where[b[j]].append(j)
        out.extend(patience([(i, j) for i in range(i0, i1) for j in where.get(a[i], ())]))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage, self.forms = coverage, []
        forms = [(name, normal(t)) for name, many in templates.items() for t in many]
        common = Counter(w for _, ws in forms for w in set(ws))
        for name, ws in forms:
            n = len(ws)
            wanted = math.ceil(n * coverage - 1e-9)
            required = frozenset(REQUIRED.get(name, "").split()).intersection(ws)
            lacking = n - wanted
            order = sorted(set(ws), key=lambda w: (common[w], -len(w), w))
            if required and n >= 20:
                self.forms.append((name, ws, frozenset([max(required, key=lambda w: (len(w), w))]), required, wanted))
                continue
            keys: list[str] = []
            n = 0
            for w in order:
                keys.append(w)
                n += ws.count(w)
                if n > lacking:
                    break
            self.forms.append((name, ws, frozenset(keys), required, wanted))
        #: Substrings of which any text with a key has one; few scans at the speed of C decide most texts.
        self.keys = sorted({k for _, _, ks, _, _ in self.forms for k in ks})
        self._all = frozenset(self.keys)
        self.first = [k for k in self.keys if not any(o != k and o in k for o in self.keys)]

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """first word, end word, license, coverage of each notice; where notices overlap, the one with the most matched words (then the best covered, then the shortest)."""
        if not text:
            return []
        low = text.lower()
        if not any(k in low for k in self.first):
            return []
        ws = normal(text)
        vocabulary = set(ws)
        found = []
        places = None
        for name, form, keys, required, wanted in self.forms:
            held = keys & vocabulary
            if not held or not required <= vocabulary:
                continue
            if places is None:
                places = defaultdict(list)
                for i, w in enumerate(ws):
                    if w in self._all:
                        places[w].append(i)
            n = len(form)
            at_form = {k: [j for j, w in enumerate(form) if w == k] for k in held}
            of_form = set(form)
            like = [0, *accumulate(w in of_form for w in ws)]
            # Close around a key first: a neighbour of the same wording can't lend its words there.
            rest, done = [], 0
            for i in sorted(i for k in held for i in places[k]):
                if i < done:
                    continue
                best = None
                for j in at_form[ws[i]]:
                    lo, hi = max(done, i - j - n // 4 - 2), min(len(ws), i - j + n + n // 4 + 2)
                    if like[max(lo, hi)] - like[lo] >= wanted and (got := self._fit(ws, lo, hi, form, wanted, required)) and got[0]:
                        best = max(best or got[0], got[0], key=lambda x: (x[2], x[0] - x[1]))
                if best:
                    done = best[1]
                    found.append((best[0], best[1], name, best[2] / n, best[2]))
                else:
                    rest.append(i)
            spans: list[list[int]] = []
            for i in rest:
                lo, hi = max(0, i - n), min(len(ws), i + n + 1)
                if spans and i - spans[-1][2] < n // 2:
                    spans[-1][1:] = hi, i
                else:
                    spans.append([lo, hi, i])
            for lo, hi, _ in spans:
                while lo < hi:
                    stop = min(hi, lo + 4 * n)  # a notice is at most 2 n words long: steps of 2 n miss none
                    got = self._fit(ws, lo, stop, form, wanted, required) if like[stop] - like[lo] >= wanted else None
                    if got:
                        if got[0]:
                            found.append((got[0][0], got[0][1], name, got[0][2] / n, got[0][2]))
                        lo = got[1]
                    elif stop < hi:
                        lo += 2 * n
                    else:
                        break
        found.sort(key=lambda x: (-x[4], -x[3], x[1] - x[0], x[0], x[2]))
        kept: list = []
        for x in found:
            k = bisect_left(kept, x[0], key=lambda y: y[0])
            if (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= kept[k][0]):
                kept.insert(k, x)
        return [x[:4] for x in kept]

    def _fit(self, ws, lo, hi, form, wanted, required):
        """((first word, end word, matched words) or None, where to go on) of a region; None where too few words match."""
        n = len(form)
        pairs = align(ws[lo:hi], form)
        if len(pairs) < wanted:
            return None
        pairs = self._dense(pairs, n)
        if len(pairs) >= wanted and required <= {form[j] for _, j in pairs}:
            at = [lo + i for i, _ in pairs]
            if at[-1] - at[0] >= len(at):
                self._draw(ws, [form[j] for _, j in pairs], at)
            return (at[0], at[-1] + 1, len(at)), at[-1] + 1
        return None, lo + pairs[-1][0] + 1

    @staticmethod
    def _draw(ws, words, at):
        """Draws the places of matched words together: what lies before or behind a notice may have lent it words that it holds itself."""
        for k in range(1, len(at)):
            at[k] = ws.index(words[k], at[k - 1] + 1)
        for k in range(len(at) - 2, -1, -1):
            i = at[k + 1] - 1
            while ws[i] != words[k]:
                i -= 1
            at[k] = i

    @staticmethod
    def _dense(pairs, n):
        """The run of matches with the most in a stretch of twice the template's length."""
        best, i = pairs[:1], 0
        for j in range(len(pairs)):
            while pairs[j][0] - pairs[i][0] >= 2 * n:
                i += 1
            if j + 1 - i > len(best):
                best = pairs[i : j + 1]
        return best


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, notices (array of first word, end word, license, coverage) for each row; a narrow map."""

    def run(batches):
        scanner = Scanner(templates, coverage)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))
        for batch in batches:
            got = [[dict(zip(("first", "end", "license", "coverage"), x, strict=True)) for x in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=["doc_id", "notices"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, notices array<struct<first:bigint,end:bigint,license:string,coverage:double>>")


def op3_license_patience(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_notices, licenses (comma-joined in text order, empty if none), coverage (of the best, else 0), spans (license:first:end)."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "cast(size(notices) as bigint) n_notices", "array_join(transform(notices, x -> x.license), ',') licenses", "coalesce(array_max(transform(notices, x -> x.coverage)), 0D) coverage",
        "array_join(transform(notices, x -> concat_ws(':', x.license, x.first, x.end)), ',') spans",
    )
