"""Licence scan: Dice coefficient of word bigrams between parts of a text and licence templates.

A text's units are the whole text, its paragraphs, lines and sentences.  Units and templates are lower-cased and cut
into runs of letters and digits.  With sets A and B of word bigrams the coefficient is ``2 |A & B| / (|A| + |B|)``; at
least ``threshold`` t is only possible if ``t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|``, so a unit meets only
templates of such sizes, and only if it holds enough of their bigrams.  The bounds never drop a match.

A notice may also lie across lines and paragraphs inside a longer text.  So the runs of consecutive words that reach
the threshold are found for each template, wherever they start, and the best of those that overlap is a unit ``run``,
unless it lies in another unit with the same licence.  A run starts and ends with a bigram of its template, and has at
most ``(2 - 2t) / t * |B|`` different bigrams that are not the template's; both follow from the threshold.

Defined results: null and empty texts match nothing; equal coefficients give the template that is listed first;
repeated rows are each returned; an empty table gives an empty table; texts of any length are scanned whole, with their
words in memory; extra columns are ignored, or carried if named, and one that is named ``found`` comes out as
``found_in``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._names import Carried, quoted

#: Public licence notices and texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3 or later."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
)
THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def bigrams(words: Sequence[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def _apart(found: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """The best of (coefficient, -rank, start, end) that do not overlap; equal ones by their start."""
    starts: list[int] = []
    kept: dict[int, tuple[float, int, int, int]] = {}
    for x in sorted(found, key=lambda x: (-x[0], x[2])):
        i = bisect.bisect_left(starts, x[2])
        if (i == 0 or kept[starts[i - 1]][3] <= x[2]) and (i == len(starts) or starts[i] >= x[3]):
            starts.insert(i, x[2])
            kept[x[2]] = x
    return list(kept.values())


class Matcher:
    """Templates by size, with all their bigrams for a quick look."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        sets = [(bigrams(_WORD.findall(text.lower())), i, name) for i, (name, text) in enumerate(templates)]
        self.by_size = sorted((len(s), i, name, s) for s, i, name in sets if s)
        self.sizes = [x[0] for x in self.by_size]
        self.words = frozenset(w for _, _, _, s in self.by_size for pair in s for w in pair)
        self.all = frozenset().union(*(s for *_, s in self.by_size))
        #: A match holds at least so many template bigrams.
        self.of: dict[tuple[str, str], list[int]] = {}
        for at, (_, _, _, own) in enumerate(self.by_size):
            for pair in own:
                self.of.setdefault(pair, []).append(at)
        self.least = max(1, math.ceil(threshold / (2 - threshold) * min(self.sizes, default=1) - 1e-9))

    def best(self, words: Sequence[str]) -> tuple[float, int, str] | None:
        """(coefficient, -rank, name) of the best template for a unit, or None."""
        own = bigrams(words)
        hits = own & self.all
        if len(hits) < self.least:
            return None
        t = self.threshold
        lo = bisect.bisect_left(self.sizes, t / (2 - t) * len(own) - 1e-9)
        hi = bisect.bisect_right(self.sizes, (2 - t) / t * len(own) + 1e-9)
        found = [(2 * len(hits & s) / (len(own) + n), -i, name) for n, i, name, s in self.by_size[lo:hi] if 2 * len(hits) >= (t - 1e-9) * (len(own) + n)]
        return max((x for x in found if x[0] >= t - 1e-9), default=None)

    def _windows(self, at: int, pairs: Sequence[tuple[str, str]]) -> list[tuple[float, int, int, int]]:
        """(coefficient, -rank, start, end) of the best runs of bigrams for a template, none of which overlap."""
        n, rank, _, own = self.by_size[at]
        t = self.threshold
        need, spare = t / (2 - t) * n - 1e-9, (2 - 2 * t) / t * n + 1e-9
        counts: dict[tuple[str, str], int] = {}
        hits = others = end = 0
        found = []
        for start, first in enumerate(pairs):
            while end < len(pairs):  # as far as the bigrams of other texts allow
                pair = pairs[end]
                if not counts.get(pair):
                    if pair in own:
                        hits += 1
                    elif others + 1 > spare:
                        break
                    else:
                        others += 1
                counts[pair] = counts.get(pair, 0) + 1
                end += 1
            if first in own and hits >= need:
                seen: set[tuple[str, str]] = set()
                h, best = 0, (0.0, 0, 0, 0)
                for e in range(start, end):
                    pair = pairs[e]
                    if pair in seen:
                        continue
                    seen.add(pair)
                    if pair in own:
                        h += 1
                        best = max(best, (2 * h / (len(seen) + n), -rank, start, e + 1))
                        if h == hits:
                            break
                if best[0] >= t - 1e-9:
                    found.append(best)
            if end > start:
                counts[first] -= 1
                if not counts[first]:
                    del counts[first]
                    if first in own:
                        hits -= 1
                    else:
                        others -= 1
            else:
                end = start + 1
        return _apart(found)

    def runs(self, words: Sequence[str]) -> list[tuple[float, str, int, int]]:
        """(coefficient, name, start, end) of the runs of bigrams that match; of two at one place the better one."""
        pairs = list(zip(words, words[1:], strict=False))
        held: dict[int, int] = {}
        for pair in self.all.intersection(pairs):
            for at in self.of[pair]:
                held[at] = held.get(at, 0) + 1
        need = self.threshold / (2 - self.threshold)
        found = [(w, self.by_size[at][2]) for at, h in held.items() if h >= need * self.by_size[at][0] - 1e-9 for w in self._windows(at, pairs)]
        places: list[tuple[int, int]] = []
        kept: list[tuple[float, str, int, int]] = []
        for (d, _, a, b), name in sorted(found, key=lambda x: (-x[0][0], -x[0][1], x[0][2])):
            # Two runs are at one place if they share half of the longer one; then their starts lie this near.
            near = places[bisect.bisect_left(places, (2 * a - b,)) : bisect.bisect_right(places, (b, b))]
            if all(2 * (min(b, y) - max(a, x)) < max(b - a, y - x) for x, y in near):
                bisect.insort(places, (a, b))
                kept.append((d, name, a, b))
        kept.sort(key=lambda x: (x[2], x[2] - x[3]))
        reach: dict[str, int] = {}
        outer = []
        for r in kept:  # one that lies in another of the same licence comes behind it
            if r[3] > reach.get(r[1], -1):
                outer.append(r)
                reach[r[1]] = r[3]
        return outer

    def scan(self, text: str) -> list[tuple[str, str, float]]:
        """(licence, unit, coefficient) of each unit with a match; equal lines and sentences inside count once."""
        words = _WORD.findall(text.lower())
        known = [w in self.words for w in words]
        if not any(a and b and (x, y) in self.all for a, b, x, y in zip(known, known[1:], words, words[1:], strict=False)):
            return []
        found: list[tuple[str, str, float]] = []

        covered: list[tuple[str, int, int]] = []

        def look(unit: str, own: Sequence[str], start: int) -> None:
            if len(own) > self.least and (b := self.best(own)):
                found.append((b[2], unit, b[0]))
                covered.append((b[2], start, start + len(own) - 1))

        look("text", words, 0)
        paragraphs, at = _PARAGRAPH.split(text), 0
        for p in paragraphs:
            own = _WORD.findall(p.lower())
            if len(paragraphs) > 1:
                look("paragraph", own, at)
            lines, line_at = p.split("\n"), at
            for line in lines:
                own_line = _WORD.findall(line.lower())
                if len(lines) > 1:
                    look("line", own_line, line_at)
                sentences, s_at = _SENTENCE.split(line), line_at
                for s in sentences if len(sentences) > 1 else ():
                    own_s = _WORD.findall(s.lower())
                    look("sentence", own_s, s_at)
                    s_at += len(own_s)
                line_at += len(own_line)
            at += len(own)
        inside = _Cover(covered)
        return found + [(name, "run", d) for d, name, a, b in self.runs(words) if not inside.holds(name, a, b)]


class _Cover:
    """Whether a place lies in one of a licence's units: their starts in order, and how far they reach up to there."""

    def __init__(self, units: Iterable[tuple[str, int, int]]):
        self.of: dict[str, tuple[list[int], list[int]]] = {}
        for name, start, end in sorted(units):
            starts, reach = self.of.setdefault(name, ([], []))
            starts.append(start)
            reach.append(max(end, reach[-1]) if reach else end)

    def holds(self, name: str, start: int, end: int) -> bool:
        starts, reach = self.of.get(name, ([], []))
        at = bisect.bisect_right(starts, start)
        return at > 0 and reach[at - 1] >= end


_FOUND = "array<struct<licence:string,unit:string,dice:double>>"


def _run(matcher: Matcher):
    kind = pa.list_(pa.struct([("licence", pa.string()), ("unit", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.scan(x.as_py() or "") for x in batch.column("_text")]
            rows = [[{"licence": a, "unit": u, "dice": d} for a, u, d in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(rows, kind)], names=["_rest", "found"])

    return run


def scan_licences(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``carry`` and ``found``, the units that match a template, for each row."""
    carried = Carried(carry, ("found",))
    rows = docs.select(carried.struct().alias("_rest"), quoted(text_col).cast("string").alias("_text"))
    schema = f"_rest {rows.schema['_rest'].dataType.simpleString()}, found {_FOUND}"
    return rows.mapInArrow(_run(Matcher(templates, threshold)), schema).select(*carried.columns("_rest"), "found")


def op10_licence_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.array_max(F.transform("found", lambda x: x["dice"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"]))), ",")
    rated = found.select("doc_id", "found", best.alias("best"), names.alias("licences"))
    first = F.get(F.filter("found", lambda x: x["dice"] == F.col("best")), 0)["licence"]
    return rated.select("doc_id", F.size("found").cast("long").alias("n_matches"), first.alias("licence"), F.round("best", 6).alias("dice"), "licences")
