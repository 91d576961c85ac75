"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text's words are compared wherever they stand: in each run of adjacent sentences and lines (so lines,
paragraphs and the whole text too), and in each window inside them that begins and ends with bigrams of
a template and has as many distinct ones as it; a copy in mid-sentence with words more or fewer isn't found. Text and templates are normalised alike (lower case, words of letters and digits with dots
inside), and distinct word bigrams compared: 2 * shared / (window's + template's). Copyright signs
and years at a line's start are left out; a text that has them is also read without those lines.

A Dice coefficient of at least ``LEAST`` needs sizes within a factor of (2 - LEAST) / LEAST, so
windows of other sizes are not compared, and as many shared bigrams as the template's size over that
factor, so a text that doesn't hold them anywhere isn't cut into windows for it. A passage must name the versions that
the template names, and no others: one word less in common is not another version, and neither is it a licence of
another name (lesser, affero; or one that no template has). A short notice that a text denies (not licensed under ...) isn't one.

Templates are notices, made from forms and names, and a few short texts, held by the code; callers may pass others, such as
whole licences.

Cases: null and empty texts have no licence; a passage matches its best template, ties by name (two
windows are one passage if more than half of each lies in the other); a document repeats each licence
once, with its best coefficient; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded

LEAST = 0.8
#: How notices name a licence, and the names of licences by SPDX name. Fixed values.
FORMS = ("Released under the {}.", "Licensed under the {}.", "Distributed under the {}.", "This project is licensed under the terms of the {}.")
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal License", "CC0 1.0 Universal Public Domain Dedication"),
    "Unlicense": ("Unlicense",),
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
#: Public licence notices and texts, by SPDX name (a LicenseRef where a notice leaves open which). Fixed values.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (_GNU.format("General Public License", 2),),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GNU.format("General Public License", 3)),
    "LGPL-2.1": (_GNU.format("Lesser General Public License", 2.1),),
    "LGPL-3.0": (_GNU.format("Lesser General Public License", 3),),
    "AGPL-3.0": (_GNU.format("Affero General Public License", 3),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "LicenseRef-BSD": (
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
}
TEMPLATES = {name: (*(form.format(own) for own in NAMES.get(name, ()) for form in FORMS), *TEXTS.get(name, ())) for name in {**TEXTS, **NAMES}}
WORDS = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
NOTICE = re.compile(r"(?im)^\W*(?:copyright\b|\(c\)|©).*$")
#: Only the copyright words, signs and years of such a line.
SIGNS = re.compile(r"(?im)^[^\w\n]*(?:copyright\b(?=\W*(?:\(c\)|©|\d{4}\b))|\(c\)|©)(?:[^\w\n]|\(c\)|copyright\b|\d{4}\b)*")
BREAK = re.compile(r"(?<=[.!?:;])[\"')\]]*\s+|\n")
#: A number as versions are written, and the words that a version follows.
VERSION = re.compile(r"v?(\d+(?:\.\d+)*)")
BEFORE_VERSION = frozenset("version v license gpl by sa nc apache attribution sharealike noncommercial cc0 mpl lgpl agpl".split())
#: Words that tell licences apart by name, and words that deny a notice. Fixed values.
NAMING = frozenset("lesser library affero gnu mit bsd isc apache mozilla mpl unlicense cc0 cc creative commons".split())
DENIALS = frozenset("not never no nor neither without isn aren wasn cannot".split())
#: Notices of at most so many bigrams can be denied; longer texts hold such words themselves.
SHORT = 25
KIND = "array<struct<licence:string,dice:double>>"


def spelled(text: str) -> list[str]:
    """The words of a text; spellings of licence are one."""
    return ["license" if w == "licence" else w for w in WORDS.findall(text.lower())]


def normal(text: str) -> list[str]:
    """The words that are compared, without copyright lines."""
    return spelled(NOTICE.sub(" ", text))


def bigrams(words: list[str]) -> frozenset:
    """Distinct pairs of neighbours; a single word is a pair of its own."""
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w, "") for w in words)


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def versions(words: list[str]) -> frozenset:
    """The versions that words name: numbers marked with v, or after a word that a version follows; and the words that tell
    licences apart."""
    found = set(NAMING.intersection(words))
    for before, word in zip(["", *words], words):
        if (m := VERSION.fullmatch(word)) and (word[0] == "v" or before in BEFORE_VERSION):
            found.add(m[1].removesuffix(".0"))
    return frozenset(found)


def compiled(templates: dict[str, tuple[str, ...]]) -> list[tuple[int, str, frozenset, frozenset]]:
    """(size, name, bigrams, versions) of each template, by size."""
    found = [(name, normal(t)) for name, texts in templates.items() for t in texts]
    return sorted(((len(b), name, b, versions(w)) for name, w in found for b in [bigrams(w)]), key=lambda t: t[:2])


def windows(pairs: list[tuple], b: frozenset) -> Iterator[tuple[int, int, float]]:
    """(start, end, coefficient) of the windows that begin and end with pairs of ``b`` and have as many distinct ones."""
    for start in (i for i, pair in enumerate(pairs) if pair in b):
        seen: set = set()
        for end in range(start, len(pairs)):
            seen.add(pairs[end])
            if len(seen) > len(b):
                break
            if len(seen) == len(b) and pairs[end] in b:
                yield start, end + 2, len(seen & b) / len(b)


def runs(words: list[str], cuts: list[int], b: frozenset, span: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, coefficient) of the runs of adjacent pieces that have a size to be compared with ``b``."""
    for at, start in enumerate(cuts):
        seen: set = set()
        shared, last = 0, start
        for end in cuts[at + 1 :]:
            if end == start + 1:
                yield start, end, dice(bigrams(words[start:end]), b)
                continue
            for pair in zip(words[last : end - 1], words[last + 1 : end]):
                if pair not in seen:
                    seen.add(pair)
                    shared += pair in b
            last = end - 1
            if len(seen) > len(b) * span:
                break
            if len(seen) * span >= len(b):
                yield start, end, 2 * shared / (len(seen) + len(b))


def passages(text: str, table: list[tuple[int, str, frozenset, frozenset]], least: float) -> Iterator[tuple[float, str]]:
    """(coefficient, licence) of each passage of a text that matches a template."""
    words, span = spelled(text), (2 - least) / least
    pairs = list(zip(words, words[1:]))
    held = {*pairs, *((w, "") for w in words)}
    likely = [(name, b, own) for size, name, b, own in table if size and len(b & held) * span >= size - 1e-9]
    if not likely:
        return
    cuts = [0]
    for piece in BREAK.split(text):
        if n := len(WORDS.findall(piece)):
            cuts.append(cuts[-1] + n)

    def denied(start: int, end: int, b: frozenset) -> bool:
        # Up to three words before a notice count, in its own sentence.
        begin = max(start - 3, cuts[bisect_right(cuts, start) - 1])
        return len(b) <= SHORT and not DENIALS.isdisjoint(words[begin:end])

    found = {(-d, name, start, end) for name, b, own in likely for kind in (windows(pairs, b), runs(words, cuts, b, span)) for start, end, d in kind if d >= least and versions(words[start:end]) == own and not denied(start, end, b)}
    over = defaultdict(list)
    for d, name, start, end in sorted(found):
        if any(2 * (min(end, e) - max(start, s)) > max(end - start, e - s) for s, e in over[(start + end) // 2]):
            continue
        for place in range(start, end):
            over[place].append((start, end))
        yield -d, name


def scan(text: str | None, table: list[tuple[int, str, frozenset, frozenset]], least: float) -> list[tuple[str, float]]:
    """(licence, coefficient) of each licence in a text, by name."""
    found: dict[str, float] = {}
    whole, without = SIGNS.sub(" ", text or ""), NOTICE.sub(" ", text or "")
    for version in {whole, without}:
        for d, name in passages(version, table, least):
            found[name] = max(d, found.get(name, 0.0))
    return sorted(found.items())


def scanned(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id and ``licences``, an array of (licence, dice), for each row of ``docs``."""
    table = compiled(templates)

    @F.pandas_udf(KIND)
    def look(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"licence": n, "dice": d} for n, d in scan(t, table, least)])

    return bounded(docs).select("doc_id", look("text").alias("licences"))
