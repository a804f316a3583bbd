"""Licence notices by the Dice coefficient over word bigrams.

A text's passages are its sentences, which lines end too, and its lines of several. A passage
is normalised (A-Z to lower case, all but letters a-z and digits parting words) and compared
with each template by twice the number of shared bigrams over the sum of both numbers of bigrams.

Two bounds leave out what cannot reach the threshold. By size, templates are compared only
with passages whose number of bigrams is near enough to theirs. And each template has anchor
words, the longest, so many that a passage without any of them lacks more bigrams than the
threshold allows; texts and passages without an anchor of any template go no further. All is
one projection of the scan: no shuffle, no Python.

Bodies are licence texts and headers of many lines. They are compared with windows: runs of
neighbouring sentences, joined across line ends, whose number of words the body's bounds allow
(twice the most distinct bigrams, as some repeat). Of windows that overlap the best is a hit. A
text goes on to windows only with so many of the bodies' words, and then so many of a body's
bigrams, that the threshold can be reached. The long licences hold their own header in the
instructions at their end, by which their full texts are found.

Results per row:

* a null or empty text, and passages of fewer than two words, match nothing;
* the best match has the largest coefficient, then the first name; without one, licence and
  dice are null and n_hits is 0;
* a notice inside a body is a hit besides it;
* each row is judged by itself, so repeated rows and null ids are like others; an empty table
  gives an empty table; only the key is kept of the columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import lower_ascii

# Short notices by which works name their licence.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
}

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms
of the GNU {0}General Public License as published by the Free Software Foundation, either version
{1} of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more
details. You should have received a copy of the GNU {0}General Public License along with this
program. If not, see <https://www.gnu.org/licenses/>."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Licence texts, and the headers by which files name the longer ones.
BODIES = {
    "AGPL-3.0": _GNU.format("Affero ", 3),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(
        """3. Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission.
"""
    ),
    "GPL-2.0": _GNU.format("", 2),
    "GPL-3.0": _GNU.format("", 3),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "LGPL-3.0": _GNU.format("Lesser ", 3),
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v.
2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is
free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
}

_WINDOW = "struct<minus_dice:double,name:string,start:int,end:int>"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, percent: int) -> tuple[int, int]:
    """The numbers of bigrams with which ``n`` can have a coefficient of ``percent``."""
    return math.ceil(n * percent / (200 - percent)), n * (200 - percent) // percent


def anchors(text: str, percent: int) -> list[str]:
    """Words of a template so that whatever has none of them falls below ``percent``."""
    pairs = bigrams_of(text)
    lacking = len(pairs) - size_bounds(len(pairs), percent)[0]  # the most that may be missing
    chosen: list[str] = []
    touched: set[str] = set()
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if len(touched) > lacking:
            break
        chosen.append(word)
        touched |= {pair for pair in pairs if word in pair.split(" ")}
    return chosen


def fewest_words(text: str, percent: int) -> int:
    """How many of a template's words a text has at least that reaches ``percent``."""
    pairs = bigrams_of(text)
    firsts = Counter(pair.split(" ")[0] for pair in pairs)
    sums = accumulate(n for _, n in firsts.most_common())
    low = size_bounds(len(pairs), percent)[0]
    return next(i for i, reached in enumerate(sums, 1) if reached >= low)


def passages(text: Column) -> Column:
    """Sentences, which lines end too, and whole the lines that have several."""
    sentences = F.split(F.regexp_replace(text, "([.!?])[ \\t]+", "$1\n"), "\n")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[.!?][ \\t]"))
    return F.concat(sentences, lines)


def bigrams(texts: Column) -> Column:
    """Distinct bigrams of each text of an array."""
    words = F.transform(
        texts, lambda p: F.filter(F.split(lower_ascii(p), "[^a-z0-9]+"), lambda w: w != "")
    )
    return F.transform(
        words,
        lambda own: F.array_distinct(
            F.transform(
                F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))),
                lambda word, i: F.concat(word, F.lit(" "), F.get(own, i + 1)),
            )
        ),
    )


def matches(text: Column, templates: Mapping[str, str], percent: int) -> Column:
    """Per passage that reaches the threshold the best template, as (dice, name)."""
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(len(bigrams_of(body))).alias("n"),
                F.lit(size_bounds(len(bigrams_of(body)), percent)[0]).alias("low"),
                F.lit(size_bounds(len(bigrams_of(body)), percent)[1]).alias("high"),
                F.array(*[F.lit(b) for b in bigrams_of(body)]).alias("bigrams"),
            )
            for name, body in sorted(templates.items())
        ]
    )
    anchor = "|".join(sorted({a for body in templates.values() for a in anchors(body, percent)}))

    def best(found: Column) -> Column:
        fitting = F.filter(known, lambda t: F.size(found).between(t["low"], t["high"]))
        def score(t: Column) -> Column:
            shared = F.size(F.array_intersect(found, t["bigrams"]))
            dice = 2.0 * shared / (F.size(found) + t["n"])
            return F.struct(dice.alias("dice"), t["name"].alias("name"))

        scored = F.transform(fitting, score)
        reached = F.filter(scored, lambda s: s["dice"] * 100 >= percent)
        return F.reduce(
            reached,
            F.lit(None).cast("struct<dice:double,name:string>"),
            lambda a, b: F.when(a.isNull() | (b["dice"] > a["dice"]), b).otherwise(a),
        )

    candidates = F.filter(passages(text), lambda p: lower_ascii(p).rlike(anchor))
    found = F.transform(bigrams(candidates), best)
    return F.when(
        lower_ascii(text).rlike(anchor), F.filter(found, lambda x: x.isNotNull())
    ).otherwise(F.array().cast("array<struct<dice:double,name:string>>"))


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def body_matches(text: Column, bodies: Mapping[str, str], percent: int) -> Column:
    """The windows that reach the threshold for a body and overlap no better one, as (dice,
    name)."""

    def listed(values: Iterable[str]) -> Column:
        return F.split(F.lit("|".join(sorted(values))), "[|]")

    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(len(bigrams_of(body))).alias("n"),
                F.lit(size_bounds(len(bigrams_of(body)), percent)[0]).alias("low"),
                F.lit(2 * size_bounds(len(bigrams_of(body)), percent)[1] + 1).alias("words"),
                listed(bigrams_of(body)).alias("bigrams"),
            )
            for name, body in sorted(bodies.items())
        ]
    )
    none = F.array().cast(f"array<{_WINDOW}>")
    vocabulary = listed({w for body in bodies.values() for w in words_of(body)})
    every = listed({b for body in bodies.values() for b in bigrams_of(body)})
    fewest = min(fewest_words(body, percent) for body in bodies.values())

    def windows(t: Column, pairs: Column, bounds: Column) -> Column:
        """Windows of a text with these bigrams, whose sentences start and end at ``bounds``."""

        def judged(start: Column, end: Column) -> Column:
            def score(own: Column) -> Column:
                shared = F.size(F.array_intersect(own, t["bigrams"]))
                return F.struct(
                    (-2.0 * shared / (F.size(own) + t["n"])).alias("minus_dice"),
                    t["name"].alias("name"),
                    start.alias("start"),
                    end.alias("end"),
                )

            return given(F.array_distinct(F.slice(pairs, start + 1, end - start - 1)), score)

        def ends_of(start: Column, i: Column) -> Column:
            ahead = F.slice(pairs, start + 1, t["words"])
            ends = F.filter(
                F.slice(bounds, i + 2, t["words"]),
                lambda end: (end - start).between(t["low"] + 1, t["words"]),
            )
            reached = F.filter(
                F.transform(ends, lambda end: judged(start, end)),
                lambda w: w["minus_dice"] * -100 >= percent,
            )
            enough = F.size(F.array_intersect(ahead, t["bigrams"])) >= t["low"]
            return F.when(enough, reached).otherwise(none)

        return F.flatten(F.transform(bounds, ends_of))

    def among(pieces: Column) -> Column:
        """Windows of a text's words, with a line end after each sentence."""
        marks = F.filter(
            F.transform(pieces, lambda x, i: F.when(x == "\n", i).otherwise(-1)), lambda i: i >= 0
        )
        cuts = F.transform(marks, lambda i, before: i - before)

        def of_words(own: Column) -> Column:
            bounds = F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.size(own))))
            pairs = F.transform(
                F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))),
                lambda word, i: F.concat(word, F.lit(" "), F.get(own, i + 1)),
            )
            return given(pairs, lambda p: of_pairs(p, bounds))

        return given(F.filter(pieces, lambda x: x != "\n"), of_words)

    def of_pairs(pairs: Column, bounds: Column) -> Column:
        def of_shared(shared: Column) -> Column:
            fitting = F.filter(
                known, lambda t: F.size(F.array_intersect(shared, t["bigrams"])) >= t["low"]
            )
            return F.when(
                F.size(fitting) > 0,
                given(
                    bounds,
                    lambda at: F.flatten(F.transform(fitting, lambda t: windows(t, pairs, at))),
                ),
            ).otherwise(none)

        return given(F.array_intersect(pairs, every), of_shared)

    sentences = F.regexp_replace(lower_ascii(text), "([.!?])[ \\t]+", "$1\n")
    pieces = F.filter(
        F.split(F.replace(sentences, F.lit("\n"), F.lit(" \n ")), "[^a-z0-9\n]+"),
        lambda x: x != "",
    )
    words = F.array_intersect(F.split(lower_ascii(text), "[^a-z0-9]+"), vocabulary)
    found = F.when(F.size(words) >= fewest, given(pieces, among)).otherwise(none)
    apart = F.aggregate(
        F.sort_array(found),
        none,
        lambda best, w: F.when(
            F.exists(best, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])), best
        ).otherwise(F.concat(best, F.array(w))),
    )
    return F.transform(
        apart, lambda w: F.struct((-w["minus_dice"]).alias("dice"), w["name"].alias("name"))
    )


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = NOTICES,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
    bodies: Mapping[str, str] | None = None,
) -> DataFrame:
    """Key, licence and dice of the best match, and n_hits, the passages and windows that match
    any."""
    found = matches(F.coalesce(F.col(text), F.lit("")), templates, percent)
    if bodies:
        more = body_matches(F.coalesce(F.col(text), F.lit("")), bodies, percent)
        found = F.concat(found, more)
    hits = docs.select(key, found.alias("hits"))
    best = F.reduce(
        "hits",
        F.lit(None).cast("struct<dice:double,name:string>"),
        lambda a, b: F.when(
            a.isNull()
            | (b["dice"] > a["dice"])
            | ((b["dice"] == a["dice"]) & (b["name"] < a["name"])),
            b,
        ).otherwise(a),
    )
    return hits.select(
        key,
        best["name"].alias("licence"),
        best["dice"].alias("dice"),
        F.size("hits").cast("long").alias("n_hits"),
    )
