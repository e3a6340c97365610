"""License notices and license texts in documents, in DataFrame operations only.

A text is looked at in units: its lines, its blocks between empty lines, its sentences, itself, and
*windows*. A window is as many words as a template has, laid where a rare pair of words of the
template stands, so that a notice is found in the middle of a line, or wrapped inside a longer block. A unit is
normalised to lower-case words, and compared by its word bigrams to each template with the Dice
coefficient ``2 * shared / (a + b)``. A Dice of at least t needs ``a`` between ``t / (2 - t)`` and
``(2 - t) / t`` times ``b``, so most templates are left out by size before bigrams are compared,
and units of a size that fits no template are not compared at all. Everything happens inside the
row: no shuffle, and no unit is ever moved.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which public licenses are named, the usual headers of files, and license texts as they are published.
_NO_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission. "
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
)
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _GPL.format("Affero ", 3),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "Apache-2.0-use": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause-text": _BSD_2 + _NO_WARRANTY_BSD,
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-text": _BSD_2 + _BSD_3 + _NO_WARRANTY_BSD,
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GPL.format("", 2),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GPL.format("", 3),
    "ISC": "Released under the ISC License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        "this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-header": _GPL.format("Lesser ", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _GPL.format("Lesser ", 3),
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MIT-permission": _MIT,
    "MIT-text": _MIT + _MIT_REST,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "Proprietary": "All rights reserved. Unauthorized copying is prohibited.",
    "Proprietary-short": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.7
# Fixed value: words that many texts without a notice have. They only order the choice of cues and change no result.
EVERYDAY = frozenset("a all an and any are as at be been but by for from has have in is it its more no not of on one or other such that the this to under was were will with without you".split())


def plain_bigrams(text: str) -> list[str]:
    """The different word bigrams of a template, normalised as in ``bigrams``."""
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def words_of(unit: Column) -> Column:
    """Lower-case words of ASCII letters and digits; what else there is parts words."""
    plain = F.trim(F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))
    return F.split(plain, " ")


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.size(words) - 1))


def plain_words(text: str) -> list[str]:
    """The words of a template, normalised as in ``words_of``."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def anchors(templates: dict[str, str]) -> dict[str, tuple[str, int, int]]:
    """Of each template the pair of words that fewest templates have (the longest of them, then the first), its place, and the number of words."""
    pairs = {name: [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] for name, words in ((n, plain_words(t)) for n, t in templates.items())}
    holders = Counter(p for own in pairs.values() for p in set(own))
    chosen = {name: min(own, key=lambda p: (holders[p], own.count(p), -len(p), own.index(p))) for name, own in pairs.items() if own}
    return {name: (p, pairs[name].index(p), len(pairs[name]) + 1) for name, p in chosen.items()}


def cues(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which a text has at least one, if any unit of it reaches the threshold with any template.

    Such a unit shares at least ``t / (2 - t)`` of a template's bigrams, so it has one of any choice of more than the
    rest of them; that many bigrams are chosen by the longest words that they hold, everyday words last.
    """
    out: set[str] = set()
    for text in templates.values():
        grams = {tuple(g.split(" ")) for g in plain_bigrams(text)}
        spare = _spare(len(grams), threshold)
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w in EVERYDAY, -len(w), w)):
            if len(grams) == 0 or spare < 0:
                break
            hit = {g for g in grams if word in g}
            out.add(word)
            grams, spare = grams - hit, spare - len(hit)
    return sorted(out)


def cue_pairs(templates: dict[str, str], threshold: float) -> list[str]:
    """Word bigrams of which a text has at least one, if any unit of it reaches the threshold.

    They are chosen as in ``cues``: the longest of each template, those with everyday words last.
    """
    out: set[str] = set()
    for text in templates.values():
        grams = plain_bigrams(text)
        out |= set(sorted(grams, key=lambda g: (len(EVERYDAY & set(g.split(" "))), -len(g), g))[: _spare(len(grams), threshold) + 1])
    return sorted(out)


def _spare(n: int, threshold: float) -> int:
    """How many of a template's n bigrams a unit that reaches the threshold can lack."""
    return n - math.ceil(threshold / (2 - threshold) * n - 1e-9)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def windows(plain: Column, templates: dict[str, str]) -> Column:
    """For each template the windows of the normalised text (words parted by blanks) where its anchor stands, as texts."""
    none = F.array().cast("array<string>")

    def laid(words: Column) -> Column:
        found = []
        for pair, place, size in anchors(templates).values():
            padded = F.concat(F.lit(" "), plain, F.lit(" "))
            found.append(F.when(F.contains(padded, F.lit(f" {pair} ")), _windows_at(words, pair, place, size)).otherwise(none))
        return F.concat(*found)

    return _once(F.split(plain, " "), laid)


def _windows_at(words: Column, pair: str, place: int, size: int) -> Column:
    first, second = pair.split(" ")
    here = lambda i: (F.get(words, i) == first) & F.coalesce(F.get(words, i + 1) == second, F.lit(False))
    cut = lambda i: F.array_join(F.slice(words, F.greatest(i - place, F.lit(0)) + 1, F.lit(size)), " ")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), cut)


def normalised(text: Column) -> Column:
    return F.array_join(words_of(text), " ")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_notices, license, dice`` of every row.

    ``n_notices`` counts the different units (lines, blocks, sentences, the text, windows; as
    normalised words) that reach ``threshold`` with a template; ``license`` is the template with
    the highest Dice among them, the first by name of equal ones, NULL without any. A NULL text is empty.
    Repeated rows stay.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    known = [(name, plain_bigrams(text)) for name, text in sorted(templates.items())]
    known = [(name, grams) for name, grams in known if grams]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(g) for _, g in known) * low, max(len(g) for _, g in known) * high

    def compared(own: Column) -> Column:
        """The best template of a unit's bigrams as ``struct<dice, back>``; a smaller ``back`` is a later name."""
        n = F.size(own)

        def one(place: int, grams: list[str]) -> Column:
            shared = F.size(F.array_intersect(own, F.array(*[F.lit(g) for g in grams])))
            fits = (n >= len(grams) * low) & (n <= len(grams) * high)
            return F.when(fits, F.struct((2 * shared / (n + len(grams))).alias("dice"), F.lit(-place).alias("back")))

        return F.when((n >= least) & (n <= most), F.array_max(F.array(*[one(i, g) for i, (_, g) in enumerate(known)])))

    def best(unit: Column) -> Column:
        words = F.transform(F.array(F.split(unit, " ")), lambda w: F.when(F.size(w) > least, bigrams(w)))
        return F.transform(words, compared)[0]

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sentences = F.split(F.regexp_replace(text, r"([.!?:])[ \t\r\n]+", "$1\u0001"), "\u0001")
    raw = F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), sentences)
    plain = F.transform(F.array_distinct(raw), normalised)
    # Most texts have no word, then no pair of words, that every match needs one of: nothing of them is compared.
    some, pairs = (F.array(*[F.lit(c) for c in choose(templates, threshold)]) for choose in (cues, cue_pairs))
    likely = lambda whole: _once(F.split(whole, " "), lambda w: F.arrays_overlap(w, some) & F.arrays_overlap(bigrams(w), pairs))
    units = _once(normalised(text), lambda whole: F.when(
        likely(whole), F.array_distinct(F.concat(plain, F.array(whole), windows(whole, templates)))
    ).otherwise(F.array().cast("array<string>")))
    hits = F.filter(F.transform(units, best), lambda h: h["dice"] >= threshold)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), hits.alias("hits"))
    top = F.array_max("hits")
    names = F.array(*[F.lit(name) for name, _ in known])
    rows = rows.select("doc_id", F.size("hits").cast("long").alias("n_notices"), top.alias("top"))
    return rows.select("doc_id", "n_notices", F.get(names, -F.col("top.back")).alias("license"), F.col("top.dice").alias("dice"))
