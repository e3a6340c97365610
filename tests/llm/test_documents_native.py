"""License scan and Merkle trees on odd and chosen rows."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from newsloom.llm.licenses import TEMPLATES, anchors, plain_bigrams, plain_words, scan
from newsloom.llm.merkle import differing, edit_report, fingerprint, likeness, tree, with_next


# Texts as they are found in files, written down without looking at the templates.
FOUND = {
    "MIT-permission": "/* Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files (the\n * \"Software\"), to deal in the Software without restriction, including\n * without limitation the rights to use, copy, modify, merge, publish,\n * distribute, sublicense, and/or sell copies of the Software, and to\n * permit persons to whom the Software is furnished to do so, subject to\n * the following conditions: */",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0": "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. See the LICENSE file for the full terms.",
    "Proprietary-short": "All rights reserved.",
    "MPL-2.0": "-- This Source Code Form is subject to the terms of the Mozilla Public\n-- License, v. 2.0.",
    "ISC-text": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "this file is released under the MIT license, as all of them",
    "CC-BY-SA-4.0": "Text licensed under CC BY-SA 4.0 unless noted",
}


def test_licenses_as_they_are_found(frame):
    """Each alone, with a comment's stars, and in the middle of one long line and of a wrapped block."""
    prose = "and some more words about nothing that go on and on for a while until the line ends somewhere "
    rows, want = [], {}
    for i, (name, text) in enumerate(FOUND.items()):
        flat = " ".join(text.split())
        wrapped = (prose + flat + " " + prose).split()
        forms = [text, prose * 4 + flat + " " + prose * 4, "\n".join(" ".join(wrapped[k : k + 7]) for k in range(0, len(wrapped), 7))]
        for k, form in enumerate(forms):
            rows.append((10 * i + k, form, "s"))
            want[10 * i + k] = name
    rows.append((999, prose * 30, "s"))
    got = {r.doc_id: r for r in scan(frame(rows)).collect()}
    assert got[999].n_notices == 0 and got[999].license is None
    for doc_id, name in want.items():
        assert got[doc_id].n_notices > 0 and got[doc_id].license.startswith(re.sub("-(header|text|use|permission|grant|conditions|short)$", "", name)), (doc_id, name, got[doc_id])


def test_licenses_of_chosen_texts(frame):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose.", "s"), (2, "THIS WORK IS LICENSED, under the GNU General Public License (version 3)!", "s"),
        (4, "nothing here", "s"), (5, "released under MIT", "s"), (6, "Released under the MIT License.\nReleased under the MIT License.", "s"),
    ]
    got = {r.doc_id: r for r in scan(frame(rows)).collect()}
    assert [(got[i].license, got[i].dice) for i in (1, 2, 4, 5, 6)] == [("MIT", 1.0), ("GPL-3.0", 1.0), (None, None), (None, None), ("MIT", 1.0)]
    assert got[1].n_notices == 1 and got[4].n_notices == got[5].n_notices == 0


def test_licenses_against_plain_python(frame, odd_texts):
    rows = [(i, t, "s") for i, t in enumerate([*TEMPLATES.values(), "Licensed under CC BY-NC 4.0", "Licensed under CC 4.0 BY", "released under the BSD license", None])]

    def best(text):
        found = []
        units = {" ".join(plain_words(u)) for u in (text or "").split("\n") + re.split(r"(?<=[.!?:])\s+", text or "") + [text or ""]}
        whole = plain_words(text or "")
        for pair, place, size in anchors(TEMPLATES).values():
            units |= {" ".join(whole[max(0, i - place) :][:size]) for i in range(len(whole) - 1) if " ".join(whole[i : i + 2]) == pair}
        for unit in units:
            a = set(plain_bigrams(unit))
            for name, template in TEMPLATES.items():
                b = set(plain_bigrams(template))
                dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if dice >= 0.7:
                    found.append((-dice, name))
        return min(found, default=(None, None))

    for r in scan(frame(rows)).collect():
        dice, name = best(rows[r.doc_id][1])
        assert (r.license, r.dice) == (name, None if dice is None else -dice)
    assert scan(frame(odd_texts)).count() == len(odd_texts) and scan(frame([])).collect() == []


def test_edit_report_follows_the_contract(frame, odd_texts):
    rows = [(i, t) for i, (_, t, _) in enumerate(odd_texts)]
    got = {r.doc_id: r for r in edit_report(frame([(*r, "s") for r in rows])).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        text, following = text or "", rows[i - 1][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (edited == text) and (r.near_edited == 1.0) >= (edited == text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1.0) >= (text == following)
    assert got[7].fingerprint == got[8].fingerprint and got[8].near_next == 1.0
    assert 0.5 < got[8].near_edited <= 1 and got[9].near_next > 0.9


def test_rows_of_one_id_and_without_id(frame, odd_texts):
    assert with_next(frame(odd_texts)).count() == len(odd_texts)
    one = with_next(frame([(7, "only", "s")])).collect()
    assert [(r.text, r.next) for r in one] == [("only", "only")]
    assert edit_report(frame([])).collect() == []
    many = with_next(frame([(i * i, f"t{i}", "s") for i in range(500)])).collect()
    assert {(r.text, r.next) for r in many} == {(f"t{i}", f"t{(i - 1) % 500}") for i in range(500)}


def test_branches_locate_edits(spark):
    a = "first line\nsecond line\n\nnext section\nwith lines\n\nlast"
    b = "first line\nsecond line\n\nnext section\nwith changed lines\n\nlast"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(tree(F.col("a")).alias("a"), tree(F.col("b")).alias("b"))
    df = df.select("a", "b", fingerprint(F.col("a")).alias("f"), fingerprint(F.col("b")).alias("g"))
    row = df.select(differing(F.col("a"), F.col("b")).alias("d"), differing(F.col("a"), F.col("a")).alias("none"), likeness(F.col("f"), F.col("g")).alias("n"), "f", "g").first()
    assert [tuple(x) for x in row.d] == [(1, 1)] and row.none == [] and 0 < row.n < 1 and row.f != row.g


def by_hand(f, g):
    """The likeness of two fingerprints, from nothing but the two strings."""
    (r, _, x), (s, _, y) = f.split(":"), g.split(":")
    x, y = ({t[i : i + 8] for i in range(0, len(t), 8)} for t in (x, y))
    least = set(sorted(x | y)[:128])
    j = len(x & y & least) / max(1, len(least))
    return 1.0 if r == s else 2 * j / (1 + j)


def test_fingerprints_carry_their_likeness(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(edit_report(docs).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, r in enumerate(rows):
        assert r.near_edited == by_hand(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == by_hand(r.fingerprint, rows[i - 1].fingerprint)
        # Two thirds of the edited text are unchanged.
        assert r.near_edited > 0.3 or r.n_chars < 60, texts[r.doc_id]


def test_one_grain_for_all_lengths(spark):
    words = [f"word{i * 7919 % 997}" for i in range(80)]
    cases = []
    for size in (40, 60, 64, 68, 250, 252, 256, 260, 500):
        text = " ".join(words)[:size]
        cases += [(size, text, text + " tail"), (size, text, "x " + text)]
    cases += [(257, "a" * 252, "a" * 252 + "bbbbb"), (300, "line one of many\n" * 40 + "end", "line one of many\n" * 40 + "other end here")]
    df = spark.createDataFrame(cases, "n int, a string, b string").select("n", fingerprint(tree(F.col("a"))).alias("f"), fingerprint(tree(F.col("b"))).alias("g"))
    for r in df.select("n", likeness(F.col("f"), F.col("g")).alias("near")).collect():
        assert r.near > (0.9 if r.n >= 250 else 0.5), r
