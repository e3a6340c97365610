"""Counts against the tokenizers library, and the merging of odd sequences against merging pair by pair."""

from __future__ import annotations

import random

import public_tokenizers
from test_tokens import ODD, texts
from tokenizers import Tokenizer

from newsloom.llm.token_counts import TokenCounter, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def library_counts(rows):
    library = Tokenizer.from_file(WORDS)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows]


def test_odd_texts():
    assert TokenCounter(WORDS).count(ODD) == library_counts(ODD)


def test_long_words_beside_short_ones():
    pick = random.Random(3)
    words = ["a" * n for n in (1, 2, 3, 4, 5, 7, 31, 4000)] + ["abab" * 999, "日本語テキスト" * 500, "", "x"]
    words += ["".join(pick.choices("etaoinshrdlu", k=n)) for n in (1, 5, 50, 500, 20_000)]
    assert TokenCounter(WORDS).count(words) == library_counts(words)
    assert TokenCounter(WORDS).count([" ".join(words)]) == library_counts([" ".join(words)])


def test_whole_table(spark, sf_dir):
    from newsloom.llm.queries import QUERIES

    rows = texts(spark, sf_dir)
    want = {doc_id: (len(text.encode()), n, n > 2048) for (doc_id, text), n in zip(rows, library_counts([t for _, t in rows]), strict=True)}
    got = QUERIES["op13_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want


def test_odd_rows(frame, odd_texts):
    got = token_counts(frame(odd_texts), WORDS, limit=5, carry=("doc_id", "text", "c0"), block=1).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(r[0]), r[1] or "") for r in odd_texts)
    for r, n in zip(got, library_counts([r.text for r in got]), strict=True):
        assert (r.n_tokens, r.n_bytes, r.over_limit, r.c0) == (n, len((r.text or "").encode()), n > 5, "x")
    assert token_counts(frame([]), WORDS).collect() == []
