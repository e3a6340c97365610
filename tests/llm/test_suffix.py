"""Cut passages against counting every string of the given length."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm.suffix import cut_repeats, repeated


def exact(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1]))
        yield len(b), sum(cut), spans, bytes(x for x, c in zip(b, cut, strict=True) if not c)


def check(df, texts, **options):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut_repeats(df, ["doc_id"], **options).collect())
    assert got == sorted(exact(texts, options.get("length", 200)))


def passages(rng):
    alphabet = "abcdefgh é\n"
    new = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [new(n) for n in (199, 200, 201, 260, 900)]
    texts = []
    for _ in range(120):
        parts = [new(rng.randrange(150)) if rng.random() < 0.6 else rng.choice(shared)[rng.randrange(3) :] for _ in range(rng.randrange(7))]
        texts.append("".join(parts))
    return texts + texts[:3] + ["x" * 450, "ab" * 170, shared[3] + shared[3]]


@pytest.mark.parametrize("crowd", [32_768, 2])
def test_passages(frame, crowd):
    texts = passages(random.Random(1))
    check(frame([(i, t, "s") for i, t in enumerate(texts)]), texts, crowd=crowd)


def test_edge_cases(frame, odd_texts):
    check(frame(odd_texts), [r[1] for r in odd_texts])


def test_short_strings(frame):
    texts = ["abcabcabd", "xxabcyy", "", None, "aaaa", "zzz"]
    check(frame([(i, t, "s") for i, t in enumerate(texts)]), texts, length=3)


def test_whole_characters(frame):
    df = cut_repeats(frame([(1, "é" * 101 + "x", "s"), (2, "y" + "é" * 101, "s")]), ["doc_id", "score"], characters=True)
    assert sorted((r.doc_id, bytes(r.kept).decode(), r.score) for r in df.collect()) == [(1, "x", "x"), (2, "y", "x")]


def test_empty_table(frame):
    assert cut_repeats(frame([]), ["doc_id"]).collect() == []


def test_repeated_against_a_counter():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[2000:2600] = raw[300:900]
    start, group = np.arange(2900), rng.integers(0, 2, 2900)
    seen = Counter((g, raw[s : s + 100].tobytes()) for s, g in zip(start, group, strict=True))
    want = [seen[g, raw[s : s + 100].tobytes()] > 1 for s, g in zip(start, group, strict=True)]
    assert repeated(raw, start, group, 100).tolist() == want
