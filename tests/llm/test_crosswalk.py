"""The alignment against both libraries on whole texts, links found token by token; bitmaps against sets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from test_tokens import ODD, texts
from tokenizers import Tokenizer

from newsloom.llm.bpe import byte_letters
from newsloom.llm.crosswalk import PairBitmaps, crosswalk, pair_counts, pair_index

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}

    def pieces_a(text):
        return [(e, bytes(byte_of[c] for c in a.id_to_token(e))) for e in a.encode(" " + text, add_special_tokens=False).ids]

    def pieces_b(text):
        out = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()))
        return out

    found = []
    for doc_id, text in rows:
        ta, tb, links, groups = [], [], [], []
        if text:
            ta, tb, full = pieces_a(text), pieces_b(text), (" " + text).encode()
            if b"".join(x for _, x in ta) != full or b"".join(x for _, x in tb) != full:
                ta, tb = [], []
        i = j = end_a = end_b = 0
        group = ([], [])
        while i < len(ta) or j < len(tb):
            if end_a <= end_b:
                end_a, i, new = end_a + len(ta[i][1]), i + 1, 0
            else:
                end_b, j, new = end_b + len(tb[j][1]), j + 1, 1
            group[new].append(str((ta, tb)[new][(i, j)[new] - 1][0]))
            if end_a == end_b:
                groups.append(",".join(group[0]) + "|" + ",".join(group[1]))
                group = ([], [])
        at = 0
        for x, data in ta:
            lo, hi, pos = at, at + len(data), 0
            at = hi
            if len(full) > 4000:
                continue
            for y, other in tb:
                if pos < hi and pos + len(other) > lo:
                    links.append((x, y))
                pos += len(other)
        if ta and len(full) > 4000:  # the same by two pointers
            pos_a = pos_b = i = j = 0
            while i < len(ta) and j < len(tb):
                links.append((ta[i][0], tb[j][0]))
                to_a, to_b = pos_a + len(ta[i][1]), pos_b + len(tb[j][1])
                if to_a <= to_b:
                    pos_a, i = to_a, i + 1
                if to_b <= to_a:
                    pos_b, j = to_b, j + 1
        found.append((doc_id, len(ta), len(tb), len(groups), links, ";".join(groups)))
    count = Counter(x for f in found for x in f[4])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(d, na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), g) for d, na, nb, ng, ls, g in found], count


def test_whole_table(spark, sf_dir):
    from newsloom.llm.queries import QUERIES

    want, _ = brute(texts(spark, sf_dir))
    got = QUERIES["op11_crosswalk"](spark, sf_dir).collect()
    hashed = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want]
    assert sorted(map(tuple, got)) == sorted(hashed)


def test_odd_rows(spark, frame, odd_texts):
    rows = [*odd_texts, *[(100 + i, t, "x") for i, t in enumerate(ODD)], (200, "a\u2581b", "x"), (201, "x\n \ny  z \n\n q ", "x"), (202, "trail ", "x"), (203, "  two", "x")]
    want, count = brute([r[:2] for r in rows])
    for block in ({}, {"block_docs": 3, "block_bytes": 100}):
        assert sorted(map(str, map(tuple, crosswalk(frame(rows), A, B, **block).collect()))) == sorted(map(str, want))
    pairs = pair_counts(pair_index(frame(rows), A, B, block_docs=3)).collect()
    assert {(r.pair >> 24, r.pair & 0xFFFFFF): r.n_links for r in pairs} == count
    assert all(0 < r.n_docs <= r.n_links for r in pairs)
    assert crosswalk(frame([]), A, B).collect() == []


def test_bitmaps():
    pick = np.random.default_rng(5)
    want, parts = Counter(), []
    for part in range(3):
        pair = np.concatenate([np.full(9000, 77), pick.integers(0, 40, 5000) << 30])
        doc = part * 20_000 + np.concatenate([np.arange(9000), pick.integers(0, 20_000, 5000)])
        keys, links = np.unique(pair << 16 | doc, return_counts=True)
        links = links * pick.integers(1, 9, len(links))
        want.update(dict(zip(keys.tolist(), links.tolist(), strict=True)))
        parts.append(PairBitmaps.of(keys, links))
    whole = PairBitmaps.merged(parts)
    whole = PairBitmaps.unpacked(whole.pairs, whole.packed())
    docs, links = whole.popcounts()
    for i, pair in enumerate(whole.pairs.tolist()):
        mine = {k: n for k, n in want.items() if k >> 16 == pair}
        assert (docs[i], links[i]) == (len(mine), sum(mine.values()))
    scores = pick.integers(1, 1000, len(whole.pairs))
    expected = np.zeros(1 << 16, np.int64)
    for k, n in want.items():
        expected[k & 0xFFFF] += n * scores[np.searchsorted(whole.pairs, k >> 16)]
    assert (whole.returned(scores, 1 << 16) == expected).all()
