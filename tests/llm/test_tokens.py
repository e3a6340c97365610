"""Both encoders against the tokenizers library, and token files against what was written."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm.bpe import WordCoder, encode
from newsloom.llm.token_files import ByteCoder, from_planes, read_ids, to_planes, write_ids
from newsloom.session import new_path

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", " a", "a  b", "a   b", "a \n b", "a\n\n b", "x <|endoftext|> y<|endoftext|>z<|startoftext|>", "\t \t x", "日本 語 テキスト！！", "It's they'LL don't 'S 's",
    "1 2 33 ½ １２", "x_ y __ z", "a b   c　d", "ΣΑΣ ΌΔΟΣ İstanbul ﬁ ǅ", "àb é", "x\x1cy \x1f z\x00\x01", "🎉🎉 ok", "a \r\n\r\n  b", "aaaa aaaaaaa", "''''s", "trail  ", "<|end",
]


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_word_coder_on_odd_texts():
    library, own = Tokenizer.from_file(WORDS), WordCoder(WORDS)
    own.learn({w for t in ODD for w in own.words(t)})
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == " ".join(map(str, ids)), text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False), text


def test_byte_coder_on_odd_texts():
    library, own = Tokenizer.from_file(BYTES), ByteCoder(BYTES)
    for text in ODD:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_op3(spark, sf_dir):
    from newsloom.llm.queries import QUERIES

    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, sf_dir).collect()}
    rows = texts(spark, sf_dir)
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want


def test_encode_outputs_and_odd_rows(frame, odd_texts):
    library = Tokenizer.from_file(WORDS)
    rows = encode(frame(odd_texts), WORDS, ["doc_id", "text", "c0"], ["ids", "decoded"], block=1).collect()
    assert len(rows) == len(odd_texts) and {r.c0 for r in rows} == {"x"}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    assert encode(frame([]), WORDS, ["doc_id"], ["ids"]).collect() == []


def follow(rows, library):
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((str(doc_id), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(want)


def test_op7(spark, sf_dir):
    from newsloom.llm.queries import QUERIES

    got = sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, sf_dir).collect())
    assert got == follow(texts(spark, sf_dir), Tokenizer.from_file(BYTES))


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_of_odd_rows(spark, frame, odd_texts, bits):
    path = new_path(spark, "test-tokens")
    write_ids(frame(odd_texts), path, BYTES, bits=bits)
    got = sorted((str(r.doc_id), r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read_ids(spark, path).collect())
    assert got == follow([r[:2] for r in odd_texts], Tokenizer.from_file(BYTES))
    index = spark.read.parquet(f"{path}/index/chunks").collect()
    assert sum(r.n_docs for r in index) == len(odd_texts) and sum(r.n_ids for r in index) == sum(g[2] for g in got)


def test_token_files_of_an_empty_table(spark, frame):
    path = new_path(spark, "test-tokens")
    write_ids(frame([]), path, BYTES)
    assert read_ids(spark, path, digest=True).collect() == []


def test_planes():
    ids = np.random.default_rng(0).integers(0, 50_000, 1001).astype("<u4")
    for bits in (False, True):
        assert (from_planes(to_planes(ids, bits), len(ids)) == ids).all()
