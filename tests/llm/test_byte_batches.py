"""Many texts at once through the byte-level coder, against the tokenizers library applied to each."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from newsloom.llm import token_files
from newsloom.llm.token_files import ByteCoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "word", "Words", "is", "ist", "été", "ß", "日本", "ΣΑΣ", "ª", "½", "１", "12", "don't", "'s", "'S", "...", "_", "***", "\"", "¿", "—", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x85",
    "á", "🎉", "<|endoftext|>", "<|", "|>", "\x00",
]


def ids(coder: ByteCoder, texts: list[str]) -> list[list[int]]:
    return [np.frombuffer(x, "<u4").tolist() for x in coder.encode_all(pa.array(texts, pa.large_string()))]


@pytest.mark.parametrize("gaps", [[" ", ""], [" ", " ", "  ", "   ", ""]])
def test_texts_of_odd_pieces(gaps):
    library, coder, rng = Tokenizer.from_file(BYTES), ByteCoder(BYTES), random.Random(3)
    texts = ["", " ", "a"] + ["".join(rng.choice(PIECES) + rng.choice(gaps) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(coder, texts) == want
    assert ids(coder, texts[:1]) == [[]] and ids(coder, []) == []
    assert ids(coder, texts) == want, "from the memo"


def test_each_word_of_many_texts_is_encoded_once(monkeypatch):
    coder, met, one = ByteCoder(BYTES), [], ByteCoder._one
    monkeypatch.setattr(ByteCoder, "_one", lambda self, word: met.append(word) or one(self, word))
    monkeypatch.setattr(token_files, "MEMO_WORDS", 8)
    texts = [f"x alpha beta gamma delta, eps{i % 2}" for i in range(50)]
    library = Tokenizer.from_file(BYTES)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(coder, texts) == want
    assert len(met) == len(set(met)), "words met again were encoded again"
    assert ids(coder, texts) == want and ids(coder, texts) == want
    assert len(met) == len(set(met)), "words that are met again and again leave the memo"
