"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a block of a partition are encoded together. Their symbols stand in one
array; the index maps each pair to all its positions in it, kept under the pair's rank. Ranks are
applied in ascending order, each at all its positions at once, and the pairs that arise beside a
merge go to the lists of their own ranks. Ranks far ahead wait in one heap of arrays until their
window of ranks comes, so a merge touches few lists.

Texts are cut at white space, which never lies inside a token of these vocabularies, so a text's
ids are those of its words one after another. Words met before are kept in a bounded memo of the
task; the vocabulary stays with the Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import in_pieces, worker_memo

BLOCK_BYTES = 4 << 20
MEMO_WORDS = 200_000
CONTROL = re.compile("[\x1c-\x1f]")
#: Windows of ranks; pairs of later windows wait unsorted.
WINDOWS = (32, 128, 512, 1024, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 24576, 32768)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """The merge rules of a vocabulary as arrays, and the encoding of many words with them."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        parts = np.array([[vocabulary[a], vocabulary[b]] for a, b in pairs], np.int64).reshape(-1, 2)
        made = [vocabulary[a + b] for a, b in pairs]
        self.left, self.right, self.made = parts[:, 0], parts[:, 1], np.array(made, np.int64)
        last = {}
        for rank, token in enumerate(made):
            last[token] = rank
        if any(last.get(t, -1) > rank for rank, pair in enumerate(parts.tolist()) for t in pair):
            raise ValueError("a merge rule uses a token that a later rule makes")
        keys = self._key(self.left, self.right)
        self._order = np.argsort(keys)
        self._keys = np.concatenate([keys[self._order], [np.iinfo(np.int64).max]])
        self._ranks = np.concatenate([self._order, [0]])
        letters = byte_letters()
        self.inside = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in letters], np.int64)
        self.none = len(pairs)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a << 20) + b

    def _rank(self, symbols: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = self._key(symbols[at], symbols[after[at]])
        place = np.searchsorted(self._keys, key)
        return np.where(self._keys[place] == key, self._ranks[place], self.none)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the offsets of the words."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbols = np.full(n + 1, -1, np.int64)
        symbols[:n] = self.inside[raw]
        closing = ends[sizes > 0] - 1
        symbols[closing] = self.final[raw[closing]]
        after = np.arange(1, n + 2)
        after[closing], after[n] = n, n
        before = np.arange(-1, n)
        before[(ends - sizes)[sizes > 0]] = n
        before = np.append(before, n)[: n + 1]
        at = np.arange(n)
        rank = self._rank(symbols, after, at)
        waiting = [(rank[rank < self.none], at[rank < self.none])]
        for bound in (*WINDOWS, self.none):
            ranks, places = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (at[:0], at[:0])
            near = ranks < bound
            waiting = [(ranks[~near], places[~near])]
            self._window(symbols, after, before, ranks[near], places[near], bound, waiting)
        alive = symbols[:n] >= 0
        counts = np.concatenate([[0], np.cumsum(alive)])
        return symbols[:n][alive], np.concatenate([[0], counts[ends]]) if len(words) else np.zeros(1, np.int64)

    def _window(self, symbols, after, before, ranks, places, bound, waiting) -> None:
        """Apply all ranks below ``bound``, beginning with the given occurrences."""
        turn = np.argsort(ranks, kind="stable")
        ranks, places = ranks[turn], places[turn]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else []
        index = {int(ranks[s]): [p] for s, p in zip(starts, np.split(places, starts[1:]), strict=True)} if len(ranks) else {}
        heap = sorted(index)
        n = len(symbols) - 1
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            # Occurrences that an earlier merge took apart are still listed.
            at = at[(symbols[at] == a) & (symbols[after[at]] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                at = np.sort(at)
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = after[at]
            made = self.made[rank]
            symbols[at], symbols[gone] = made, -2
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            near = np.concatenate([before[at], at[symbols[beyond] != made]])
            near = near[near < n]
            arisen = self._rank(symbols, after, near)
            known = arisen < self.none
            arisen, near = arisen[known], near[known]
            soon = arisen < bound
            if soon.any():
                for r, p in zip(arisen[soon].tolist(), near[soon], strict=True):
                    if r in index:
                        index[r].append(np.array([p]))
                    else:
                        index[r] = [np.array([p])]
                        heapq.heappush(heap, r)
                arisen, near = arisen[~soon], near[~soon]
            if len(arisen):
                waiting.append((arisen, near))


class WordCoder:
    """A vocabulary file of the word kind: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model.get("unk_token"):
            raise ValueError("not a vocabulary of the word kind")
        self.tokens = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self._at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.numbers = {i: str(i) for i in self.tokens}
        self.by_number = {str(i): t for i, t in self.tokens.items()}
        del spec, model
        #: The memo: decimal ids of each word met, and the words without any.
        self.shown: dict[str, str] = {}
        self.empty: set[str] = set()

    def words(self, text: str) -> list[str]:
        """The text cut at white space; special tokens are words of their own."""
        if "<|" in text and self._at_special.search(text):
            return [w for part in self._at_special.split(text) for w in ([part] if part in self.special else self.words(part))]
        # str.split also cuts at four control characters that are no white space here.
        if CONTROL.search(text):
            return regex.findall(r"\S+", text)
        return text.split()

    def _cut(self, word: str) -> list[str]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        word = word.lower()
        return [word] if word.isalpha() else self.pieces.findall(word)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not in the memo yet, all in one index."""
        if len(self.shown) > MEMO_WORDS:
            self.shown.clear()
        known = self.shown.keys()
        fresh = [w for w in words if w not in known]
        cut = [self._cut(w) if w not in self.special else [w] for w in fresh]
        names = dict.fromkeys(p for pieces in cut for p in pieces)
        plain = [p for p in names if p not in self.special]
        ids, at = self.merges.encode([p.encode() for p in plain])
        ids, lo = list(map(self.numbers.__getitem__, ids.tolist())), 0
        parts = {t: self.numbers[i] for t, i in self.special.items()}
        for piece, hi in zip(plain, at[1:].tolist(), strict=True):
            parts[piece] = " ".join(ids[lo:hi])
            lo = hi
        for w, pieces in zip(fresh, cut, strict=True):
            self.shown[w] = parts[pieces[0]] if len(pieces) == 1 else " ".join([parts[p] for p in pieces])
        self.empty.update(w for w, pieces in zip(fresh, cut, strict=True) if not pieces)

    def encode(self, text: str) -> str:
        """Decimal ids joined by blanks; the words are in the memo."""
        words = self.words(text)
        if self.empty:
            words = [w for w in words if w not in self.empty]
        return " ".join(map(self.shown.__getitem__, words))

    def decode(self, ids: str) -> str:
        """The tokens of decimal ids; a vocabulary without decoder puts a blank between tokens."""
        return " ".join(map(self.by_number.__getitem__, ids.split())) if ids else ""


def coder(path: str) -> WordCoder:
    loaded = worker_memo("word-coder")
    if path not in loaded:
        loaded[path] = WordCoder(path)
    return loaded[path]


OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, carry: list[str], outputs: list[str], text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` of every row, and the chosen ``outputs`` of encoding its whole text and decoding it again.

    ``ids`` are those of the vocabulary file at ``path`` without added special tokens (those that
    stand in the text are found), ``decoded`` the text that decoding them gives with special tokens
    kept; ``ids_sha256`` is the hash of the decimal ids joined by one blank. A NULL text is empty,
    an empty text has no ids. Rows stay as they are, repeated or not.
    """
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = rows.select(*names).schema
    for name in outputs:
        schema = schema.add(name, T.DataType.fromDDL(OUTPUTS[name]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, decodes = coder(path), any(name.startswith("decoded") for name in outputs)

        def coded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [b.column("text").to_pylist() for b in held]
            seen: set[str] = set()
            for part in texts:
                for text in part:
                    seen.update(model.words(text))
            model.learn(seen)
            for batch, part in zip(held, texts, strict=True):
                made = {name: [] for name in outputs}
                for text in part:
                    ids = model.encode(text)
                    decoded = model.decode(ids) if decodes else ""
                    for name, column in made.items():
                        if name == "n_tokens":
                            column.append(ids.count(" ") + 1 if ids else 0)
                        elif name == "ids_sha256":
                            column.append(hashlib.sha256(ids.encode()).hexdigest())
                        elif name == "decoded_sha256":
                            column.append(hashlib.sha256(decoded.encode()).hexdigest())
                        else:
                            column.append(decoded if name == "decoded" else np.array(ids.split(), np.int32))
                kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in names] + [pa.array(v, kinds.get(k, pa.string())) for k, v in made.items()], [*names, *outputs]
                )

        held, size = [], 0
        for piece in in_pieces(batches, "text"):
            held.append(piece)
            size += piece.column("text").nbytes
            if size >= block:
                yield from coded(held)
                held, size = [], 0
        if held:
            yield from coded(held)
        # The worker may go on with other stages: it keeps the vocabulary and gives the rest back.
        model.shown.clear()
        held = []
        pa.default_memory_pool().release_unused()

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], *outputs)
