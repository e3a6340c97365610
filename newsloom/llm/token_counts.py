"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

The pre-tokens of a block of texts stand one after another in one array of symbols; each is a
sequence of its own. In every step each sequence applies its own lowest-ranked pair at all its
places at once, so all sequences of the block advance together and a block takes as many steps as
its slowest sequence. Finished sequences leave the arrays. What survives of a sequence is counted;
no id is ever written.

A sequence of many symbols (a text without blanks) needs many steps, hence a step only looks for
the lowest rank and repairs the ranks beside its merges, and the arrays are compacted when half of
them is dead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import WordCoder
from newsloom.llm.common import in_pieces, worker_memo

BLOCK_BYTES = 2 << 20
MEMO_WORDS = 300_000
LIMIT = 2048


class SynchronousMerges:
    """Merge rules as arrays; counts the symbols that are left of each sequence."""

    def __init__(self, rules):
        """``rules`` has the parallel arrays left, right, made and the symbols of bytes (inside, final)."""
        self.made, self.inside, self.final = rules.made, rules.inside, rules.final
        keys = (rules.left << 20) + rules.right
        self._ranks = np.argsort(keys)
        self._keys = np.append(keys[self._ranks], np.iinfo(np.int64).max)
        self._ranks = np.append(self._ranks, 0).astype(np.int32)
        self.none = np.int32(len(keys))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) + right
        place = np.searchsorted(self._keys, key)
        return np.where(self._keys[place] == key, self._ranks[place], self.none)

    def count(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word has when no pair of it can be merged any more."""
        sizes = np.array([len(w) for w in words], np.int64)
        counts = sizes.copy()
        if not counts.sum():
            return counts
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inside[raw]
        closing = np.cumsum(sizes)[sizes > 0] - 1
        symbols[closing] = self.final[raw[closing]]
        word, sizes = np.flatnonzero(sizes), sizes[sizes > 0]
        while len(word):
            word, sizes, symbols = self._rounds(word, sizes, symbols, counts)
        return counts

    def _rounds(self, word, sizes, symbols, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps over one layout of the arrays, until half of its symbols are merged away or finished; the rest, compacted."""
        n = len(symbols)
        start = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(word)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, self.none, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        alive, lively, live = np.ones(n, bool), n, np.ones(len(word), bool)
        left_over = sizes.copy()
        while lively > n // 2:
            lowest = np.minimum.reduceat(rank, start)
            done = live & (lowest == self.none)
            if done.any():
                live &= ~done
                lively -= int(left_over[done].sum())
                if not live.any():
                    break
            at = np.flatnonzero((rank == lowest[owner]) & (rank < self.none))
            # In a chain of equal symbols only every second pair is free; elsewhere no two places of one rank touch.
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            if chained.any():
                turn = np.arange(len(at))
                at = at[(turn - np.maximum.accumulate(np.where(chained, 0, turn))) % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[rank[at]]
            alive[gone], rank[gone] = False, self.none
            beyond = after[gone]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            left_over -= np.bincount(owner[at], minlength=len(word))
            lively -= len(at)
            # The pairs that begin at a merge and those that end in one.
            right = inside.copy()
            right[inside] = owner[beyond[inside]] == owner[at[inside]]
            rank[at[~right]] = self.none
            rank[at[right]] = self._rank(symbols[at[right]], symbols[beyond[right]])
            ahead = before[at]
            left = (ahead >= 0) & (owner[ahead] == owner[at])
            rank[ahead[left]] = self._rank(symbols[ahead[left]], symbols[at[left]])
        counts[word] = left_over
        return word[live], left_over[live], symbols[alive & live[owner]]


class TokenCounter:
    """Counts for the texts of a vocabulary file of the word kind, with a memo of the words met."""

    def __init__(self, path: str):
        self.cutter = WordCoder(path)
        self.merges = SynchronousMerges(self.cutter.merges)
        self.memo: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Count the words that are not in the memo yet, all in one set of arrays."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh = [w for w in words if w not in self.memo]
        special = self.cutter.special
        cut = [[] if w in special else self.cutter._cut(w) for w in fresh]
        pieces = list(dict.fromkeys(p for word in cut for p in word))
        tokens = dict(zip(pieces, self.merges.count([p.encode() for p in pieces]).tolist(), strict=True))
        for word, parts in zip(fresh, cut, strict=True):
            self.memo[word] = 1 if word in special else sum(map(tokens.__getitem__, parts))

    def count(self, texts: list[str]) -> list[int]:
        words = [self.cutter.words(text) for text in texts]
        self.learn({w for part in words for w in part})
        known = self.memo.__getitem__
        return [sum(map(known, part)) for part in words]


def counter(path: str) -> TokenCounter:
    loaded = worker_memo("token-counter")
    if path not in loaded:
        loaded[path] = TokenCounter(path)
    return loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` of every row, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of its whole text.

    Tokens are those of the vocabulary file at ``path`` without added ones; special tokens that
    stand in a text count as one each. A NULL or empty text has none. Rows stay as they are,
    repeated or not, and columns of any other name are left out. No shuffle: each task counts the
    texts of its split.
    """
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = rows.select(*names).schema.add("n_tokens", "long").add("n_bytes", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for piece in in_pieces(batches, "text", block):
            texts = piece.column("text").to_pylist()
            made = [pa.array(model.count(texts), pa.int64()), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + made, [*names, "n_tokens", "n_bytes"])
        model.memo.clear()  # the worker may go on with other stages

    counted = rows.mapInArrow(run, schema)
    return counted.select(
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
