"""Alignment of two tokenizers over a corpus, with an inverted index of token pairs.

Tokenizer A is a byte-level vocabulary, B one of pieces with byte fallback; both see the same bytes
(a blank and the text). Tokens of A and B are linked where their bytes overlap; places where both
end a token cut them into groups.

1. *Blocks.* A task walks its split in blocks of whole documents. The index of a block maps each
   pair of ids to a compressed bitmap of the block's documents that link it, one bitmap for each
   binary digit of the number of links (multiplicity planes). Pieces of a block are indexed on their
   own and OR-merged. A block is one row of a written table.
2. *Counts.* Popcounts of a pair's bitmaps, summed over the blocks: documents from the OR of the
   planes, links from plane k times 2**k. The highest count of each id of B marks the best pairs.
3. *Postings return scores.* Count and mark of each pair go back to the blocks that hold it, and
   the bitmaps hand them to their documents.

A frequent pair is one small row for each block, not one for each occurrence, so no key is hot.

Neither tokenizer has a token that spans the start of a single blank in front of something else, so
texts are cut there; each distinct piece is encoded and aligned once in a task, and a document is
the sum of its pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import byte_letters
from newsloom.llm.common import in_pieces, worker_memo, written

#: Units of text a task remembers before it forgets them all; documents and bytes of a block.
MEMO_UNITS = 400_000
BLOCK_DOCS, BLOCK_BYTES = 1 << 16, 8 << 20
#: A bitmap of more documents than this is stored as bits, else as numbers of 16 bits.
DENSE = 4096
UNIT = re.compile(r"(?<! ) (?=\S)")
#: Bits of an id of B in the number of a pair.
LOW_BITS = 24


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of count[i] numbers each, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (by position) whose byte ranges overlap; both sides cover the same bytes."""
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    first = np.searchsorted(ends_b, starts_a, "right")
    count = np.searchsorted(starts_b, ends_a, "left") - first
    return np.repeat(np.arange(len(ends_a)), count), spread(first, count)


class Aligner:
    """Both tokenizers, and what is known of each distinct piece of text (a *unit*) met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("A has to be a byte-level vocabulary")
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_a = {i: special.get(i) or bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Units are sound if no piece of B goes on with a blank; else texts stay whole.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.length_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.length_b = np.array([len(p) for p in self.bytes_b], np.int64)
        self.numbers = np.array([str(i) for i in range(max(len(self.length_a), len(self.length_b)))], object)
        self.blank = [self.b.piece_to_id("▁")]
        self.memo: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.memo.clear()
        self.good: list[bool] = []
        self.shown: list[str] = []
        #: Four sizes of each unit, the pairs of the links of all units, and where each unit's begin.
        self.sizes = np.zeros((0, 4), np.int64)
        self.pairs, self.pairs_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        """The blank and the text, cut in front of single blanks."""
        full = " " + text
        if not self.cuts:
            return [full]
        first, *rest = UNIT.split(full)
        return ([first] if first else []) + [" " + u for u in rest]

    def learn(self, units: Iterable[str]) -> None:
        """Encode and align the units that are not known yet, all in one pass over arrays."""
        fresh = [u for u in dict.fromkeys(units) if u not in self.memo]
        if not fresh:
            return
        ids_a = [e.ids for e in self.a.encode_batch(fresh, add_special_tokens=False)]
        # B adds the first blank itself; a blank alone it would drop.
        ids_b = [e if e else self.blank for e in self.b.encode([u[1:] for u in fresh], num_threads=1)]
        good = [True] * len(fresh)
        data = "".join(fresh).encode()
        sides = [b"".join(map(table.__getitem__, chain.from_iterable(ids))) for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        if sides[0] != data or sides[1] != data:
            for i, unit in enumerate(fresh):
                raw = unit.encode()
                good[i] = all(b"".join(map(table.__getitem__, ids[i])) == raw for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
                if not good[i]:
                    ids_a[i] = ids_b[i] = ()
        sizes, shown, pairs = self._aligned(ids_a, ids_b)
        self.memo.update(zip(fresh, range(len(self.shown), len(self.shown) + len(fresh)), strict=True))
        self.good += good
        self.shown += shown
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.pairs_at = np.concatenate([self.pairs_at, self.pairs_at[-1] + np.cumsum(sizes[:, 3])])

    def _aligned(self, ids_a: list, ids_b: list) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each unit: numbers of tokens, groups and links; its groups as text; and the pairs of all links, unit by unit."""
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        if not len(flat_a):
            return np.zeros((len(ids_a), 4), np.int64), [""] * len(ids_a), flat_a
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        link_a, link_b = linked(ends_a, ends_b)
        pairs = (flat_a[link_a] << LOW_BITS) + flat_b[link_b]
        # Units end where both end a token, so a unit has whole groups.
        before = np.concatenate([[0], np.cumsum(n_a)])
        groups, links = np.concatenate([[-1], group_a])[before] + 1, np.searchsorted(link_a, before)
        # The tokens of A and of B by group, and what stands behind each.
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        side = order >= len(flat_a)
        group = np.concatenate([group_a, group_b])[order]
        unit = np.concatenate([np.repeat(np.arange(len(n)), n) for n in (n_a, n_b)])[order]
        behind = np.full(len(order), ",", object)
        behind[:-1][side[1:] != side[:-1]] = "|"
        behind[:-1][group[1:] != group[:-1]] = ";"
        text = np.empty(2 * len(order), object)
        text[0::2] = np.concatenate([self.numbers[flat_a], self.numbers[flat_b]])[order]
        text[1::2] = behind
        last = np.flatnonzero(np.concatenate([unit[1:] != unit[:-1], [True]]))
        text[2 * last + 1] = "\n"
        shown, some = [""] * len(ids_a), unit[last].tolist()
        for i, groups_of in zip(some, "".join(text.tolist()).split("\n"), strict=False):
            shown[i] = groups_of
        return np.stack([n_a, n_b, np.diff(groups), np.diff(links)], axis=1), shown, pairs

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text its four sizes and its groups; and the distinct ``pair << 16 | row`` of all with their numbers of links."""
        if len(self.memo) > MEMO_UNITS:
            self.reset()
        cut = [self.units(t) if t else [] for t in texts]
        self.learn(u for units in cut for u in units)
        for row, units in enumerate(cut):
            if not all(self.good[self.memo[u]] for u in units):
                # The rule is about the bytes of the whole text; one unit may still make it whole.
                whole = " " + texts[row]
                self.learn([whole])
                cut[row] = [whole] if self.good[self.memo[whole]] else []
        counts = np.array([len(u) for u in cut], np.int64)
        index = np.array([self.memo[u] for units in cut for u in units], np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        sizes = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            sizes[:, k] = np.bincount(row, self.sizes[index, k], len(texts))
        shown = [";".join([self.shown[i] for i in index[hi - n : hi].tolist()]) for hi, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]
        both, times = np.unique(row * len(self.shown) + index, return_counts=True) if len(index) else (index, index)
        unit, row = both % max(1, len(self.shown)), both // max(1, len(self.shown))
        each = np.diff(self.pairs_at)[unit]
        pairs = self.pairs[spread(self.pairs_at[unit], each)]
        return sizes, shown, *summed((pairs << 16) + np.repeat(row, each), np.repeat(times, each))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


class PairBitmaps:
    """For each pair a bitmap of documents (0 to 65535) in every multiplicity plane.

    ``pairs`` are the distinct pairs in order; a plane lists which of them have documents in it, how
    many each, and the documents.
    """

    def __init__(self, pairs: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.pairs, self.planes = pairs, planes

    @classmethod
    def of(cls, keys: np.ndarray, links: np.ndarray) -> PairBitmaps:
        """From distinct ``pair << 16 | document`` in order and their numbers of links."""
        pair, doc = keys >> 16, (keys & 0xFFFF).astype(np.uint16)
        pairs, which = np.unique(pair, return_inverse=True)
        planes, k = [], 0
        while len(links) and int(links.max()) >> k:
            here = (links >> k & 1).astype(bool)
            some, count = np.unique(which[here], return_counts=True)
            planes.append((some, count, doc[here]))
            k += 1
        return cls(pairs, planes)

    @classmethod
    def merged(cls, parts: list[PairBitmaps]) -> PairBitmaps:
        """The OR of bitmaps over different documents of one block, plane by plane."""
        if len(parts) == 1:
            return parts[0]
        pairs = np.unique(np.concatenate([p.pairs for p in parts])) if parts else np.zeros(0, np.int64)
        planes = []
        for k in range(max((len(p.planes) for p in parts), default=0)):
            have = [p for p in parts if k < len(p.planes)]
            owner = np.concatenate([np.repeat(np.searchsorted(pairs, p.pairs[p.planes[k][0]]), p.planes[k][1]) for p in have])
            doc = np.concatenate([p.planes[k][2] for p in have])
            order = np.lexsort((doc, owner))
            some, count = np.unique(owner, return_counts=True)
            planes.append((some, count, doc[order]))
        return cls(pairs, planes)

    def popcounts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair the documents (of the OR of its planes) and the links (planes by their weight)."""
        links = np.zeros(len(self.pairs), np.int64)
        seen = []
        for k, (some, count, doc) in enumerate(self.planes):
            links[some] += count << k
            seen.append(np.repeat(some, count) << 16 | doc)
        docs = np.bincount(np.unique(np.concatenate(seen)) >> 16, minlength=len(self.pairs)) if seen else links.copy()
        return docs, links

    def packed(self) -> list[bytes]:
        """The planes as bytes: crowded bitmaps as bits, others as numbers, compressed."""
        out = []
        for some, count, doc in self.planes:
            dense = np.repeat(count > DENSE, count)
            bits = np.zeros((int((count > DENSE).sum()), 1 << 16), bool)
            bits[np.repeat(np.arange(len(bits)), count[count > DENSE]), doc[dense]] = True
            parts = [np.diff(some, prepend=0).astype("<u4"), count.astype("<u4"), np.packbits(bits, axis=1), doc[~dense].astype("<u2")]
            raw = np.array([len(some), len(bits)], "<u4").tobytes() + b"".join(p.tobytes() for p in parts)
            out.append(zstandard.ZstdCompressor(level=1).compress(raw))
        return out

    @classmethod
    def unpacked(cls, pairs: np.ndarray, packed: list[bytes]) -> PairBitmaps:
        planes = []
        for data in packed:
            raw = zstandard.ZstdDecompressor().decompress(data)
            n, crowded = np.frombuffer(raw, "<u4", 2).tolist()
            some = np.cumsum(np.frombuffer(raw, "<u4", n, 8).astype(np.int64))
            count = np.frombuffer(raw, "<u4", n, 8 + 4 * n).astype(np.int64)
            at = 8 + 8 * n
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, crowded * 8192, at).reshape(crowded, 8192), axis=1)
            doc = np.zeros(int(count.sum()), np.uint16)
            dense = np.repeat(count > DENSE, count)
            doc[dense] = np.nonzero(bits)[1]
            doc[~dense] = np.frombuffer(raw, "<u2", -1, at + crowded * 8192)
            planes.append((some, count, doc))
        return cls(pairs, planes)

    def returned(self, scores: np.ndarray, n_docs: int) -> np.ndarray:
        """For each document the sum of a score over its links: each plane hands on the scores by its weight."""
        out = np.zeros(n_docs, np.int64)
        for k, (some, count, doc) in enumerate(self.planes):
            np.add.at(out, doc, np.repeat(scores[some], count) << k)
        return out


BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>,"
    " pairs array<long>, docs array<int>, links array<int>, planes array<binary>"
)
SIZES = ("n_a", "n_b", "n_groups", "n_links")


def aligner(path_a: str, path_b: str) -> Aligner:
    loaded = worker_memo("aligner")
    if (path_a, path_b) not in loaded:
        loaded[path_a, path_b] = Aligner(path_a, path_b)
    return loaded[path_a, path_b]


def pair_index(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text",
               block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents (see ``BLOCK``): their sizes and groups (or the groups' hashes), and the pair index of the block."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = aligner(path_a, path_b), 0
        ids, sizes, groups, parts, held = [], [], [], [], 0

        def row(part: int) -> pa.RecordBatch:
            nonlocal number, ids, sizes, groups, parts, held
            index = PairBitmaps.merged(parts)
            many, links = index.popcounts()
            made = [part << 32 | number, ids, *np.concatenate(sizes).T, groups, index.pairs, many.astype(np.int32), links.astype(np.int32), index.packed()]
            number, ids, sizes, groups, parts, held = number + 1, [], [], [], [], 0
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for piece in in_pieces(batches, "text"):
            part = piece.column("part")[0].as_py()
            for start in range(0, piece.num_rows, block_docs):
                some = piece.slice(start, block_docs)
                if ids and (len(ids) + some.num_rows > block_docs or held >= block_bytes):
                    yield row(part)
                size, shown, keys, links = model.documents(some.column("text").to_pylist())
                parts.append(PairBitmaps.of(keys + len(ids), links))
                ids += some.column("id").to_pylist()
                sizes.append(size)
                groups += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown] if digest else shown
                held += some.column("text").nbytes
        if ids:
            yield row(part)
        model.reset()  # the worker may go on with other stages

    return rows.mapInArrow(run, BLOCK)


def pair_counts(index: DataFrame) -> DataFrame:
    """``pair, n_docs, n_links, best``: the popcounts of each pair over all blocks, and whether its links are the most of its id of B."""
    each = index.select(F.explode(F.arrays_zip("pairs", "docs", "links")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.docs", "x.links")
    counts = written(each.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links")), "crosswalk-counts")
    b = F.col("pair").bitwiseAND((1 << LOW_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n_links").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def crosswalk(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", **block: int) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every document.

    ``n_a`` and ``n_b`` are tokens of a blank and the text by A and of the text by B, ``groups`` is
    ``a1,a2|b1;a3|b2,b3``: the ids of either side between places where both end a token.
    A pair of ids counts as often as it is linked in all documents: ``count_sum`` sums that over the
    document's links, ``n_best`` counts the links whose pair no other pair of the same id of B exceeds.
    With ``digest``, ``groups`` is the SHA-256 of that text.

    A text that is NULL or empty, or that a tokenizer does not give back byte by byte, has no tokens:
    zeros and an empty ``groups``. Special tokens' strings are ordinary text. Rows stay as they are,
    repeated or not, and count as often; other columns play no part.
    """
    index = written(pair_index(docs, path_a, path_b, digest, id_col, text_col, **block), "crosswalk-index")
    scores = pair_counts(index).select("pair", F.col("n_links").alias("score"), "best")
    held = index.select("block", F.posexplode("pairs").alias("at", "pair"))
    back = held.join(scores, "pair").select(F.col("block").alias("home"), "at", "score", "best")
    blocks = index.select("block", "doc_ids", *SIZES, "groups", "pairs", "planes")

    def hand_out(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        row = left.to_batches()[0].slice(0, 1)
        values = {name: row.column(name).flatten() for name in ("doc_ids", *SIZES, "groups", "pairs", "planes")}
        n = len(values["doc_ids"])
        bitmaps = PairBitmaps.unpacked(values["pairs"].to_numpy(), values["planes"].to_pylist())
        at = right.column("at").to_numpy()
        score, best = np.zeros(len(bitmaps.pairs), np.int64), np.zeros(len(bitmaps.pairs), np.int64)
        score[at], best[at] = right.column("score").to_numpy(), right.column("best").to_numpy()
        sums = [pa.array(bitmaps.returned(s, n), pa.int64()) for s in (best, score)]
        return pa.Table.from_arrays([values["doc_ids"], *[values[s] for s in SIZES], *sums, values["groups"]], schema=out)

    longs = ["doc_id", *SIZES, "n_best", "count_sum"]
    out = pa.schema([*[(c, pa.int64()) for c in longs], ("groups", pa.string())])
    schema = ", ".join(f"{c} long" for c in longs) + ", groups string"
    return blocks.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(hand_out, schema)
