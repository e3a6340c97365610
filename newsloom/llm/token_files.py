"""Token ids in binary files of bit or byte planes.

A *chunk* is a run of whole documents with about CHUNK_IDS ids. Its ids are cut into blocks of
BLOCK_IDS; a block is transposed into planes (all lowest bytes, then all second bytes and so on,
or bit by bit), and each plane is compressed with zstandard. High planes are almost constant and
shrink to nothing. Chunks are rows of Parquet files, so that Spark's committer writes them to any
store and a lost executor's half-written file never counts; the planes are its binary columns.

Documents are range-partitioned and sorted by id, a partition writes its chunks in order. The
index has a row for each chunk (its partition, number, place in the partition and documents) and
for each partition the ids before it, so any id can be found without reading other chunks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.bpe import byte_letters
from newsloom.llm.common import flat as flat_column
from newsloom.llm.common import in_pieces, worker_memo

CHUNK_IDS, BLOCK_IDS = 1 << 18, 1 << 16
MEMO_WORDS, PIECE_BYTES = 1_000_000, 1 << 22
# Fixed value: marks that are neither letters nor numbers nor white space for the pattern.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Fixed value: white space for Python (and more than what it is for the pattern), as a class for Arrow.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteCoder:
    """The tokenizers library's vocabulary of a byte-level file, with a memo of the words met.

    The file's pattern begins a new piece at every blank that stands alone between other things than
    white space, so texts are cut there and each different word goes through the library once: its pieces
    go straight to the library's merge model, words that may hold a special token through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.numbers = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # The short way needs the pattern of this kind of file, and special tokens that begin with "<|".
        kind = spec["pre_tokenizer"] or {}
        self.plain = (
            kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec["normalizer"]
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        self.pattern = regex.compile(PATTERN)
        #: Ids of words behind a blank, and of pieces inside words; those met long ago stand in ``old``, what is met again returns.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.numbers[t.id] for t in self.model.tokenize(mapped)])

    def _stem(self, word: str) -> bytes:
        """The ids of a blank and a word of letters."""
        ids = self.memo.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                # ASCII letters stand for themselves in such a vocabulary.
                ids = b"".join([self.numbers[t.id] for t in self.model.tokenize(self.letters[32] + word)]) if word.isascii() else self._piece(" " + word)
            self.memo[word] = ids
        return ids

    def _tail(self, piece: str) -> bytes:
        """The ids of a piece without a blank."""
        ids = self.tails.get(piece)
        if ids is None:
            if len(self.tails) > MEMO_WORDS // 4:
                self.tails.clear()
            ids = self.tails[piece] = self._piece(piece)
        return ids

    def _one(self, word: str) -> bytes:
        """The ids of a blank and the word."""
        if word.isalpha():
            return self._stem(word)
        if "<|" in word:
            return np.array(self.tokenizer.encode(" " + word, add_special_tokens=False).ids, "<u4").tobytes()
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            return self._stem(stem) + self._tail(word[len(stem):])
        # The same on each of some lines: these are the pieces, and the ends of the lines.
        found = []
        for line in word.split("\n"):
            stem = line.rstrip(MARKS)
            if not stem.isalpha():
                break
            if found:
                found += self._tail("\n"), self._tail(stem)
            else:
                found.append(self._stem(stem))
            if len(stem) < len(line):
                found.append(self._tail(line[len(stem):]))
        else:
            return b"".join(found)
        first, *rest = self.pattern.findall(" " + word)
        known = self._stem(first[1:]) if first[1:].isalpha() else self._piece(first)
        return known + b"".join(map(self._tail, rest))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of some texts; each different word of all of them is looked up once."""
        if not self.plain or len(texts) == 0:
            return [self._first(t) for t in texts.to_pylist()]
        if pc.any(pc.match_substring_regex(texts, f" {SPACE}|{SPACE} ")).as_py():
            split = pa.array([re.split(r"(?<!\s) (?!\s)", t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            split = pc.split_pattern(texts, " ")
        words, at = split.flatten(), np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        codes = words.dictionary_encode()
        found = self._known(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = codes.indices.to_numpy().astype(np.int64)
        # No blank stands in front of a text's first word.
        index[at[:-1]] = len(found) + np.arange(len(texts))
        found += map(self._first, words.take(pa.array(at[:-1])).to_pylist())
        table, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = sizes[index]
        ends = np.cumsum(own)
        data = table[np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - own), own) + np.arange(ends[-1])].tobytes()
        stops = 4 * np.concatenate([[0], ends[at[1:] - 1]])
        return [data[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of a blank and the word, for each of some different words."""
        if len(self.memo) > MEMO_WORDS // 2:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        found = list(map(memo.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = old.get(word)
                if ids is None:
                    ids = self._one(word)
                found[i] = ids
                if "\n" not in word:
                    memo[word] = ids
        return found

    def _first(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes() if word else b""


def coder(path: str) -> ByteCoder:
    loaded = worker_memo("byte-coder")
    if path not in loaded:
        loaded[path] = ByteCoder(path)
    return loaded[path]


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """A block of unsigned 32-bit ids as compressed planes, lowest first."""
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [pack(r.tobytes()) for r in rows]
    return [pack(np.packbits(r >> k & 1).tobytes()) for r in rows for k in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; 4 planes are bytes, 32 are bits."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(unpack(p), np.uint8) for p in planes]
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack(raw).T).reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(raw):
        out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
    return out


CHUNKS = "part int, chunk long, before long, doc_ids array<long>, sizes array<int>, block_sizes array<int>, planes array<array<binary>>"


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end it with ``end_id``, and write the ids in ascending id order under ``path``.

    A NULL text is empty and has the end id only; a NULL id comes first, rows of one id stand in
    the order of their texts. ``path/chunks`` and ``path/index`` are written; ``path`` must be new.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = coder(vocabulary), np.array([end_id], "<u4").tobytes()
        part, chunk, before = 0, 0, 0
        doc_ids, ids = [], []

        def packed() -> pa.RecordBatch:
            nonlocal chunk, before, doc_ids, ids
            flat = np.frombuffer(b"".join(ids), "<u4")
            blocks = [flat[i : i + BLOCK_IDS] for i in range(0, len(flat), BLOCK_IDS)]
            row = {
                "part": [part], "chunk": [chunk], "before": [before], "doc_ids": [doc_ids], "sizes": [[len(x) // 4 for x in ids]],
                "block_sizes": [[len(b) for b in blocks]], "planes": [[to_planes(b, bits) for b in blocks]],
            }
            chunk, before, doc_ids, ids = chunk + 1, before + len(flat), [], []
            kinds = {"part": pa.int32(), "chunk": pa.int64(), "before": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()),
                     "block_sizes": pa.list_(pa.int32()), "planes": pa.list_(pa.list_(pa.binary()))}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in row.items()], list(row))

        size = 0
        for piece in in_pieces(batches, "text", PIECE_BYTES):
            part = piece.column("part")[0].as_py() if piece.num_rows else part
            encoded = model.encode_all(flat_column(piece.column("text"), pa.large_string()))
            for doc_id, own in zip(piece.column("doc_id").to_pylist(), encoded, strict=True):
                doc_ids.append(doc_id)
                ids.append(own + end)
                size += len(ids[-1]) // 4
                if size >= CHUNK_IDS:
                    yield packed()
                    size = 0
        if doc_ids:
            yield packed()

    ordered.mapInArrow(write, CHUNKS).write.parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    totals = chunks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.col("n").alias("n_ids"))
    offsets.coalesce(1).write.parquet(f"{path}/index/parts")
    listed = chunks.select(
        "part", "chunk", "before", F.size("doc_ids").alias("n_docs"), F.col("doc_ids")[0].alias("first_doc"),
        F.element_at("doc_ids", -1).alias("last_doc"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ids"),
    )
    listed.write.parquet(f"{path}/index/chunks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (or their ``ids_crc32``) of every document, from the files under ``path``."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    offsets = spark.read.schema("part int, start long, n_ids long").parquet(f"{path}/index/parts").select("part", "start")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                blocks = zip(one.column("planes")[0].as_py(), one.column("block_sizes")[0].as_py(), strict=True)
                flat = np.concatenate([from_planes(p, n) for p, n in blocks])
                sizes = np.array(one.column("sizes")[0].as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                start = one.column("start")[0].as_py() + one.column("before")[0].as_py() + at[:-1]
                if digest:
                    last = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
                ids = one.column("doc_ids").flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    kind = "long" if digest else "array<int>"
    joined = chunks.join(offsets, "part").select("start", "before", "doc_ids", "sizes", "block_sizes", "planes")
    return joined.mapInArrow(read, f"doc_id long, start long, n_tokens long, {name} {kind}")
