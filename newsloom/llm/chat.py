"""Chat formatting of conversations by columnar byte assembly, and reading it back.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. The lengths of all segments of a batch give
their places in the output by one cumulative sum; headers and contents are then copied into one
preallocated buffer with computed scatter indices, and that buffer is the Arrow column. The loss
mask is a list of byte spans over the formatted text, one for the text of each assistant turn.

Control strings inside texts and roles are escaped: every ``<`` followed by backslashes (or none)
and ``|`` gets one more backslash, so nothing inside a text starts a control string, and taking one
away restores the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import flat, in_pieces

# The template's control strings.
START, END = b"<|im_start|>", b"<|im_end|>\n"
FORMATTED = "conv_id long, block long, n_turns int, formatted binary, loss_start array<int>, loss_end array<int>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def _escape_role(roles: pa.Array) -> pa.Array:
    for old, new in (("\\", "\\\\"), ("\n", "\\n")):
        roles = pc.replace_substring(roles, old, new)
    return escape(roles)


def _plain_role(role: str) -> str:
    """The role of a header; escaped as in ``_escape_role``."""
    if "\\" not in role:
        return role
    role = unescape(pa.array([role]))[0].as_py()
    return "\\".join(part.replace("\\n", "\n") for part in role.split("\\\\"))


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = flat(array, pa.large_binary())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def assemble(segments: list[bytes | pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, each the concatenation of its segments, and the start of every segment (rows x segments + 1)."""
    lengths = np.empty((rows, len(segments)), np.int64)
    sources = []
    for k, segment in enumerate(segments):
        if isinstance(segment, bytes):
            raw, at = np.frombuffer(segment, np.uint8), np.zeros(rows + 1, np.int64)
            lengths[:, k] = len(segment)
        else:
            raw, at = _buffers(segment)
            lengths[:, k] = np.diff(at)
        sources.append((raw, at))
    places = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(places[-1], np.uint8)
    begins = places[:-1].reshape(rows, -1)
    for k, (raw, at) in enumerate(sources):
        n = lengths[:, k]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begins[:, k], n) + inside] = raw[np.repeat(at[:-1], n) + inside]
    return out, places[: rows * len(segments) + 1]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """``conv_id, block, n_turns, formatted, loss_start, loss_end``: the formatted text of each conversation.

    A conversation is one row, a long one several, to be read one after another in the order of
    ``block`` (numbers may have gaps); turns are never cut. Turns are dealt by ranges of conversation and turn, so
    a conversation that holds a large part of all turns is formatted by many tasks. Turns stand in the order of their number, equal numbers by role
    and text. A NULL role or text is empty, rows without conversation id are a conversation.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        text(role_col).alias("role"), text(text_col).alias("text"),
    )
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, 0
        for piece in in_pieces(batches, "text"):
            n = piece.num_rows
            if not n:
                continue
            texts, roles = flat(piece.column("text"), pa.large_string()), flat(piece.column("role"), pa.large_string())
            raw, places = assemble([START, _escape_role(roles), b"\n", escape(texts), END], n)
            ids, part = piece.column("conv_id").to_pylist(), piece.column("part")[0].as_py() << 32
            first = [i for i in range(n) if i == 0 or ids[i] != ids[i - 1]]
            ends = np.array(first[1:] + [n])
            block = block + 1 if last is not None and last == (ids[0],) else 0
            blocks = [block] + [0] * (len(first) - 1)
            block, last = blocks[-1], (ids[-1],)
            at = places[np.append(first, n) * 5]
            learned = np.flatnonzero(pc.equal(roles, learn_from).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(ends, learned, "right")
            lists = pa.array(np.searchsorted(owner, np.arange(len(first) + 1)), pa.int32())
            spans = [pa.ListArray.from_arrays(lists, pa.array(places[learned * 5 + k] - at[owner], pa.int32())) for k in (3, 4)]
            formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in first], pa.int64()), pa.array([part + b for b in blocks], pa.int64()),
                    pa.array(ends - np.array(first), pa.int32()), formatted, *spans,
                ],
                ["conv_id", "block", "n_turns", "formatted", "loss_start", "loss_end"],
            )

    return ordered.mapInArrow(build, FORMATTED)


def parse_turns(formatted: bytes) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted block."""
    parts = formatted.split(START)[1:]
    heads = [p[: -len(END)].partition(b"\n") for p in parts]
    texts = unescape(pa.array([h[2].decode() for h in heads], pa.large_string())).to_pylist()
    return [(_plain_role(h[0].decode()), t) for h, t in zip(heads, texts, strict=True)]


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from formatted conversations.

    The turns come from parsing the formatted text, the loss text from its mask; every block is parsed where it
    lies. Only the hashes run on from block to block, in one task for a conversation, in constant memory.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64).to_pylist()
                turns = [parse_turns(row["formatted"]) for row in rows]
                masked = [[row["formatted"][a:b].decode() for a, b in zip(row["loss_start"], row["loss_end"], strict=True)] for row in rows]
                loss = ["".join(unescape(pa.array(texts, pa.large_string())).to_pylist()) for texts in masked]
                columns = {
                    "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "block": pa.array([r["block"] for r in rows], pa.int64()),
                    "n_turns": pa.array([len(t) for t in turns], pa.int64()),
                    "turns": pa.array(["".join(f"{role}\n{text}\n" for role, text in t).encode() for t in turns], pa.binary()),
                    "loss": pa.array([x.encode() for x in loss], pa.binary()), "loss_chars": pa.array([len(x) for x in loss], pa.int64()),
                    "chars": pa.array([len(r["formatted"].decode()) for r in rows], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    parsed = formatted.mapInArrow(parse, "conv_id long, block long, n_turns long, turns binary, loss binary, loss_chars long, chars long")
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            nonlocal done
            columns = list(zip(*done, strict=True)) if done else [[] for _ in names]
            done = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def close() -> None:
            if state is not None:
                done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["conv_id"],):
                    close()
                    now, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += row["n_turns"]
                state[1].update(row["turns"])
                state[2] += row["loss_chars"]
                state[3].update(row["loss"])
                state[4] += row["chars"]
            if len(done) >= 1000:
                yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(run_on, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
