"""Byte-exact removal of passages that occur more than once, by suffix sorting.

Whether a string of LENGTH bytes starts anywhere else is decided by sorting suffixes cut at LENGTH
bytes: equal ones are neighbours. Sorting all of them would move LENGTH bytes for every byte, so
the suffixes are dealt out first.

1. Every string of LENGTH bytes is named by its least k-gram (the leftmost of the k-grams with the
   smallest hash), so equal strings are named by the same k-gram at the same place. Neighbouring
   strings share it: a *run* is one such group, about 85 strings, and one row.
2. Runs whose k-gram occurs once cannot repeat. Of the others, runs with equal content repeat as a
   whole; this settles the inside of long passages without looking at bytes again.
3. What is left (the ends of passages, where k-grams agree and contents differ) is sorted byte by
   byte, many k-grams in one pass. Deep-shallow sorting: a multikey quicksort with letters of
   eight bytes down to SHALLOW bytes, then blind tries, which look at the first differing letter
   of a group only, grow level by level over all remaining groups at once.

A k-gram with more than CROWD different contents (a frequent line in front of ever new text) is
not left to one task: its strings become single rows, counted by content over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import RollingHash, in_pieces, mix64, remove, text_bytes, written

LENGTH, GRAM, SHALLOW = 200, 32, 24
CROWD = 32_768
#: Runs of a k-gram from which it may count as hot.
HOT = 4096


def _runs(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the strings of all texts: text, first start, number of starts, place of the k-gram, its hash, the content's hash."""
    n = len(raw)
    sizes = np.diff(at)
    count = np.maximum(sizes - length + 1, 0)
    if not count.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = RollingHash(raw)
    grams = hashes.ranges(slice(0, n - gram + 1), slice(gram, n + 1))
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width, done = length - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    owner = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(len(owner)) + (at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]))[owner]
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    lo, place, owner = start[first], place[first], owner[first]
    hi = start[np.concatenate([first[1:], [len(start)]]) - 1]
    content = mix64(hashes.ranges(lo, hi + length) + ((place - lo) * 4096 + (hi - lo)).astype(np.uint64))
    return owner, lo - at[owner], hi - lo + 1, place - lo, grams[place].view(np.int64), content.view(np.int64)


def _letters(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place as one number, big end first."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(raw) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)] << np.uint64(56 - 8 * k)
    return out


def _split(order: np.ndarray, group: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort within groups by a letter, number the new groups and drop those of one member."""
    turn = np.lexsort((letter, group))
    order, group, letter = order[turn], group[turn], letter[turn]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (letter[1:] != letter[:-1])
    group = np.cumsum(fresh) - 1
    many = np.bincount(group)[group] > 1 if len(group) else fresh
    return order[many], group[many]


def repeated(raw: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each start is equal to another one of its group (deep-shallow sorting)."""
    letters, out = _letters(raw), np.zeros(len(start), bool)
    last = length - 8
    order, group = _split(np.arange(len(start)), group, np.zeros(len(start), np.uint64))
    depth = 0
    while depth < min(SHALLOW, length) and len(order):  # multikey quicksort
        order, group = _split(order, group, letters[start[order] + min(depth, last)] if last >= 0 else _short(raw, start[order], length))
        depth += 8
    steps = [min(d, last) for d in range(SHALLOW, length, 8)]
    while len(order):  # blind tries, all groups one level deeper at a time
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        index = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(group)]])))
        head = start[order[first]][index]
        differs = np.full(len(order), len(steps), np.int64)
        same = np.arange(len(order))
        for k, step in enumerate(steps):
            equal = letters[start[order[same]] + step] == letters[head[same] + step]
            differs[same[~equal]] = k
            same = same[equal]
        branch = np.minimum.reduceat(differs, first)[index]
        leaf = branch == len(steps)
        out[order[leaf]] = True
        order, group, branch = order[~leaf], group[~leaf], branch[~leaf]
        if len(order):
            order, group = _split(order, group, letters[start[order] + np.array(steps, np.int64)[branch]])
    return out


def _short(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Strings of fewer than eight bytes as numbers."""
    out = np.zeros(len(start), np.uint64)
    for k in range(length):
        out = out << np.uint64(8) | raw[start + k].astype(np.uint64)
    return out


RUN = "ck long, id long, lo int, n int, rel int, h long, fh long"
VARIANT = "h long, rel int, n int, content binary, single boolean, ck long, lo int"


def _run_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            owner, lo, n, rel, h, fh = _runs(*text_bytes(piece.column("text")), length, gram)
            take = pa.array(owner)
            small = [pa.array(x, pa.int32()) for x in (lo, n, rel)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("ck").take(take), piece.column("id").take(take), *small, pa.array(h, pa.int64()), pa.array(fh, pa.int64())],
                ["ck", "id", "lo", "n", "rel", "h", "fh"],
            )

    return texts.mapInArrow(cut, RUN)


def _contents(variants: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each variant, fetched from the one document it was seen in."""

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text"):
            rows = batch.column("wanted").to_pylist()
            for text, ck, wanted in zip(batch.column("text").to_pylist(), batch.column("ck").to_pylist(), rows, strict=True):
                data = text.encode()
                yield pa.RecordBatch.from_pylist(
                    [
                        {"h": w["h"], "rel": w["rel"], "n": w["n"], "content": data[w["lo"] : w["lo"] + w["n"] + length - 1], "single": w["copies"] == 1, "ck": ck, "lo": w["lo"]}
                        for w in wanted
                    ],
                    pa.schema([("h", pa.int64()), ("rel", pa.int32()), ("n", pa.int32()), ("content", pa.binary()), ("single", pa.bool_()), ("ck", pa.int64()), ("lo", pa.int32())]),
                )

    wanted = variants.groupBy("ck", "id").agg(F.collect_list(F.struct("h", "rel", "n", "lo", "copies")).alias("wanted"))
    found = wanted.join(texts.withColumnRenamed("ck", "tk"), (F.col("ck") == F.col("tk")) & wanted["id"].eqNullSafe(texts["id"]))
    return found.select("text", "ck", "wanted").mapInArrow(fetch, VARIANT).dropDuplicates(["h", "ck", "lo"])


def _sorted_out(variants: DataFrame, length: int) -> DataFrame:
    """``ck, lo, hi``: spans of repeated strings, from sorting the suffixes of the variants of each k-gram."""

    def look(rows: pa.Table) -> pa.RecordBatch:
        raw, at = _binary(rows.column("content"))
        n, rel, h = (rows.column(c).to_numpy() for c in ("n", "rel", "h"))
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        _, kind = np.unique(h, return_inverse=True)
        twice = repeated(raw, at[:-1][owner] + step, kind[owner] * np.int64(length + 1) + (rel[owner] - step), length)
        twice &= rows.column("single").to_numpy(zero_copy_only=False)[owner]
        i = np.flatnonzero(twice)
        fresh = np.ones(len(i), bool)
        fresh[1:] = (i[1:] != i[:-1] + 1) | (owner[i[1:]] != owner[i[:-1]])
        first = np.flatnonzero(fresh)
        final = np.concatenate([first[1:], [len(i)]])[: len(first)] - 1
        lo = rows.column("lo").to_numpy()
        begin, end = i[first], i[final]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows.column("ck").to_numpy()[owner[begin]], pa.int64()),
                pa.array(lo[owner[begin]] + step[begin], pa.int32()), pa.array(lo[owner[end]] + step[end] + length, pa.int32()),
            ],
            ["ck", "lo", "hi"],
        )

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            h = batch.column("h").to_numpy()
            if size < 1 << 20 or h[0] == h[-1]:
                continue
            # The k-gram that is last may go on in the next batch.
            table = pa.Table.from_batches(held).combine_chunks()
            cut = table.num_rows - int((h == h[-1]).sum())
            yield look(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = 0
        if held:
            yield look(pa.Table.from_batches(held).combine_chunks())

    return variants.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "ck long, lo int, hi int")


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _counted_out(variants: DataFrame, length: int) -> DataFrame:
    """The same as ``_sorted_out`` for crowded k-grams: each string is a row, counted by content."""
    step = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = variants.select("*", step.alias("step"))
    text = F.substring(F.col("content"), F.col("step") + 1, F.lit(length))
    rows = rows.select("h", (F.col("rel") - F.col("step")).alias("o"), F.sha2(text, 256).alias("s"), "single", "ck", (F.col("lo") + F.col("step")).alias("lo"))
    many = rows.groupBy("h", "o", "s").count().where("count > 1").drop("count")
    return rows.where("single").join(many, ["h", "o", "s"], "left_semi").select("ck", "lo", (F.col("lo") + length).alias("hi"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``ck, spans``: for each text with repeats, the spans ``(lo, hi)`` of repeated strings, in no order and overlapping.

    ``texts`` has ``ck`` (a hash that names the content), ``id`` and ``text``.
    """
    if not 0 < gram <= length < 4096:
        raise ValueError("0 < gram <= length < 4096")
    runs = written(_run_rows(texts, length, gram), "suffix-runs")
    counts = written(runs.groupBy("h").count().where("count > 1"), "suffix-known")
    # K-grams with a large part of all runs: at most ten for each partition, so the list is small however many runs there are.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (counts.agg(F.sum("count")).first()[0] or 0) // (10 * parts)
    hot = [r.h for r in counts.where(F.col("count") > max(share, HOT)).select("h").collect()]
    known = counts.where(~F.col("h").isin(hot)).select("h") if hot else counts.select("h")
    some = runs.join(known, "h", "left_semi")
    # Those occur more than once for sure; they need no join, which would gather them.
    some = some.unionByName(runs.where(F.col("h").isin(hot)).select(*some.columns)) if hot else some
    # Copies of one text count here and are one row from here on. Dealt anew behind the join, so that adaptive
    # execution may split a hot k-gram there.
    some = some.repartition("ck", "h", "lo").groupBy("ck", "h", "fh", "lo", "n", "rel").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    some = written(some, "suffix-some")
    remove(runs)
    remove(counts)
    sample = F.min(F.struct("ck", "lo", "id")).alias("at")
    variants = some.groupBy("h", "fh", "n", "rel").agg(F.sum("copies").alias("copies"), sample)
    variants = written(variants.select("h", "fh", "n", "rel", "copies", "at.*"), "suffix-variants")
    whole = some.join(variants.where("copies > 1").select("h", "fh"), ["h", "fh"], "left_semi")
    whole = whole.select("ck", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    mixed = variants.groupBy("h").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 AND least = 1")
    stored = written(_contents(variants.join(mixed.select("h"), "h", "left_semi"), texts, length), "suffix-contents")
    crowded = mixed.where(F.col("kinds") > crowd).select("h")
    fine = _sorted_out(stored.join(crowded, "h", "left_anti"), length)
    dense = _counted_out(stored.join(crowded, "h", "left_semi"), length)
    spans = whole.unionByName(fine).unionByName(dense).distinct()
    spans = written(spans.groupBy("ck").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    for done in (some, variants, stored):
        remove(done)
    return spans


def _whole_text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def cut_repeats(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, characters: bool = False) -> DataFrame:
    """``carry`` of every row (the text column NULL there), and ``n_bytes, n_removed, n_spans`` (long) and ``kept`` (binary).

    Each byte of a text that lies in a string of ``length`` bytes starting at another place too, in
    any text, is removed; ``n_spans`` counts the maximal removed stretches, ``kept`` is the rest,
    with ``characters`` without the pieces of characters a cut went through. Texts are whole, as UTF-8; a NULL text is empty. Repeated rows are texts of their own, so long
    ones remove each other. A NULL id is an id like others.
    """
    content = F.xxhash64(F.col("text"), F.octet_length("text"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _whole_text(docs, text_col).alias("text"))
    texts = texts.select(content.alias("ck"), "id", "text")
    spans = repeated_spans(texts, length, min(GRAM, max(1, length // 4)), crowd)
    names = [f"c{i}" for i in range(len(carry))]
    # The text itself travels once.
    rows = docs.select(*[(F.lit(None).cast("string") if c == text_col else F.col(f"`{c}`")).alias(n) for c, n in zip(carry, names, strict=True)], _whole_text(docs, text_col).alias("text"))
    rows = rows.select(*names, "text", content.alias("ck")).join(spans, "ck", "left").drop("ck")
    kinds = rows.select(*names).schema
    schema = kinds.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 2 << 20):
            spans = batch.column("spans")
            sizes, gone, parts, kept = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                covered = np.zeros(len(data) + 1, np.int32)
                if spans[i].is_valid:
                    both = spans[i].values
                    np.add.at(covered, both.field("lo").to_numpy(), 1)
                    np.add.at(covered, both.field("hi").to_numpy(), -1)
                hit = np.cumsum(covered[:-1]) > 0
                removed = int(hit.sum())
                sizes.append(len(data))
                gone.append(removed)
                parts.append(int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum()))
                rest = np.frombuffer(data, np.uint8)[~hit].tobytes() if removed else data
                kept.append(rest.decode("utf-8", "ignore").encode() if characters else rest)
            made = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.mapInArrow(apply, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_bytes", "n_removed", "n_spans", "kept")
