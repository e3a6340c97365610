"""Near duplicates of documents with an LSH forest over MinHash signatures.

A document's set is its five-word shingles. Documents of one word sequence are one class. Each
class has TREES orders: in tree t it is a string of DEPTH MinHash values, and Spark sorts all the
strings of a tree (range partitions, so a crowded region is dealt over many tasks). In the sorted
order, neighbours with a long common prefix are candidates. A region starts at MIN_DEPTH common
values; one with more than CROWD rows is cut deeper, value by value, until its parts are small.
Within a part every pair is compared by signature, across parts of a region the next NEAR rows
are, and in a part that stays crowded at full depth every row meets the HUBS rows nearest to the
part's usual signature. What looks similar enough is confirmed on the full shingle sets.

Rows of a crowded region are finished exactly (``_finish``): all pairs of them in different
components are looked for with a prefix filter on their full sets, the rarest shingles first. A
shingle with at most CROWD rows gives pairs; rows that meet by a longer list are compared all with
all, in tiles, by the size of the common part of their sets.

Sending on all similar pairs of a dense group would be quadratic, so the first two rounds send on
a spanning forest of the candidates by estimated similarity. Confirmed links join components, and
a later round looks at candidates between different components only. The last round sends on all
of those that are left, so every candidate is either confirmed or inside one component. Rows
without any candidate in the first round have none later and stay out.

At the threshold 0.85 a pair shares MIN_DEPTH values in a tree with 0.72, in none of 10 trees
with 3e-6, and is dropped by its sketch with 1e-6 at most (``_floor``). A pair falls to a partition boundary of the sort in one tree with about
partitions / rows, so it stays in the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import as_table, in_pieces, marked, random_words, remove, text_bytes, written
from newsloom.llm.graph import components
from newsloom.llm.shingles import distinct_counts, shingles

TREES, DEPTH, MIN_DEPTH = 10, 8, 2
CROWD, NEAR, HUBS = 128, 12, 8
#: Rows and shingles of a tile of rows that meet all others, and columns of its matrix at a time.
TILE, TILE_SHINGLES, COLUMNS = 1024, 1 << 21, 2048
#: The chance that a pair at the threshold looks too little similar to be a candidate, at most.
MISSED = 1e-6
#: Whether a round sends on all candidates between different components.
ROUNDS = (False, False, True)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class, signature`` of every row; class and signature are NULL without words.

    ``class`` is a hash of the word sequence, ``signature`` TREES * DEPTH MinHash values of 32 bits.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = TREES * DEPTH
        factors = random_words(size, 900) | np.uint64(1)
        for piece in in_pieces(batches, "_text"):
            values, offsets, sequence = shingles(*text_bytes(piece.column("_text")))
            some = np.flatnonzero(np.diff(offsets))
            least = np.zeros((len(some), size), np.uint32)
            for lo in range(0, len(some), 256):  # stays in the processor's cache
                rows = some[lo : lo + 256]
                part = values[offsets[rows[0]] : offsets[rows[-1] + 1]]
                starts = offsets[rows] - offsets[rows[0]]
                for k in range(size):
                    high = ((part * factors[k]) >> np.uint64(32)).astype(np.uint32)
                    least[lo : lo + 256, k] = np.minimum.reduceat(high, starts)
            has = np.diff(offsets) > 0
            signature, kind = np.full(len(has), None, object), np.full(len(has), None, object)
            signature[some] = [row.tobytes() for row in least.astype(">u4")]
            kind[some] = [row.tobytes() for row in sequence[some]]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("_id").cast(pa.int64()), pa.array(distinct_counts(values, offsets), pa.int64()),
                    pa.array(kind, pa.binary()), pa.array(signature, pa.binary()),
                ],
                ["doc_id", "n_shingles", "class", "signature"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, class binary, signature binary")


TREE_SCHEMA = "tree int, key binary, id long, label long, sketch binary"


def _trees(nodes: DataFrame) -> DataFrame:
    """``nodes(id, label, signature)`` in every tree: the tree's values as the key, and the low bits of all values."""

    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            low = raw[:, 3::4] & 15
            sketch = [row.tobytes() for row in (low[:, 0::2] << 4 | low[:, 1::2])]
            for t in range(TREES):
                key = raw[:, t * DEPTH * 4 : (t + 1) * DEPTH * 4]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(batch.num_rows, t, np.int32)), pa.array([row.tobytes() for row in key], pa.binary()),
                        batch.column("id"), batch.column("label"), pa.array(sketch, pa.binary()),
                    ],
                    ["tree", "key", "id", "label", "sketch"],
                )

    return nodes.select("id", "label", "signature").mapInArrow(plant, TREE_SCHEMA)


SAME_NIBBLES = np.array([((x >> 4) == 0) + ((x & 15) == 0) for x in range(256)], np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches (four bits a MinHash value, so 1 in 16 agrees by chance)."""
    same = SAME_NIBBLES[a ^ b].sum(axis=-1, dtype=np.int32) / (2 * a.shape[-1])
    return (same - 1 / 16) / (15 / 16)


def _floor(threshold: float, values: int) -> float:
    """The highest estimate that a pair at the threshold stays below with a chance of at most MISSED (binomial tail)."""
    agree = threshold + (1 - threshold) / 16
    below, count = 0.0, 0
    while count < values and (below := below + comb(values, count) * agree**count * (1 - agree) ** (values - count)) <= MISSED:
        count += 1
    return (count / values - 1 / 16) / (15 / 16) - 1e-9


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys (rows x values): number of the region of each row, and of its part after cutting crowded ones."""
    n = len(keys)
    changed = np.empty((n, keys.shape[1]), bool)
    changed[0] = True
    changed[1:] = np.logical_or.accumulate(keys[1:] != keys[:-1], axis=1)
    region = np.cumsum(changed[:, MIN_DEPTH - 1]) - 1
    part = region
    for depth in range(MIN_DEPTH, keys.shape[1]):
        crowded = np.bincount(part)[part] > CROWD
        if not crowded.any():
            break
        starts = np.empty(n, bool)
        starts[0] = True
        starts[1:] = (part[1:] != part[:-1]) | (crowded[1:] & changed[1:, depth])
        part = np.cumsum(starts) - 1
    return region, part


def _similar(keys: np.ndarray, sketch: np.ndarray, label: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with different labels that meet in the sorted order and look similar, with the estimate."""
    region, part = _parts(keys)
    size = np.bincount(part)
    reach = np.where(size[part] <= CROWD, size[part], 1)
    found = []
    n = len(keys)
    for step in range(1, min(n, int(max(reach.max(initial=1), NEAR + 1)))):
        i = np.flatnonzero((part[: n - step] == part[step:]) & (reach[: n - step] > step)) if step >= NEAR else None
        if i is None:
            i = np.flatnonzero(region[: n - step] == region[step:])
        i = i[label[i] != label[i + step]]
        for lo in range(0, len(i), 1 << 16):
            a = i[lo : lo + (1 << 16)]
            est = likeness(sketch[a], sketch[a + step])
            keep = est >= floor
            found.append((a[keep], a[keep] + step, est[keep]))
    for p in np.flatnonzero(size > CROWD):
        lo = int(np.searchsorted(part, p))
        rows = np.arange(lo, lo + size[p])
        nibbles = np.stack([sketch[rows] >> 4, sketch[rows] & 15], axis=2).reshape(len(rows), -1)
        usual = np.array([np.bincount(c, minlength=16).argmax() for c in nibbles.T], np.uint8)
        hubs = rows[np.argsort(-(nibbles == usual).sum(axis=1), kind="stable")[:HUBS]]
        for hub in hubs:
            est = likeness(sketch[rows], sketch[hub])
            keep = (est >= floor) & (label[rows] != label[hub])
            found.append((rows[keep], np.full(keep.sum(), hub), est[keep]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(a: np.ndarray, b: np.ndarray, est: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Indices of the pairs of a spanning forest over labels, most similar pairs first."""
    names, inverse = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    x, y = inverse[: len(a)].tolist(), inverse[len(a) :].tolist()
    parent = list(range(len(names)))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for k in np.argsort(-est, kind="stable").tolist():
        p, q = root(x[k]), root(y[k])
        if p != q:
            parent[p] = q
            kept.append(k)
    return np.array(kept, np.int64)


def _candidates(nodes: DataFrame, threshold: float, every: bool) -> DataFrame:
    """``a, b``: pairs of ids with different labels to be confirmed, ``a < b``; all of them or a spanning forest."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _trees(nodes).repartitionByRange(partitions, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    values = TREES * DEPTH
    floor = _floor(threshold, values)

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def look(rows: pa.Table) -> pa.RecordBatch:
            n = rows.num_rows
            ids, label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            raw = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(n, DEPTH).astype(np.uint32)
            keys = np.concatenate([raw, np.zeros((n, 0), np.uint32)], axis=1)
            keys[:, 0] ^= rows.column("tree").to_numpy().astype(np.uint32) * np.uint32(0x9E3779B1)
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
            a, b, est = _similar(keys, sketch, label, floor)
            if len(a) and not every:
                kept = _forest(a, b, est, label)
                a, b = a[kept], b[kept]
            a, b = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

        def prefix(batch: pa.RecordBatch, i: int) -> tuple:
            return batch.column("tree")[i].as_py(), batch.column("key")[i].as_py()[: 4 * MIN_DEPTH]

        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of a region that goes on in the next batch are held back with it, up to a bound of whole blocks.
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            whole = table.to_batches()[0]
            last, lo, hi = prefix(whole, whole.num_rows - 1), 0, whole.num_rows - 1
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if prefix(whole, mid) < last else (lo, mid)
            cut = lo if lo else whole.num_rows
            yield look(table.slice(0, cut))
            # A region longer than a block goes on with an overlap.
            rest = whole.slice(cut) if lo else whole.slice(max(0, whole.num_rows - CROWD))
            held, rows_held = [rest], rest.num_rows
        if held:
            yield look(pa.Table.from_batches(held).combine_chunks())

    return ordered.mapInArrow(neighbours, "a long, b long").distinct()


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``id`` is none of ``ids``, so that their texts are not shuffled."""
    return marked(rows, F.col("id"), ids, "_may").where("_may").drop("_may")


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets have the wanted similarity; ``threshold`` is a fraction."""
    up, down = threshold

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "ta", 1 << 19):
            left, lo, _ = shingles(*text_bytes(piece.column("ta")))
            right, ro, _ = shingles(*text_bytes(piece.column("tb")))
            good = np.zeros(piece.num_rows, bool)
            for i in range(piece.num_rows):
                x, y = np.unique(left[lo[i] : lo[i + 1]]), np.unique(right[ro[i] : ro[i + 1]])
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both > 0 and down * both >= up * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [piece.column("a").filter(pa.array(good)), piece.column("b").filter(pa.array(good))], ["a", "b"]
            )

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _crowded(nodes: DataFrame) -> DataFrame:
    """``id`` of the rows that are in a region of more than CROWD rows in some tree."""
    heads = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("signature", t * DEPTH * 4 + 1, MIN_DEPTH * 4).alias("head")) for t in range(TREES)])
    heads = nodes.select("id", F.explode(heads).alias("_h")).select("id", "_h.tree", "_h.head")
    crowds = heads.groupBy("tree", "head").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD)
    return heads.join(crowds, ["tree", "head"], "left_semi").select("id").distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """``id, label, kind, n, grams`` of ``rows(id, label, text)``: the different shingles of each, ``kind`` their word sequence."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            values, offsets, sequence = shingles(*text_bytes(piece.column("text")))
            grams = [np.unique(values[offsets[i] : offsets[i + 1]]).view(np.int64) for i in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"), piece.column("label"), pa.array([row.tobytes() for row in sequence], pa.binary()),
                    pa.array([len(g) for g in grams], pa.int64()), pa.array(grams, pa.list_(pa.int64())),
                ],
                ["id", "label", "kind", "n", "grams"],
            )

    made = rows.select("id", "label", "text").mapInArrow(make, "id long, label long, kind binary, n long, grams array<bigint>")
    return made.where("n > 0").dropDuplicates(["id", "kind"])


def _common(values: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each left row has in common with each right row."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((counts > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(offsets) - 1, COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - first] = 1
        both += has[left] @ has[right].T
    return both.astype(np.int64)


def _tiled(sets: DataFrame, clumps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a, b``: links between different labels of the rows of each clump, all pairs compared on full sets."""
    up, down = threshold
    rows = sets.join(clumps, "id")
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    rows = rows.join(rows.groupBy("clump").agg(tiles.alias("tiles")), "clump")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id", "kind"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("clump", F.least("tile", "_o").alias("ta"), F.greatest("tile", "_o").alias("tb"), "tile", "id", "label", "grams")
    ordered = rows.repartition("clump", "ta", "tb").sortWithinPartitions("clump", "ta", "tb")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def look(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            group = pa.Table.from_batches(parts).combine_chunks()
            ids, label, tile = (group.column(c).to_numpy() for c in ("id", "label", "tile"))
            grams = group.column("grams").combine_chunks()
            grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
            values, offsets = grams.flatten().to_numpy(), grams.offsets.to_numpy() - grams.offsets[0].as_py()
            left, right = np.flatnonzero(tile == group.column("ta")[0].as_py()), np.flatnonzero(tile == group.column("tb")[0].as_py())
            both, n = _common(values, offsets, left, right), np.diff(offsets)
            union = n[left][:, None] + n[right][None, :] - both
            x, y = np.nonzero((both > 0) & (down * both >= up * union) & (label[left][:, None] != label[right][None, :]))
            kept = _forest(left[x], right[y], both[x, y] / union[x, y], label) if len(x) else np.zeros(0, np.int64)
            a, b = ids[left[x[kept]]], ids[right[y[kept]]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("clump", "ta", "tb")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[lo]) != last:
                    yield look(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = tuple(keys[lo])
        if held:
            yield look(held)

    return ordered.mapInArrow(compare, "a long, b long")


def _finish(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a, b``: links between different labels of ``rows(id, label, text)``, every pair compared unless it cannot be one.

    Rows of a similarity of at least t have one of their ``n - ceil(t * n) + 1`` rarest shingles in
    common. Shingles that all rows of one label only have are left out.
    """
    up, down = threshold
    # Rows are named by one number from here on, so that what travels with each shingle is small.
    sets = written(_sets(rows).withColumn("row", F.monotonically_increasing_id()), "minhash-sets")
    seen = sets.select("label", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    own = Window.partitionBy("row")
    ranked = sets.select("row", F.explode("grams").alias("g")).join(seen.where("lo <> hi").select("g", "df"), "g")
    ranked = ranked.select("row", "g", F.row_number().over(own.orderBy("df", "g")).alias("turn"), F.count("*").over(own).alias("useful"))
    # Shingles of one label only come first in the order of all shingles, and are not joined: they are counted.
    place = F.col("turn") + F.col("n") - F.col("useful")
    prefix = ranked.join(sets.select("row", "id", "label", "n"), "row").withColumn("place", place)
    prefix = prefix.where(f"place <= n - (({up} * n + {down - 1}) DIV {down}) + 1").select("g", "id", "label", "n", "place")
    prefix = written(prefix.distinct(), "minhash-prefix")
    lists = prefix.groupBy("g").agg(F.count("*").alias("_n"), F.min("id").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    lists = written(lists.where("lo <> hi").drop("lo", "hi"), "minhash-lists")
    few = prefix.join(lists.where(F.col("_n") <= CROWD), "g")
    a, b = (few.select("g", F.col("id").alias(x), F.col("label").alias("l" + x), F.col("n").alias("n" + x), F.col("place").alias("p" + x)) for x in "ab")
    # Sizes too far apart, or too little left behind the first shingle they share: no link. A link passes by its first one.
    near = f"least(na, nb) * {down} >= greatest(na, nb) * {up} AND (1 + least(na - pa, nb - pb)) * {up + down} >= (na + nb) * {up}"
    pairs = a.join(b, "g").where(near)
    pairs = written(pairs.where("a < b AND la <> lb").select("a", "b").distinct(), "minhash-pairs")
    good = _confirm(pairs, rows.select("id", "text"), threshold)
    many, held = lists.where(F.col("_n") > CROWD), [sets, prefix, lists, pairs]
    if many.limit(1).count():
        clumps = components(prefix.join(many, "g").select(F.col("id").alias("a"), F.col("least").alias("b")))
        held.append(clumps)
        good = good.union(_tiled(sets, clumps.withColumnRenamed("component_id", "clump"), threshold))
    good = written(good.distinct(), "minhash-finished")
    for done in held:
        remove(done)
    return good


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (85, 100)
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents whose shingle sets have at least the similarity ``threshold`` (a fraction of whole
    numbers) are linked; ``component_id`` is the smallest id reachable, ``kept`` whether that is
    the row's own. Rows without words are linked with nothing. Rows of one id are one node of the
    graph, each with its own ``n_shingles``; a row without id is linked with nothing and has
    component NULL and ``kept`` true. Repeated rows stay repeated.
    """
    up, down = threshold
    if not 0 < up <= down:
        raise ValueError("the threshold lies in (0, 1]")
    signed = written(signatures(docs, id_col, text_col), "minhash-signed")
    classes = written(signed.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("id")), "minhash-classes")
    # One row of each class stands for it.
    nodes = written(
        signed.join(classes.withColumnRenamed("id", "doc_id"), ["class", "doc_id"], "left_semi")
        .groupBy("class", F.col("doc_id").alias("id")).agg(F.first("signature").alias("signature")).drop("class"),
        "minhash-nodes",
    )
    crowded = written(_crowded(nodes), "minhash-crowded")
    links, tried, labels = None, None, None
    ids, texts = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    for every in ROUNDS:
        label = F.col("id") if labels is None else F.coalesce("component_id", "id")
        labelled = nodes if labels is None else nodes.join(labels, "id", "left")
        pairs = _candidates(labelled.withColumn("label", label), up / down, every)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        if tried is None:
            ends = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "minhash-ends")
            every_node, nodes = nodes, written(nodes.join(ends, "id", "left_semi"), "minhash-nodes")
            remove(every_node)
            met = written(_named(docs.select(ids, texts), ends).join(ends, "id", "left_semi"), "minhash-texts")
            remove(ends)
        tried = pairs if tried is None else tried.union(pairs)
        good = _confirm(pairs, met, threshold).distinct()
        before = [x for x in (links, labels) if x is not None]
        links = written(good if links is None else good.union(links), "minhash-links")
        stars = components(links)
        labels = written(stars, "minhash-labels")
        for done in (*before, stars):
            remove(done)
    remove(met)
    if crowded.limit(1).count():
        rows = crowded.join(labels, "id", "left").select("id", F.coalesce("component_id", "id").alias("label"))
        rows = written(_named(docs.select(ids, texts), crowded).join(rows, "id"), "minhash-texts")
        more = _finish(rows, threshold)
        remove(rows)
        if more.limit(1).count():
            remove(labels)
            stars = components(links.union(more))
            labels = written(stars, "minhash-labels")
            remove(stars)
        remove(more)
    named = classes.join(labels, "id", "left").select("class", F.coalesce("component_id", "id").alias("id"))
    out = signed.drop("signature").join(named.withColumnRenamed("id", "component_id"), "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )
    out = written(out, "minhash-found")
    for done in (signed, classes, nodes, crowded, tried, links, labels):
        remove(done)
    return out
