"""Pairs of similar vectors by metric partitioning: exact, without comparing all with all.

Unit vectors with a cosine above a threshold are within a radius of each other. Every row belongs to
the cell of its nearest pivot, and visits the cells whose border it is near enough to have a partner
behind: from a row at distance a of its own pivot and b of another, every point of the other
pivot's cell is at least (b*b - a*a) / (2 * distance of the pivots) away (the points that are as near to either
pivot lie on a plane). Of two partners in different cells it is enough that one visits the other, so rows
only visit cells of smaller number.

Rows meet inside a cell only, in tiles, so a dense cell is many tasks. What a row's visits would
cost on average is measured on a bounded sample; where borders do not keep rows apart (a low
threshold) the tiles of everything against everything are cheaper, and are taken instead. Either way
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.vectors import unit_rows
from newsloom.operators.tiles import TILE_ROWS, tile_join
from newsloom.operators.vectors import _no_pairs, _pair_schema, _pair_table, _pairs_above, pairwise_similar
from newsloom.sources.sinks import write_aside

#: Rows of a cell, about; pivots at most; rows by which the number of visits is measured.
CELL_ROWS, MOST_PIVOTS, SAMPLE = 512, 2048, 4096
#: Added to the radius, so that no rounding of a distance loses a pair.
SLACK = 1e-6


class Cells:
    """Pivots, and the cells that rows belong to and visit."""

    def __init__(self, pivots: np.ndarray, threshold: float):
        self.pivots = pivots
        self.radius = np.sqrt(2 - 2 * threshold) + SLACK
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        # Pivots that coincide: the later one gets no rows, since the first nearest counts, and need not be visited.
        self.reach = np.where(apart > 1e-9, 2 * self.radius * apart, -np.inf)

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the own cell; and pairs of row and visited cell."""
        square = np.maximum(2 - 2 * unit @ self.pivots.T, 0)
        home = square.argmin(axis=1)
        beyond = square - square[np.arange(len(unit)), home][:, None]
        visits = (beyond <= self.reach[home]) & (np.arange(len(self.pivots))[None, :] < home[:, None])
        row, cell = np.nonzero(visits)
        return home, row, cell


def _sampled(lean: DataFrame, rows: int) -> np.ndarray:
    """Unit vectors of a fixed random choice of at most so many rows."""
    chosen = lean.select("article_id", "vector").orderBy(F.xxhash64("article_id", F.lit("pivot")), "article_id").limit(rows)
    found = unit_rows(chosen.select("vector").toArrow().column("vector"))
    return found[np.einsum("ij,ij->i", found, found) > 0] if len(found) else found


def spread_out(sample: np.ndarray, number: int) -> np.ndarray:
    """So many rows of the sample, the farther from those before the likelier, so that every dense part gets one."""
    draw = np.random.default_rng(13).random(number)
    chosen, square = [0], np.maximum(2 - 2 * sample @ sample[0], 0)
    for x in draw[1:]:
        total = np.cumsum(square)
        if total[-1] <= 1e-9:
            break
        chosen.append(int(np.searchsorted(total, x * total[-1])))
        square = np.minimum(square, np.maximum(2 - 2 * sample @ sample[chosen[-1]], 0))
    return sample[chosen]


def pairwise_similar_pivots(
    df: DataFrame, threshold: float = 0.7, vector: str = "embedding", pivots: int | None = None, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The pairs of ``pairwise_similar``: articles of different sources with a cosine above the threshold, exactly.

    ``df``: article_id, src and the vector. ``pivots`` sets their number; without it the number follows the
    rows, and the plain tiles are taken where they send fewer copies of a row. NULL vectors have no pairs.
    """
    lean = df.select("article_id", "src", F.col(vector).alias("vector")).where("vector IS NOT NULL")
    rows = lean.count()
    number = pivots or min(MOST_PIVOTS, rows // CELL_ROWS)
    if not 0 < threshold < 1 or number < 2:
        return pairwise_similar(df, threshold, None, vector, tile_rows)
    sample = _sampled(lean, max(SAMPLE, number))
    if not len(sample):
        return pairwise_similar(df, threshold, None, vector, tile_rows)
    cells = Cells(spread_out(sample, number), threshold)
    if pivots is None:
        copies = 1 + len(cells.of(sample)[1]) / max(1, len(sample))
        if copies > rows / tile_rows / 2:
            return pairwise_similar(df, threshold, None, vector, tile_rows)

    schema = T.StructType([*lean.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("home", T.IntegerType())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column("vector"))
            some = np.flatnonzero(np.einsum("ij,ij->i", unit, unit) > 0)  # a zero vector is similar to none
            home, row, cell = cells.of(unit[some])
            take = np.concatenate([some, some[row]])
            made = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [*made.columns, pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(np.concatenate([home, home[row]]), pa.int32())],
                [*made.schema.names, "cell", "home"],
            )

    dealt = write_aside(lean.mapInArrow(deal, schema), "pivot-cells").withColumn("_entry", F.xxhash64("article_id", "cell"))
    members = dealt.where("cell = home")

    def emit(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _no_pairs(a, b)
        ids_a, ids_b = (t.column("article_id").to_numpy() for t in (a, b))
        inside = b.column("cell").to_numpy() == b.column("home").to_numpy()
        kept = []
        for left, right, scores in _pairs_above(threshold, a, b, False):
            keep = (~inside[right] | (ids_a[left] < ids_b[right])) & (ids_a[left] != ids_b[right])
            kept.append(_pair_table(a, b, left[keep], right[keep], scores[keep]))
        return pa.concat_tables(kept)

    return tile_join(members, dealt, "cell", "_entry", "_entry", emit, _pair_schema(df), tile_rows)
