"""All-pairs comparison in bounded tiles.

Two tables are compared inside regions (a category, a hash bucket, or one region for
everything). Each region is cut into square tiles by a hash of the row id; a tile pair
is one task group holding at most about ``MOST_ROWS`` rows a side, however many rows
the region has. A group is compared by matrix products of bounded size and sends on only what
``emit`` keeps, never the pairs themselves. (The 1-Bucket-Theta join of Okcan and
Riedewald, SIGMOD 2011, with matrix blocks.)

A row travels once for each tile of the other side, so tiles are as few as memory and cores allow: a
region of up to ``tile_rows`` rows is one tile, a larger one is cut into that many rows a tile but into
``MOST_TILES`` (all in one region) or ``REGION_TILES`` at most, as long as a tile stays below ``MOST_ROWS``.

Where everything is one region, ``block_self_join`` packs tiles into single values. They are as large as the vectors' length
allows, so a row travels as seldom as can be, and pairs are sent on as they are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.sources.sinks import write_aside

TILE_ROWS = 2048
#: Rows of a tile at most, about; tiles of a smaller table without regions, and of a smaller region.
MOST_ROWS, MOST_TILES, REGION_TILES = 8192, 8, 4
#: Rows of a packed block at most, about, and numbers in its vectors if that makes more than MOST_ROWS rows.
BLOCK_ROWS, BLOCK_NUMBERS = 1 << 16, 1 << 22


def tile_count(rows: int, tile_rows: int, most: int = MOST_ROWS) -> int:
    """Tiles of a table without regions, of so many rows at most."""
    return max(1, min(-(-rows // tile_rows), max(MOST_TILES, -(-rows // most))))


def _with_tiles(df: DataFrame, region: str | None, id_col: str, tile_rows: int) -> tuple[DataFrame, DataFrame | int]:
    """Add ``_t``, the tile of each row, and return the number of tiles, per region or overall.

    The count per region is one small row per region; without regions it is one number.
    """
    bucket = F.xxhash64(id_col, F.lit("tile"))
    if region is None:
        tiles = tile_count(df.count(), tile_rows)
        return df.withColumn("_t", F.pmod(bucket, F.lit(tiles)).cast("int")), tiles
    fewest = F.greatest(F.lit(REGION_TILES), F.ceil(F.count("*") / MOST_ROWS))
    counts = df.groupBy(region).agg(F.least(F.ceil(F.count("*") / tile_rows), fewest).cast("int").alias("_n"))
    return df.join(counts, region).withColumn("_t", F.pmod(bucket, F.col("_n")).cast("int")).drop("_n"), counts


def _upto(df: DataFrame, region: str | None, tiles: DataFrame | int, name: str) -> DataFrame:
    """Add the number of tiles on the other side as a column."""
    if isinstance(tiles, int):
        return df.withColumn(name, F.lit(tiles))
    return df.join(tiles.withColumnRenamed("_n", name), region)


def tile_join(
    left: DataFrame,
    right: DataFrame,
    region: str | None,
    left_id: str,
    right_id: str,
    emit: Callable[[pa.Table, pa.Table], pa.Table],
    schema: StructType | str,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``emit`` sees every pair of a left and a right tile of a region exactly once."""
    left, left_tiles = _with_tiles(left, region, left_id, tile_rows)
    right, right_tiles = _with_tiles(right, region, right_id, tile_rows)
    others = F.explode(F.expr("sequence(0, _others - 1)"))
    lhs = _upto(left, region, right_tiles, "_others").select("*", others.alias("_j")).withColumnRenamed("_t", "_i")
    rhs = _upto(right, region, left_tiles, "_others").select("*", others.alias("_i")).withColumnRenamed("_t", "_j")
    return _cogroup(lhs.drop("_others"), rhs.drop("_others"), region, emit, schema)


def tile_self_join(
    df: DataFrame,
    region: str | None,
    id_col: str,
    emit: Callable[[pa.Table, pa.Table, bool], pa.Table],
    schema: StructType | str,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``emit`` sees every unordered pair of tiles of a region once, a tile with itself flagged True."""
    tiled, tiles = _with_tiles(df, region, id_col, tile_rows)
    later = F.explode(F.expr("sequence(_t, _others - 1)"))
    lhs = _upto(tiled, region, tiles, "_others").select("*", later.alias("_j")).withColumnRenamed("_t", "_i").drop("_others")
    # The diagonal tile is compared with itself, so it is not sent twice.
    earlier = F.explode(F.expr("sequence(0, _t - 1)"))
    rhs = tiled.where("_t > 0").select("*", earlier.alias("_i")).withColumnRenamed("_t", "_j")

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        diagonal = a.num_rows > 0 and a.column("_i")[0].as_py() == a.column("_j")[0].as_py()
        return emit(a, a if diagonal else b, diagonal)

    return _cogroup(lhs, rhs, region, both, schema)


def _cogroup(lhs: DataFrame, rhs: DataFrame, region: str | None, emit, schema: StructType | str) -> DataFrame:
    key = ([region] if region else []) + ["_i", "_j"]
    # Fresh column identities, so that a table can be compared with itself.
    rhs = rhs.select(*[F.col(c).alias(c) for c in rhs.columns])
    return lhs.groupBy(*key).cogroup(rhs.groupBy(*key)).applyInArrow(emit, schema)


def block_self_join(
    df: DataFrame,
    emit: Callable[[pa.Table, pa.Table, bool], Iterator[pa.Table]],
    schema: StructType | str,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``emit`` sees every unordered pair of blocks of a table with a ``vector`` once, a block with itself flagged True; it sends on table by table.

    The rows are dealt out and stored once, a block of them packed into one value, and blocks meet by their numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                stream.write_table(pa.Table.from_batches(held).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    size = df.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width")).first()
    blocks = tile_count(size.rows, tile_rows, max(MOST_ROWS, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, size.width or 1))))
    # A partition is a block and gives it its number.
    dealt = df.repartition(blocks).mapInArrow(pack, "rows binary").withColumn("_t", F.spark_partition_id())
    stored = write_aside(dealt, "blocks")
    one = stored.select(F.col("_t").alias("_i"), F.explode(F.expr(f"sequence(_t, {blocks - 1})")).alias("_j"), F.col("rows").alias("_i_rows"))
    # The block with itself is not sent twice.
    two = stored.where("_t > 0").select(F.explode(F.expr("sequence(0, _t - 1)")).alias("_i"), F.col("_t").alias("_j"), F.col("rows").alias("_j_rows"))
    # Not broadcast: its copies are more than the stored table says.
    pairs = one.join(two.hint("merge"), ["_i", "_j"], "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                i, a, j, b = (batch.column(c)[n] for c in ("_i", "_i_rows", "_j", "_j_rows"))
                diagonal = i.as_py() == j.as_py()
                if not diagonal and not b.is_valid:  # a block without rows
                    continue
                a, b = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (a, a if diagonal else b))
                for found in emit(a, b, diagonal):
                    yield from pa.table([c.cast(f.type) for c, f in zip(found.columns, out, strict=True)], schema=out).to_batches()

    return pairs.mapInArrow(compare, schema)
