"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time 0..1, linear between knots. Its integral is
the source's weight: it decides how many words of the mix come from the source. Its cumulative
integral is the share of those words demanded up to a time, so a document whose words end a given
share of the source's words is due at the time where that integral is reached. Each document gets
the time of each of its copies, and the documents are range-sorted by it.

Within a source documents stand in a random order fixed by a hash of their id. Their cumulative
word counts come from sums over buckets of that order and running sums inside a bucket, so the
hottest source is as many tasks as others; only sums by source and bucket meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, written

#: Documents of a bucket of the order, about.
BUCKET_ROWS = 4096
MOST_EPOCHS = 3


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots: Column) -> Column:
    """The linear pieces of a schedule ``array<struct<t, w>>`` with the integral up to each piece's start (a0) and end (a1)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        F.element_at(knots, i)["t"].alias("t0"), F.element_at(knots, i + 1)["t"].alias("t1"),
        F.element_at(knots, i)["w"].alias("w0"), F.element_at(knots, i + 1)["w"].alias("w1"),
    ))
    none = F.expr("CAST(array() AS array<struct<t0: double, t1: double, w0: double, w1: double, a0: double, a1: double>>)")

    def grow(done: Column, piece: Column) -> Column:
        a0 = F.when(F.size(done) > 0, F.element_at(done, -1)["a1"]).otherwise(F.lit(0.0))
        a1 = a0 + (piece["w0"] + piece["w1"]) / 2 * (piece["t1"] - piece["t0"])
        return F.concat(done, F.array(F.struct(piece["t0"], piece["t1"], piece["w0"], piece["w1"], a0.alias("a0"), a1.alias("a1"))))

    return F.aggregate(pairs, none, grow)


def due(pieces: Column, share: Column) -> Column:
    """The time at which the integral of the schedule reaches a share of the whole: the inverse of the cumulative demand."""
    area = share * F.element_at(pieces, -1)["a1"]
    piece = F.coalesce(F.element_at(F.filter(pieces, lambda p: p["a1"] >= area), 1), F.element_at(pieces, -1))

    def solve(p: Column) -> Column:
        rest = F.greatest(area - p["a0"], F.lit(0.0))
        slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
        down = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * rest, F.lit(0.0)))
        return F.least(p["t1"], p["t0"] + F.when(down > 0, 2 * rest / down).otherwise(F.lit(0.0)))

    return F.transform(F.array(piece), solve)[0]


def cyclic_schedules(sources: DataFrame) -> DataFrame:
    """``source, knots``: sources by code point, NULL last, weigh 1, 2, 3 and so on; early and late ones take turns."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = (number % 3 + 1).cast("double")
    begin = F.when(number % 2 == 0, F.lit(0.5)).otherwise(F.lit(1.5))
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), (w * weight).alias("w"))
    return sources.select("source").distinct().select("source", F.array(knot(0.0, begin), knot(1.0, 2.0 - begin)).alias("knots"))


def targets(sizes: DataFrame, schedules: DataFrame, share: float = 1.0, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target, pieces, sid`` from ``source, source_size`` and the schedules.

    Targets are in proportion to weight and sum up to ``share`` of all words, but none is above
    ``most_epochs`` times its source; what that leaves over goes to the others by weight. One row a
    source, so the windows over all of them are small.
    """
    known = sizes.join(schedules.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumn("pieces", segments(F.col("knots"))).drop("knots")
    known = known.withColumns({"weight": F.element_at("pieces", -1)["a1"], "most": F.col("source_size") * most_epochs})
    ordered = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = known.withColumn("ratio", F.col("most") / F.col("weight")).withColumns({
        "sid": F.row_number().over(ordered),
        "wanted": F.sum("source_size").over(everything) * F.lit(share),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        "capped": F.coalesce(F.sum("most").over(earlier), F.lit(0)),
    })
    # The first source, by ratio, that the level of all later ones does not lift above its most.
    level = (F.col("wanted") - F.col("capped")) / F.col("left")
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    first = F.min(F.when(F.col("fits"), F.struct("sid", "level"))).over(everything)
    ranked = ranked.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("sid") < F.col("first.sid")), F.col("most").cast("double"))
    return ranked.select("source", "source_size", target.otherwise(F.col("first.level") * F.col("weight")).alias("target"), "pieces", "sid")


def order_key(id_col: str, seed: str) -> Column:
    """32 bits of the place of a document in the fixed random order."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def curriculum(
    docs: DataFrame, schedules: DataFrame | None = None, share: float = 1.0, seed: str = "mix", id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The plan of the mix: a row for each different ``source, doc_id, size`` (words) of the documents.

    ``copies`` is how many documents the row stands for, ``source_size`` and ``target`` are words
    of its source, ``takes`` how often the mix takes each of them (0 to 3) and ``positions`` when.
    A source is taken whole as often as its target allows; the rest of the target is taken from the
    beginning of its order, up to the document that has its middle there. NULL is a source like
    others, an empty source has target 0 and positions NULL, a document without words counts 0.
    """
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(f"`{text_col}`").alias("size"))
    units = written(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    schedules = cyclic_schedules(units.select("source")) if schedules is None else schedules
    sources = written(targets(sizes, schedules, share), "mix-sources")
    parts = max(1, -(-units.count() // BUCKET_ROWS))
    key = order_key("doc_id", seed)
    known = units.join(sources.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumns({"key": key, "words": F.col("size") * F.col("copies")})
    known = known.withColumn("bucket", F.floor(F.col("key") * F.lit(parts) / F.lit(2**32)).cast("int"))
    sums = known.groupBy("sid", "bucket").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(offsets, ["sid", "bucket"])
    placed = placed.drop("source").join(sources, "sid")
    middle = F.col("offset") + F.col("ahead") + F.col("words") / 2
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumns({"middle": middle, "rounds": rounds.cast("int")})
    extra = (F.col("middle") <= F.col("target") - F.col("rounds") * F.col("source_size")) & (F.col("target") > 0)
    placed = placed.withColumn("takes", F.least(F.col("rounds") + extra.cast("int"), F.lit(MOST_EPOCHS)))
    times = F.transform(
        F.sequence(F.lit(1), F.col("takes")),
        lambda i: due(F.col("pieces"), F.least(((i - 1) * F.col("source_size") + F.col("middle")) / F.col("target"), F.lit(1.0))),
    )
    return placed.select(
        "source", "doc_id", "size", "copies", "source_size", "target", "takes", F.when(F.col("takes") > 0, times).alias("positions")
    )


def mixed(docs: DataFrame, schedules: DataFrame | None = None, share: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents in training order, each as often as the mix takes it; all columns stay."""
    plan = curriculum(docs, schedules, share, seed, id_col, text_col, source_col).where("takes > 0")
    plan = plan.select(F.col("source").alias("_mix_s"), F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_n"), F.explode("positions").alias("_mix_at"))
    same = (
        F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_mix_id")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_mix_s"))
        & (word_count(f"`{text_col}`") == F.col("_mix_n"))
    )
    taken = docs.join(plan, same)
    return taken.orderBy("_mix_at", "_mix_id").drop("_mix_s", "_mix_id", "_mix_n", "_mix_at")
