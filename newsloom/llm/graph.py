"""Connected components of an undirected graph of long ids, by alternating stars on stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import remove, written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every id in ``links(a, b)``: the smallest id reachable from it.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): a large star hangs all
    larger neighbours on the smallest one, a small star the smaller ones. The number of rounds
    grows with the logarithm of the size. Each round only groups and joins edges, no adjacency
    list is ever gathered; a hub is one key of an aggregation and of a join that adaptive
    execution may split. Every round is stored in the shared folder, the one before it removed.
    Loops and repeated links are allowed, links with a NULL end are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "cc")
    last = _print(edges)
    for _ in range(MOST_ROUNDS):
        turned = _small_star(_large_star(edges))
        after = written(turned, "cc")
        remove(edges)
        edges, seen = after, _print(after)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)


def _print(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: two numbers that tell whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # As many edges as before; the small star drops those that have become the same.
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end already."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
