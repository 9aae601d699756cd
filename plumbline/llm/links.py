"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return (
        both.where(F.col("b") > F.col("a"))
        .join(low, "a")
        .select(F.col("low").alias("a"), "b")
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    inner = edges.join(low, "b").select(F.col("low").alias("a"), F.col("a").alias("b"))
    own = low.select(F.col("low").alias("a"), "b")
    return inner.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and sum, which tell whether they changed."""
    table = written(edges, "edges")
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return table, tuple(table.agg(F.count("*"), F.sum(hashed)).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b); the root is the smallest node reachable.

    Alternating large and small stars: each turn is a few joins, the driver sees two
    numbers per turn, and a hub is only a hot join key. Turns grow with the logarithm of
    the longest path. Edges may repeat and point either way; loops and NULLs are ignored.
    """
    edges, state = _stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    while True:
        before = state
        edges, state = _stored(_small_star(_large_star(edges)))
        if state == before:
            break
    roots = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
    heads = roots.select(F.col("root").alias("id"), "root").distinct()
    return roots.unionByName(heads)
