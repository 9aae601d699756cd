"""Nearest neighbours with a vantage-point tree per shard.

A node of such a tree keeps one vector as its vantage point and the range of distances of
each half of the others to it. A top tree, grown from a bounded sample, deals all vectors
to its leaves; a leaf that holds more than a shard's rows, such as one vector repeated, is
dealt to several shards by id. One task builds the tree of a shard.

Queries first search the shards of their own leaf. The k-th distance found there is their
reach, and of the other leaves they go to those that the triangle inequality leaves within
it, in the top tree as in the shards' trees. ``factor`` relaxes that test: a half is left
out if factor * bound exceeds the distance found so far, so one is exact and more is faster.
Queries come in blocks; what the trees find is merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.sources.shared import counted, written

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF_ROWS = 256
FACTOR = 1.0
#: Vectors that the top tree is grown from, those whose ids hash lowest. It only decides
#: which shard holds a vector; all are indexed.
TOP_SAMPLE = 4096
#: Leaves whose sizes are broadcast; there are more only if vectors have as many lengths.
SMALL_ROWS = 65_536

_CELLS = 1 << 15


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, in double precision. The
    components are added in order, so a pair has one distance however rows are grouped."""
    out = np.zeros((len(a), len(b)))
    step = max(1, _CELLS // max(1, len(b)))
    for k in range(0, len(a), step):
        total = out[k : k + step]
        for x, y in zip(a[k : k + step].T, b.T):
            gap = x[:, None] - y[None, :]
            gap *= gap
            total += gap
        np.sqrt(total, out=total)
    return out


def build(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes). A node is (first, last, left, right, and the smallest and
    largest distance to its vantage point in either half); a leaf has no children (-1). The
    vantage point of a node is its first row."""
    order = np.arange(len(vectors))
    nodes: list[list[float]] = []

    def grow(first: int, last: int) -> int:
        own = len(nodes)
        nodes.append([first, last, -1, -1, 0, 0, 0, 0])
        if last - first <= leaf_rows:
            return own
        rows = order[first:last]
        # A point at the rim sees the others at more different distances.
        far = int(np.argmax(distances(vectors[rows[:1]], vectors[rows])[0]))
        rows[0], rows[far] = rows[far], rows[0]
        away = distances(vectors[rows[:1]], vectors[rows[1:]])[0]
        by = np.argsort(away, kind="stable")
        order[first + 1 : last] = rows[1:][by]
        away = away[by]
        half = len(away) // 2
        middle = first + 1 + half
        nodes[own][4:] = [away[0], away[half - 1], away[half], away[-1]]
        nodes[own][2] = grow(first + 1, middle)
        nodes[own][3] = grow(middle, last)
        return own

    if len(vectors):
        grow(0, len(vectors))
    return order, np.array(nodes, float).reshape(-1, 8)


class TopTree:
    """The tree that deals vectors to leaves. A vector is in the first half of a node if it
    is nearer to the vantage point than the sample's second half. Leaves are numbered as
    nodes."""

    def __init__(self, sample: np.ndarray, n_leaves: int):
        order, nodes = build(sample, max(1, -(-len(sample) // n_leaves)))
        inner = nodes[:, 2] >= 0
        self.halves = np.where(inner[:, None], nodes[:, 2:4], -1).astype(int)
        self.radius = nodes[:, 6]
        self.points = np.zeros((len(nodes), sample.shape[1]))
        self.points[inner] = sample[order[nodes[inner, 0].astype(int)]]

    def walk(self, vectors: np.ndarray, reach: np.ndarray, factor: float):
        """(leaf, rows) of all leaves that may hold what is within the reach of a row;
        a negative reach leads to the one leaf that a row itself is in."""
        turns = [(0, np.arange(len(vectors)))]
        while turns:
            node, rows = turns.pop()
            first, second = self.halves[node]
            if not len(rows):
                continue
            if first < 0:
                yield node, rows
                continue
            away = distances(vectors[rows], self.points[node : node + 1])[:, 0]
            radius = self.radius[node]
            # Distances are rounded; never leave out what could tie.
            slack = 1e-12 * (1 + away + radius)
            near = (away < radius) | (factor * (away - radius - slack) <= reach[rows])
            far = (away >= radius) | (factor * (radius - away - slack) <= reach[rows])
            own = reach[rows] < 0
            turns.append((first, rows[np.where(own, away < radius, near)]))
            turns.append((second, rows[np.where(own, away >= radius, far)]))


class Nearest:
    """The k nearest of the rows seen so far for a block of queries; ties to smaller ids.
    What is beyond the reach of a query is not looked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray, k: int):
        self.ids, self.vectors = ids, vectors
        self.away = np.repeat(reach[:, None], k, axis=1)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, at: np.ndarray, ids: np.ndarray, away: np.ndarray) -> None:
        """Rows ``ids`` at distances ``away`` from the queries numbered ``at``."""
        x, y = np.nonzero(away <= self.away[at, -1:])
        other = self.ids[at[x]] != ids[y]
        x, y = x[other], y[other]
        if not len(x):
            return
        # What each of these queries has, and what is new, sorted by query.
        touched = np.unique(x)
        k = self.away.shape[1]
        owner = np.concatenate([np.repeat(touched, k), x])
        dist = np.concatenate([self.away[at[touched]].ravel(), away[x, y]])
        found = np.concatenate([self.found[at[touched]].ravel(), ids[y]])
        order = np.lexsort((found, dist, owner))
        first = np.searchsorted(owner[order], touched)
        best = order[first[:, None] + np.arange(k)[None, :]]
        self.away[at[touched]] = dist[best]
        self.found[at[touched]] = found[best]


def search(
    nodes: np.ndarray, ids: np.ndarray, vectors: np.ndarray, near: Nearest, factor: float
) -> None:
    """Visit the tree with all queries at once, the half that is nearer to most first."""

    def open_to(at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        # Bounds are rounded; never leave out what could tie.
        return at[factor * (bound * (1 - 1e-12) - 1e-12) <= near.away[at, -1]]

    def visit(node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        first, last, left, right = (int(x) for x in nodes[node, :4])
        if left < 0:
            near.see(at, ids[first:last], distances(near.vectors[at], vectors[first:last]))
            return
        away = distances(near.vectors[at], vectors[first : first + 1])
        near.see(at, ids[first : first + 1], away)
        away = away[:, 0]
        bounds = [
            np.maximum(0, np.maximum(low - away, away - high))
            for low, high in (nodes[node, 4:6], nodes[node, 6:8])
        ]
        turns = (0, 1) if 2 * (bounds[0] <= bounds[1]).sum() >= len(at) else (1, 0)
        for k in turns:
            visit((left, right)[k], open_to(at, bounds[k]))

    if len(nodes):
        visit(0, np.arange(len(near.ids)))


def usable(vector: Column) -> Column:
    """Not NULL or empty, all components finite, not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(table.num_rows, -1)


_TREE = "dim int, leaf int, part bigint, ids binary, vectors binary, nodes binary"


def top_trees(rows: DataFrame, n_leaves: int) -> dict[int, TopTree]:
    """A top tree per length of vectors in the sample."""
    lowest = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id")
    by_length: dict[int, list] = {}
    for row in lowest.limit(TOP_SAMPLE).collect():
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    return {n: TopTree(np.array(held, float), n_leaves) for n, held in by_length.items()}


def _by_length(batch: pa.RecordBatch):
    """(length, rows, matrix) of the vectors of a batch."""
    table = pa.Table.from_batches([batch])
    dim = table.column("dim").to_numpy()
    for n in np.unique(dim):
        at = np.flatnonzero(dim == n)
        held = table.take(pa.array(at))
        yield int(n), held, _matrix(held)


def _with_leaf(held: pa.Table, rows: np.ndarray, leaves: np.ndarray) -> list[pa.RecordBatch]:
    dealt = held.take(pa.array(rows)).append_column("leaf", pa.array(leaves, pa.int32()))
    return dealt.combine_chunks().to_batches()


def dealt(rows: DataFrame, trees: dict[int, TopTree]) -> DataFrame:
    """``rows`` with the ``leaf`` they are in; 0 for lengths that the sample has not met."""

    def run(batches):
        for batch in batches:
            for n, held, vectors in _by_length(batch) if batch.num_rows else ():
                leaves = np.zeros(len(vectors), int)
                if n in trees:
                    for leaf, at in trees[n].walk(vectors, np.full(len(vectors), -1.0), 1.0):
                        leaves[at] = leaf
                yield from _with_leaf(held, np.arange(len(vectors)), leaves)

    schema = "vec_id bigint, vector array<double>, dim int, leaf int"
    return rows.select("vec_id", "vector", F.size("vector").alias("dim")).mapInArrow(run, schema)


def visits(asked: DataFrame, trees: dict[int, TopTree], factor: float) -> DataFrame:
    """Queries with each ``leaf`` but their own ``home`` that is within their reach."""

    def run(batches):
        for batch in batches:
            for n, held, vectors in _by_length(batch) if batch.num_rows else ():
                if n not in trees:
                    continue
                home, reach = (held.column(c).to_numpy() for c in ("home", "reach"))
                for leaf, at in trees[n].walk(vectors, reach, factor):
                    at = at[home[at] != leaf]
                    yield from _with_leaf(held, at, np.full(len(at), leaf))

    schema = "query_id bigint, vector array<double>, dim int, home int, reach double, leaf int"
    return asked.select("query_id", "vector", "dim", "home", "reach").mapInArrow(run, schema)


def _sized(df: DataFrame) -> DataFrame:
    """Few rows, broadcast if they are."""
    table, n = counted(df, "leaves")
    return F.broadcast(table) if n <= SMALL_ROWS else table


def build_index(
    rows: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS
) -> tuple[DataFrame, DataFrame]:
    """A row per shard with its tree, written to the shared folder, and the number of shards
    ``n_parts`` of every leaf. ``rows`` are ``dealt``, their ids distinct."""

    def tree(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], _matrix(table)[by_id]
        order, nodes = build(vectors, leaf_rows)
        held = [ids[order].tobytes(), vectors[order].tobytes(), nodes.tobytes()]
        columns = [[x.as_py()] for x in key] + [[x] for x in held]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            ["dim", "leaf", "part", "ids", "vectors", "nodes"],
        )

    n_parts = F.ceil(F.count("*") / F.lit(shard_rows)).alias("n_parts")
    leaves = _sized(rows.groupBy("dim", "leaf").agg(n_parts))
    trees = (
        rows.join(leaves, ["dim", "leaf"])
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("n_parts")).cast("bigint"))
        .select("dim", "leaf", "part", "vec_id", "vector")
        .groupBy("dim", "leaf", "part")
        .applyInArrow(tree, _TREE)
    )
    return written(trees, "trees"), leaves


def searched(
    trees: DataFrame, leaves: DataFrame, asked: DataFrame, k: int, factor: float, block_queries: int
) -> DataFrame:
    """(query_id, vec_id, score): what the trees of a query's ``leaf`` hold within its reach."""
    n_blocks = F.ceil(F.count("*") / F.lit(block_queries)).alias("n_blocks")
    shape = _sized(asked.groupBy("dim", "leaf").agg(n_blocks).join(leaves, ["dim", "leaf"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keys = ["dim", "leaf", "part", "block"]
    block = F.pmod(F.xxhash64(F.lit(1), "query_id"), F.col("n_blocks")).cast("bigint")
    queries = (
        asked.join(shape, ["dim", "leaf"])
        .withColumn("block", block)
        .select("dim", "leaf", "block", "query_id", "vector", "reach", every("n_parts").alias("part"))
    )
    held = trees.join(shape, ["dim", "leaf"]).select(
        "dim", "leaf", "part", "ids", "vectors", "nodes", every("n_blocks").alias("block")
    )
    return (
        held.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInArrow(_found(k, factor), "query_id bigint, vec_id bigint, score double")
    )


def _found(k: int, factor: float):
    names = ["query_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.float64()]

    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        if not trees.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        ids, reach = (queries.column(c).to_numpy() for c in ("query_id", "reach"))
        near = Nearest(ids, _matrix(queries), reach, k)
        for row in trees.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            vectors = np.frombuffer(row["vectors"]).reshape(len(ids), -1)
            search(np.frombuffer(row["nodes"]).reshape(-1, 8), ids, vectors, near, factor)
        seen = near.found < np.iinfo(np.int64).max
        owner = np.broadcast_to(near.ids[:, None], seen.shape)
        columns = [owner[seen], near.found[seen], near.away[seen]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    factor: float = FACTOR,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query row, from rank 1.

    ``queries`` is a condition on the id, as the column ``vec_id``. Nearness is the
    Euclidean distance in double precision; ties go to the smaller id; a row is no
    neighbour of its own. Rows take no part if the id is NULL or the vector is NULL, empty,
    zero, or has a NULL or non-finite component. Only vectors of one length are compared.
    Of rows that share an id the smallest vector counts. Fewer candidates give fewer ranks,
    no rows none; other columns are not read.
    """
    vector = col(vector_column).cast("array<double>")
    rows, n_rows = counted(
        rows.select(col(id_column).cast("bigint").alias("vec_id"), vector.alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector")),
        "vectors",
    )
    top = top_trees(rows, max(1, -(-n_rows // shard_rows)))
    rows = written(dealt(rows, top), "dealt")
    trees, leaves = build_index(rows, shard_rows)
    asked = rows.where(queries).select(
        F.col("vec_id").alias("query_id"),
        "vector",
        "dim",
        F.col("leaf").alias("home"),
    )
    own = asked.withColumns({"leaf": F.col("home"), "reach": F.lit(float("inf"))})
    at_home = _ranked(searched(trees, leaves, own, k, factor, block_queries), k)
    if all(len(tree.halves) == 1 for tree in top.values()):
        return at_home  # there are no other leaves
    at_home = written(at_home, "near")
    reach = at_home.where(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    reaching = asked.join(reach, "query_id", "left").withColumn(
        "reach", F.coalesce("reach", F.lit(float("inf")))
    )
    others = written(visits(reaching, top, factor), "visits")
    further = searched(trees, leaves, others, k, factor, block_queries)
    return _ranked(at_home.drop("rank").unionByName(further), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        found.withColumn("rank", ranked)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
