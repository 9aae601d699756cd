"""Nearest neighbours against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import vptree
from plumbline.llm.vptree import TopTree, build, distances, nearest


def asked():
    return F.col("vec_id") % 10 == 0


def brute(rows, k):
    out = set()
    usable = {}
    for i, v in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    for q, a in usable.items():
        if q % 10:
            continue
        near = sorted(
            (float(np.sqrt(((np.float32(a).astype(float) - np.float32(b).astype(float)) ** 2).sum())), j)
            for j, b in usable.items()
            if j != q and len(a) == len(b)
        )
        out |= {(q, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near[:k])}
    return out


def found_rows(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(500)]
    out += [(i, [1.0] * 8) for i in range(500, 700)]  # one vector, many times
    out += [(700, None), (710, []), (720, [0.0] * 8), (730, [None] * 8), (740, [float("nan")] * 8)]
    out += [(750, [float("inf")] + [1.0] * 7), (760, [1.0, 2.0]), (761, [1.0, 2.5]), (None, [1.0] * 8)]
    out += [(770, [1.5] * 8), (770, [1.25] * 8), (771, [1.25] * 8), (771, [1.25] * 8)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    schema = "vec_id bigint, embedding array<float>, vector int, shard int, dim int"
    return spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], schema).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 100, "block_queries": 16}])
def test_factor_one_is_exact(table, rows, sizes):
    assert found_rows(nearest(table, asked(), k=10, **sizes)) == brute(rows, 10)


def test_queries_go_to_leaves_within_reach_only(spark, monkeypatch):
    # Forty far groups: what is near to a query is in its own leaf, or in one beside it.
    rng = np.random.default_rng(8)
    rows = [(i, (100 * (i % 40) + rng.normal(size=4)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    seen = []
    original = vptree.visits
    monkeypatch.setattr(vptree, "visits", lambda *a: seen.append(original(*a)) or seen[-1])
    assert found_rows(nearest(df, asked(), shard_rows=100)) == brute(rows, 10)
    assert seen[0].count() < 400 * 40 / 4


def test_top_tree_leaves_nothing_out():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(300, 3)), np.ones((100, 3))])
    tree = TopTree(vectors[::4], 8)
    leaf = np.full(400, -1)
    for number, rows in tree.walk(vectors, np.full(400, -1.0), 1.0):
        assert (leaf[rows] == -1).all()
        leaf[rows] = number
    assert (leaf >= 0).all()
    away = distances(vectors, vectors)
    reach = np.sort(away, axis=1)[:, 5]
    opened = {(r, n) for n, rows in tree.walk(vectors, reach, 1.0) for r in rows}
    for r, c in zip(*np.nonzero(away <= reach[:, None])):
        assert (r, leaf[c]) in opened


def test_larger_factors_prune_more_and_find_most(table, rows):
    exact = {x[::2] for x in brute(rows, 10)}
    for factor in (1.2, 1.5):
        found = {x[::2] for x in found_rows(nearest(table, asked(), factor=factor, shard_rows=200))}
        assert len(found & exact) >= 0.9 * len(exact)


def test_fewer_candidates_than_ranks(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert found_rows(nearest(df, asked())) == {(0, 1, 1, round(2**0.5, 9))}


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nearest(df, asked()).collect() == []


def test_every_row_is_in_the_tree():
    vectors = np.random.default_rng(1).normal(size=(333, 5))
    order, nodes = build(vectors, 10)
    assert sorted(order.tolist()) == list(range(333))
    leaves = nodes[nodes[:, 2] < 0]
    inner = nodes[nodes[:, 2] >= 0]
    assert (leaves[:, 1] - leaves[:, 0]).sum() + len(inner) == 333
