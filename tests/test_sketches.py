"""Sketches per part against exact results over the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.quantiles import quantile_edges
from plumbline.operators.sketches import (
    distinct_error,
    merged,
    rank_error,
    sketch_parts,
    sketched_baseline,
    sketched_categorical_profile,
    sketched_numeric_profile,
    sketched_quantiles,
    store_parts,
    stored_parts,
)
from plumbline.operators.summary import categorical_profile, numeric_profile
from plumbline.sources.shared import new_folder
from plumbline.spec import FeatureSpec

SPEC = FeatureSpec(("x", "one", "nothing"), ("kind", "name", "empty"))


@pytest.fixture(scope="module")
def rows(spark):
    """Thirty days; the first holds a third of the rows, and values drift from day to day."""
    rng = np.random.default_rng(5)
    n = 60_000
    day = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 30, n))
    frame = pd.DataFrame(
        {
            "day": [f"2024-03-{d + 1:02d}" for d in day],
            "x": 1e6 + rng.lognormal(0, 2, n) * (1 + day),
            "one": 7.0,
            "nothing": None,
            "kind": rng.choice(["a", "b", "ü"], n, p=[0.6, 0.3, 0.1]),
            "name": [f"n{i}" for i in rng.integers(0, 30_000, n)],
            "empty": None,
        }
    )
    frame.loc[::17, "x"] = None
    frame.loc[::19, "kind"] = None
    df = spark.createDataFrame(frame, "day string, x double, one double, nothing double, "
                                      "kind string, name string, empty string")
    return df.repartition(8).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


@pytest.fixture(scope="module")
def store(spark, rows):
    path = new_folder(spark, "days")
    store_parts(sketch_parts(rows, SPEC, F.col("day")), path)
    return path


def test_quantiles_within_the_stated_rank_error(spark, rows, store):
    shares = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    found = sketched_quantiles(merged(stored_parts(spark, store)), shares)
    values = np.sort([r["x"] for r in rows.where("x IS NOT NULL").select("x").collect()])
    seen = {r["share"]: r["value"] for r in found.where("feature = 'x'").collect()}
    assert set(seen) == set(shares)
    for share, value in seen.items():
        low = np.searchsorted(values, value, "left") / len(values)
        high = np.searchsorted(values, value, "right") / len(values)
        assert low - rank_error() <= share <= high + rank_error()
    assert {r["value"] for r in found.where("feature = 'one'").collect()} == {7.0}
    assert found.where("feature = 'nothing'").count() == 0


def test_baseline_has_exact_ends(spark, rows, store):
    baseline = sketched_baseline(merged(stored_parts(spark, store)))
    exact = quantile_edges(rows, ["x", "one", "nothing"])
    assert baseline.edges["x"][0] == exact["x"][0]
    assert baseline.edges["x"][-1] == exact["x"][-1]
    assert len(baseline.edges["x"]) == 11
    assert baseline.edges["one"] == exact["one"]
    assert baseline.edges["nothing"] == exact["nothing"]
    assert baseline.categorical == ("empty", "kind", "name")


def test_moments_merge_exactly(spark, rows, store):
    found = sketched_numeric_profile(merged(stored_parts(spark, store)))
    exact = {r["feature"]: r for r in numeric_profile(rows, list(SPEC.numeric)).collect()}
    for r in found.collect():
        want = exact[r["feature"]]
        assert r["empty"] == want["empty"]
        for name in ("mean", "std", "min", "max"):
            if want[name] is None:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(want[name], rel=1e-9, abs=1e-9)


def test_categories(spark, rows, store):
    found = sketched_categorical_profile(merged(stored_parts(spark, store)))
    exact = categorical_profile(rows, list(SPEC.categorical))
    want = [tuple(r) for r in exact.where("feature = 'kind'").orderBy("position").collect()]
    assert [tuple(r) for r in found.where("feature = 'kind'").orderBy("position").collect()] == want
    n_unique = exact.where("feature = 'name'").first()["n_unique"]
    names = found.where("feature = 'name'").collect()
    assert [(r["value"], r["n"], r["position"]) for r in names] == [(None, None, None)]
    assert all(abs(r["n_unique"] - n_unique) <= distinct_error() * n_unique for r in names)
    assert found.where("feature = 'empty'").count() == 0


def test_a_part_written_again_replaces_itself(spark, rows, store):
    before = merged(stored_parts(spark, store)).where("feature = 'x'").first()
    store_parts(sketch_parts(rows.where("day = '2024-03-05'"), SPEC, F.col("day")), store)
    after = merged(stored_parts(spark, store)).where("feature = 'x'").first()
    for name in ("n_parts", "n_rows", "n", "low", "high"):
        assert before[name] == after[name]


def test_a_run_of_days_reads_their_folders_only(spark, rows, store):
    parts = stored_parts(spark, store, "2024-03-04", "2024-03-06")
    assert len(parts.inputFiles()) == 30
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    n = merged(parts).where("feature = 'x'").first()["n"]
    assert n == rows.where("day BETWEEN '2024-03-04' AND '2024-03-06' AND x IS NOT NULL").count()


def test_no_rows(spark, rows):
    none = sketch_parts(rows.limit(0), SPEC, F.col("day"))
    assert none.count() == 0
    assert merged(none).count() == 0
    assert sketched_baseline(merged(none)).edges == {}


def test_more_values_than_are_tracked(spark, rows):
    parts = sketch_parts(rows, FeatureSpec((), ("name", "kind")), F.col("day"), tracked=64)
    found = sketched_categorical_profile(merged(parts, tracked=64), 3, tracked=64)
    kinds = {r["value"]: r["n"] for r in found.where("feature = 'kind'").collect()}
    assert kinds == {r["kind"]: r["count"] for r in rows.where("kind IS NOT NULL").groupBy("kind").count().collect()}
    assert all((r["n"] or 0) <= 60_000 * 3.5 / 64 for r in found.where("feature = 'name'").collect())
