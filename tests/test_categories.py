"""Vocabularies as tables, wide models, early stopping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import categories
from plumbline.operators.categories import add_positions, category_index, vocabulary_sizes
from plumbline.plans import models
from plumbline.spec import FeatureSpec


def test_positions_follow_count_and_name(spark):
    rows = [("b", 1), ("a", 1), ("c", 2), ("c", None), (None, 2), ("b", 2)]
    df = spark.createDataFrame(rows, "`x.y` string, z int")
    index = category_index(df, ("x.y", "z"), rows_per_range=2)
    found = sorted((r["feature"], r["category"], r["n"], r["position"]) for r in index.collect())
    assert found == [
        ("x.y", "a", 1, 2), ("x.y", "b", 2, 0), ("x.y", "c", 2, 1), ("z", "1", 2, 1), ("z", "2", 3, 0),
    ]
    other = spark.createDataFrame([("a", 2), ("q", None), (None, 9)], "`x.y` string, z int")
    placed = add_positions(other, index, {"x.y": "p", "z": "q"})
    assert sorted(map(tuple, placed.select("p", "q").collect()), key=str) == sorted(
        [(2, 0), (None, None), (None, None)], key=str
    )
    assert category_index(df.limit(0), ("z",)).count() == 0
    with pytest.raises(ValueError):
        category_index(df, ())


def test_rare_categories_are_joined_under_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(categories, "FREQUENT", 3)
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
            F.concat(F.lit("c"), (F.col("id") % 700).cast("string"))
        ).alias("k")
    )
    index = category_index(df, ("k",), rows_per_range=100)
    place = {r["category"]: r["position"] for r in index.collect()}
    assert sorted(place.values()) == list(range(len(place))) and place["hot"] == 0
    rows = add_positions(df, index, {"k": "p"}).collect()
    assert len(rows) == 5000 and all(r["p"] == (None if r["k"] is None else place[r["k"]]) for r in rows)


def test_vocabulary_of_many_categories_stays_off_the_driver(spark):
    n = 300_000
    df = spark.range(n).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("k"))
    index = category_index(df, ("k",), rows_per_range=50_000)
    assert vocabulary_sizes(index) == {"k": n}
    ends = index.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(ends) == (0, n - 1, n)
    sizes = {"k0": n}
    named = index.withColumn("feature", F.lit("k0"))
    frame = df.limit(2000).select(F.col("k").alias("k0"), F.lit(1.5).alias("n0"), F.lit(1.0).alias("label"))
    wide = models.wide_frame(frame, FeatureSpec(("a",), ("k",), target="t"), named, sizes)
    vector = wide.first()["features"]
    assert len(vector) == n + 1 and vector.indices[0] == 0 and vector.values.tolist() == [1.5, 1.0]


def _people(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x, k = rng.normal(size=n), rng.integers(0, 6, n)
    y = (x + 0.4 * k + rng.logistic(size=n) > 1.2).astype(int)
    rows = [(float(a), f"c{b}" if b else None, int(c)) for a, b, c in zip(x, k, y)]
    return spark.createDataFrame(rows, "x double, k string, y int")


def test_wide_model_equals_the_indexed_one(spark):
    spec = FeatureSpec(("x",), ("k",), target="y")
    frame = models.model_frame(_people(spark), spec)
    plain = models.fit_logistic(frame, spec)
    wide = models.fit_logistic_wide(frame, spec)
    a, b = plain.stages[-1].coefficients.toArray(), wide.model.stages[-1].coefficients.toArray()
    assert len(a) == len(b) == 6 and np.allclose(a, b, atol=2e-3)
    later = models.model_frame(_people(spark, 200, 4).unionByName(_people(spark, 5).limit(1).withColumn("k", F.lit("new"))), spec)

    def scores(model):
        return sorted(r["score"] for r in models.positive_score(model.transform(later)).collect())

    assert np.allclose(scores(plain), scores(wide), atol=2e-3)


def test_early_stopping_keeps_fewer_trees(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v), int(rng.random() < 0.5)) for v in rng.normal(size=1500)]
    df = spark.createDataFrame(rows, "x double, y int")
    spec = FeatureSpec(("x",), target="y")
    frame = models.model_frame(df, spec)
    full = models.fit_trees(frame, spec, rounds=12)
    short = models.fit_trees(frame, spec, rounds=12, early_stopping=True)
    again = models.fit_trees(frame.repartition(5), spec, rounds=12, early_stopping=True)
    assert full.stages[-1].getNumTrees == 12 > short.stages[-1].getNumTrees == again.stages[-1].getNumTrees
    tiny = models.fit_trees(frame.limit(1), spec, rounds=2, early_stopping=True)
    assert tiny.stages[-1].getNumTrees >= 1
