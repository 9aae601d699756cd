"""Policy, checks, training, ledgers and streams end to end on small data."""

import datetime
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns
from plumbline.operators import frames, ledger, metrics, split, training
from plumbline.operators.drift import bin_counts
from plumbline.operators.policy import alert_payloads, apply_policy
from plumbline.operators.quantiles import fit_baseline
from plumbline.plans import models
from plumbline.plans.check import log_hook, retrain_hook, run_drift_check
from plumbline.plans.retrain import LedgerError, Ledgers, run_retrain, score_with_production
from plumbline.sources.baselines import load_baseline
from plumbline.sources.shared import new_folder
from plumbline.spec import DriftPolicy, FeatureSpec, Pair
from plumbline.streaming.drift import (
    closed_window_psi,
    file_stream,
    monitor_stream,
    windowed_bins,
    windowed_psi,
    write_counts,
)

COUNTS = ["n_features_high_psi", "n_numeric_ks_significant", "n_categorical_chi2_significant"]


def summary(spark, *values):
    return spark.createDataFrame([values], ", ".join(f"{c} bigint" for c in COUNTS))


def test_policy_triggers_with_reasons(spark):
    row = apply_policy(summary(spark, 2, 0, 0), DriftPolicy(max_high_psi=1)).first()
    assert row["policy_triggered"] and row["trigger_reasons"] == ["high_psi count 2 > 1"]
    row = apply_policy(summary(spark, 1, 3, 4)).first()
    assert row["trigger_reasons"] == [
        "high_psi count 1 > 0", "KS significant 3 > 2", "chi2 significant 4 > 3",
    ]


def test_calm_policy_and_missing_counts(spark):
    row = apply_policy(summary(spark, 0, 0, 1), DriftPolicy(0, 2, 3)).first()
    assert not row["policy_triggered"] and row["trigger_reasons"] == []
    only = spark.createDataFrame([(5,)], "n_numeric_ks_significant bigint")
    assert apply_policy(only).first()["policy_triggered"]


def test_alerts_only_for_triggered(spark):
    checks = summary(spark, 1, 0, 0).union(summary(spark, 0, 0, 0)).withColumn("scenario", F.lit("s"))
    rows = alert_payloads(apply_policy(checks), "scenario", COUNTS).collect()
    assert len(rows) == 1
    payload = json.loads(rows[0]["payload"])
    assert payload["event"] == "drift_policy_triggered" and payload["scenario"] == "s"
    assert payload["trigger_reasons"] == ["high_psi count 1 > 0"]
    assert payload["summary"]["n_features_high_psi"] == 1 and payload["sent_at"]


def labeled(spark, n=240, shift=0.0):
    rng = np.random.default_rng(4)
    a = rng.normal(shift, 1, n)
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "hours.per.week": a,
            "sex": np.where(rng.random(n) < 0.5, "m", "f"),
            "income": np.where(a + rng.normal(0, 0.5, n) > shift, " >50K", " <=50K"),
        }
    )
    return spark.createDataFrame(frame)


SPEC = FeatureSpec(("hours.per.week",), ("sex",), target="income")


def test_check_runs_hooks_and_records_the_run(spark):
    pair = Pair.union(labeled(spark), labeled(spark, shift=3.0))
    runs, seen = new_folder(spark, "test-runs"), []
    result = run_drift_check(
        spark, pair, SPEC, "moved",
        hooks=[log_hook(seen.append), retrain_hook(lambda r, c, s: seen.append((r.count(), c.count(), s)))],
        run_table=runs,
    )
    assert result.triggered and seen[1] == (240, 240, "moved")
    calm = run_drift_check(
        spark, Pair.union(labeled(spark), labeled(spark)), SPEC, "calm",
        hooks=[retrain_hook(lambda *_: seen.append("no"))], run_table=runs,
    )
    assert not calm.triggered and len(seen) == 2
    rows = spark.read.parquet(runs).collect()
    assert {r["scenario"]: r["policy_triggered"] for r in rows} == {"moved": True, "calm": False}
    assert all(r["finished_at"] >= r["started_at"] for r in rows)


def test_a_failing_hook_does_not_lose_the_run(spark):
    runs = new_folder(spark, "test-runs")

    def fail(_):
        raise RuntimeError("hook")

    with pytest.raises(RuntimeError):
        run_drift_check(
            spark, Pair.union(labeled(spark), labeled(spark)), SPEC, "x", hooks=[fail], run_table=runs
        )
    assert spark.read.parquet(runs).count() == 1


def test_unlabeled_current_skips_retraining(spark):
    pair = Pair.union(labeled(spark), labeled(spark, shift=3.0).drop("income"))
    seen = []
    result = run_drift_check(spark, pair, SPEC, "x", hooks=[retrain_hook(lambda *a: seen.append(a))])
    assert result.triggered and seen == [] and result.labeled_current is None


def test_merge_keeps_all_and_drops_duplicates(spark):
    a = spark.createDataFrame([(1, ">50K"), (2, "<=50K")], "age int, income string")
    b = spark.createDataFrame([(3, ">50K"), (4, "<=50K")], "age int, income string")
    assert training.merge_training_data(a, b, "income").count() == 4
    assert training.merge_training_data(a, a.union(a), "income").count() == 2
    assert training.merge_training_data(a, a, "income", drop_duplicates=False).count() == 4
    wide = training.merge_training_data(a, b.withColumn("z", F.lit(1)), "income")
    assert wide.where("z IS NULL").count() == 2
    with pytest.raises(ValueError, match="income"):
        training.merge_training_data(a, b.drop("income"), "income")
    nulls = spark.createDataFrame([(None, "x"), (None, "x")], "age int, income string")
    assert training.merge_training_data(nulls, nulls, "income").count() == 1


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10 + [(None,)] * 5, "y int")
    rows = training.balanced_weights(df, "y").distinct().collect()
    assert {r["y"]: r["weight"] for r in rows} == {
        0: pytest.approx(45 / 90), 1: pytest.approx(1.5), None: pytest.approx(3.0)
    }


def test_unknown_category_is_all_zeros(spark):
    train = spark.createDataFrame([(1.0, "a", 0), (2.0, "b", 1), (3.0, "c", 1)], "x double, k string, y int")
    spec = FeatureSpec(("x",), ("k",), target="y")
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=models.feature_stages(spec)).fit(models.model_frame(train, spec))
    new = spark.createDataFrame([(1.0, "zzz", 0), (1.0, None, 0), (1.0, "c", 0)], "x double, k string, y int")
    vectors = [r["features"].toArray().tolist() for r in fitted.transform(models.model_frame(new, spec)).collect()]
    assert vectors[0] == vectors[1] == [1.0, 0.0, 0.0, 0.0]
    assert sum(vectors[2]) == 2.0


def test_holdout_training_and_scoring(spark):
    data = labeled(spark)
    trained = models.train_and_evaluate(data, SPEC, "id", needle=">50K", rounds=5)
    assert trained.metrics["accuracy"] > 0.75
    assert trained.metrics["n_train"] + trained.metrics["n_test"] == 240
    path = new_folder(spark, "test-model")
    models.save_model(trained.model, path)
    scores = models.batch_scores(
        data.drop("income"), models.load_model(path), SPEC, models.CLASS_NAMES["census"], keep=("id",)
    ).collect()
    assert len(scores) == 240
    assert all((r["prediction"] == 1) == (r["predicted_class"] == ">50K") for r in scores)
    assert all((r["positive_probability"] > 0.5) == (r["prediction"] == 1) for r in scores)
    with pytest.raises(ValueError, match="Feature columns not found: sex"):
        models.batch_scores(data.drop("sex"), trained.model, SPEC, ("a", "b"))


def _partition_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_are_spread_evenly(spark, monkeypatch):
    df = spark.range(0, 900, 1, 1).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"))
    assert _partition_sizes(frames.spread_evenly(df, 900)) == [900]  # too few to move
    monkeypatch.setattr(frames, "LEAST_ROWS", 100)
    even = frames.spread_evenly(df, 900)
    assert sorted(_partition_sizes(even)) == [112] * 4 + [113] * 4
    assert even.exceptAll(df).isEmpty() and df.exceptAll(even).isEmpty()
    monkeypatch.setattr(frames, "MOST_ROWS", 50)
    # Two and a quarter turns of the eight slots are three, but for the least rows of a task.
    assert len(_partition_sizes(frames.spread_evenly(df, 900))) == 9
    assert frames.spread_evenly(df.limit(0), 0).count() == 0


def test_even_rows_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(frames, "LEAST_ROWS", 100)
    even = spark.range(0, 900, 1, 8)
    assert frames.spread_evenly(even, 900) is even
    halves = even.coalesce(2)
    assert len(_partition_sizes(frames.spread_evenly(halves, 900))) == 8


def _discrete(spark, n=3000, seed=11):
    """Two numbers of few values, a category that may be missing, and a noisy class."""
    rng = np.random.default_rng(seed)
    x, z, k = rng.integers(-20, 20, n) / 4, rng.integers(0, 200, n), rng.integers(0, 5, n)
    y = x + 0.02 * z + 0.5 * (k == 3) + rng.logistic(size=n) > 2.5
    rows = [(i, float(a), int(b), f"c{c}" if c else None, int(d)) for i, (a, b, c, d) in enumerate(zip(x, z, k, y))]
    return spark.createDataFrame(rows, "id long, x double, z int, k string, y int")


DISCRETE = FeatureSpec(("x", "z"), ("k",), target="y")


@pytest.mark.parametrize("early_stopping", [False, True])
def test_trees_over_cells_are_those_of_all_rows(spark, monkeypatch, early_stopping):
    frame = models.model_frame(_discrete(spark), DISCRETE).cache()
    plain = models.fit_trees(frame, DISCRETE, rounds=8, early_stopping=early_stopping)
    monkeypatch.setattr(models, "TREE_SAMPLE", 1000)
    celled = models.fit_trees(frame, DISCRETE, rounds=8, early_stopping=early_stopping)
    assert len(celled.stages) == len(plain.stages) + 2
    assert celled.stages[-1].getNumTrees == plain.stages[-1].getNumTrees
    assert celled.stages[-1].totalNumNodes == plain.stages[-1].totalNumNodes
    # Values between and beyond those of the training, and missing ones.
    odd = spark.createDataFrame(
        [(-9.0, 500, "c1"), (None, 3, "c3"), (1.1, None, "new"), (float("inf"), -7, None)],
        "x double, z int, k string",
    )
    rows = frame.drop("label").unionByName(models.model_frame(odd, DISCRETE)).coalesce(1)
    a, b = ([r["score"] for r in models.positive_score(m.transform(rows)).collect()] for m in (plain, celled))
    assert len(a) == 3004 and np.allclose(a, b, rtol=0, atol=1e-9)
    path = new_folder(spark, "test-celled")
    models.save_model(celled, path)
    again = models.positive_score(models.load_model(path).transform(rows))
    assert [r["score"] for r in again.collect()] == b


def test_trees_fit_one_row_a_cell(spark, monkeypatch):
    monkeypatch.setattr(models, "TREE_SAMPLE", 1000)
    data = _discrete(spark)
    copies = data.unionByName(data.withColumn("id", F.col("id") + 10_000))
    sizes = []

    def counted(df, purpose):
        found = cells(df, purpose)
        sizes.append((found[1], found[0].agg(F.sum(models.CELL_ROWS)).first()[0]))
        return found

    cells = models.counted
    monkeypatch.setattr(models, "counted", counted)
    trained = models.train_and_evaluate(copies, DISCRETE, "id", rounds=2)
    (fitted, n_train), (scored, n_test) = sizes
    assert fitted <= 2990 < n_train == trained.metrics["n_train"] == 4799
    assert scored < n_test == trained.metrics["n_test"] == 1201
    # Every row scored by itself gives the same metrics.
    rows = models.model_frame(copies, DISCRETE, keep=("id",))
    test = split.stratified_holdout(rows, "label", "id").where("is_holdout")
    single = metrics.macro_metrics(trained.model.transform(test), "label", "prediction").first()
    for name in ("accuracy", "f1_macro", "precision_macro", "recall_macro"):
        assert trained.metrics[name] == pytest.approx(single[name])


def test_bins_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = np.round(rng.lognormal(5, 2, 4000), 3)
    rows = [(0.0 if i % 3 == 0 else float(v), 7.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "n0 double, n1 double")
    limits = models.bin_limits(df, ["n0", "n1"])
    assert limits["n1"] == []
    assert limits["n0"][0] == 0.0 and len(limits["n0"]) < models.TREE_BINS
    place = np.searchsorted(limits["n0"], [r[0] for r in rows], side="left")
    counts = np.bincount(place)
    # The heavy value has its bin, all others share the rest evenly.
    assert counts[0] == 1334 and counts[1:].max() <= 2 * 4000 / 254
    for bad in (None, float("inf")):
        assert models.bin_limits(df.union(spark.createDataFrame([(bad, 7.0)], df.schema)), ["n0", "n1"]) is None


def test_missing_numbers_are_refused_at_any_size(spark, monkeypatch):
    gaps = _discrete(spark).withColumn("x", F.when(F.col("id") != 5, F.col("x")))
    frame = models.model_frame(gaps, DISCRETE)
    for limit in (10**6, 1000):
        monkeypatch.setattr(models, "TREE_SAMPLE", limit)
        with pytest.raises(Exception, match="NaN"):
            models.fit_trees(frame, DISCRETE, rounds=1)


def test_holdout_by_cells_is_the_holdout(spark):
    rows = [(i % 700 if i % 11 else None, None if i % 5 == 0 else i % 3) for i in range(4000)]
    rows += [(7, 1)] * 900  # a key that many rows share
    df = spark.createDataFrame(rows, "k int, y int").withColumn("order", columns.hash_order(F.col("k"), 42))

    def chosen(**how):
        held = split.stratified_holdout(df, "y", "k", **how).where("is_holdout")
        return sorted(held.select(F.coalesce("k", F.lit(-1)), F.coalesce("y", F.lit(-1))).collect())

    ranked = chosen()
    assert ranked == chosen(rows_per_range=100) == chosen(rows_per_range=100, hashed_as="order")
    assert "order" not in split.stratified_holdout(df, "y", "k", hashed_as="order").columns
    assert 0 < len(ranked) <= math.ceil(len(rows) * 0.2) + 3


def test_metrics_of_counted_rows(spark):
    counted = spark.createDataFrame([(0.0, 0.0, 5), (0.0, 1.0, 2), (1.0, 1.0, 3), (1.0, 0.0, 4)], "y double, p double, n int")
    single = counted.select("y", "p", F.explode(F.sequence(F.lit(1), "n")))
    assert metrics.macro_metrics(counted, "y", "p", "n").first() == metrics.macro_metrics(single, "y", "p").first()


def test_training_rows_fill_all_slots(spark, monkeypatch):
    monkeypatch.setattr(frames, "LEAST_ROWS", 10)
    fitted = []

    def fit(frame, *more):
        fitted.append(frame)
        return trees(frame, *more)

    trees = models.fit_trees
    monkeypatch.setattr(models, "fit_trees", fit)
    trained = models.train_and_evaluate(labeled(spark).coalesce(1), SPEC, "id", needle=">50K", rounds=1)
    sizes = _partition_sizes(fitted[0])
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert sum(sizes) == trained.metrics["n_train"] and trained.metrics["n_test"] > 0


def test_forward_evaluation_improves_on_drift(spark):
    rng = np.random.default_rng(8)
    n = 900
    t = np.arange(n)
    x = rng.normal(size=(n, 2))
    late = t >= 300
    y = np.where(late, x[:, 1], x[:, 0]) + rng.normal(0, 0.3, n) > 0.8
    df = spark.createDataFrame(
        pd.DataFrame({"Time": t.astype(float), "id": t, "V1": x[:, 0], "V2": x[:, 1], "Class": y.astype(int)})
    )
    spec = FeatureSpec(("V1", "V2"), target="Class", time="Time")
    results = models.forward_evaluation(split.temporal_windows(df, "Time", "id"), spec, max_iter=50)
    assert results.count() == 3
    delta = models.metric_delta(results).first()
    assert delta["delta"] > 0.1 and delta["adapted"] > delta["base"]


def test_retrain_flow_versions_and_promotes(spark):
    root = new_folder(spark, "test-retrain")
    a, b = labeled(spark), labeled(spark, shift=0.2).withColumn("id", F.col("id") + 1000)

    def retrain(dataset="census", **more):
        return run_retrain(a, b, SPEC, "id", root, dataset, needle=">50K", rounds=2, **more)

    first, second = retrain(), retrain(margin=0.5)
    assert (first.version, first.promoted, first.reason) == (1, True, "no_existing_champion")
    assert (second.version, second.promoted) == (2, False)
    other = retrain("other")
    assert other.promoted and other.version == 3
    books = Ledgers(spark, root)
    assert books.read("datasets").count() == 1
    assert {r["dataset_version_id"] for r in books.read("provenance").collect()} == {1}
    stages = {r["version_num"]: r["stage"] for r in books.models().collect()}
    assert stages == {1: "production", 2: "development", 3: "production"}
    assert retrain().promoted  # as good as the champion, which it replaces
    stages = {r["version_num"]: r["stage"] for r in books.models().collect()}
    assert stages == {1: "archived", 2: "development", 3: "production", 4: "production"}
    assert ledger.stage_violations(
        ledger.stage_moves(books.read("stages"), "version_num", "created_at", "id", initial=None)
    ).isEmpty()
    snapshot = books.read("baselines").collect()
    assert len(snapshot) == 1 and snapshot[0]["dataset_version_id"] == 1
    stored = load_baseline(spark, snapshot[0]["artifact_path"])
    assert stored.numeric == SPEC.numeric
    assert {r["baseline_snapshot_id"] for r in books.read("provenance").collect()} == {1}
    experiment = books.read("experiments").where("id = 1").first()
    assert experiment["name"] == "retrain_v1_retrain" and experiment["params"]["test_size"] == "0.2"
    scored = score_with_production(a.drop("income"), SPEC, root, "census", ("no", "yes"), keep=("id",))
    assert scored.count() == 240 and {r["model_version"] for r in scored.select("model_version").collect()} == {4}
    with pytest.raises(LookupError):
        score_with_production(a, SPEC, root, "unknown", ("no", "yes"))
    refs = {"experiment_id": (books.read("experiments"), "id"), "dataset_version_id": (books.read("datasets"), "id")}
    assert ledger.orphans(books.read("provenance"), refs).isEmpty()


def test_unreadable_ledger_is_an_error(spark):
    root = new_folder(spark, "test-broken")
    spark.createDataFrame([("x",)], "id string").write.text(f"{root}/models")
    with pytest.raises(Exception):
        Ledgers(spark, root).read("models").collect()
    assert Ledgers(spark, root).read("datasets").isEmpty()


def test_validated_moves(spark):
    current = spark.createDataFrame([(1, "staging"), (2, "archived")], "model int, stage string")
    asked = [(10, 1, "production"), (11, 1, "archived"), (12, 2, "staging"), (13, 3, "archived"), (14, 4, "staging")]
    requests = spark.createDataFrame(asked, "seq int, model int, stage string")
    found = ledger.validated_moves(requests, current, "model", "seq", "seq").collect()
    assert {(r["model"], r["from_stage"], r["stage"], r["is_legal"], r["allowed"]) for r in found} == {
        (1, "staging", "production", True, "production, archived"),
        (2, "archived", "staging", False, "none"),
        (3, "development", "archived", False, "staging, production"),
        (4, "development", "staging", True, "staging, production"),
    }


def test_registration_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1")], "seq int, content_hash string")
    first = ledger.register_new(batch, "content_hash", "seq", "seq")
    assert {(r["content_hash"], r["seq"], r["id"]) for r in first.collect()} == {("h1", 1, 1), ("h2", 2, 2)}
    more = batch.union(spark.createDataFrame([(9, "h3")], batch.schema))
    again = ledger.register_new(more, "content_hash", "seq", "seq", first).collect()
    assert [(r["content_hash"], r["id"]) for r in again] == [("h3", 3)]
    ids = {r["seq"]: r["id"] for r in ledger.resolve_ids(batch, "content_hash", first).collect()}
    assert ids == {1: 1, 2: 2, 3: 1}


def test_large_registration_spans_ranges(spark):
    batch = spark.range(500).select(
        F.col("id").alias("seq"), F.sha2((F.col("id") % 200).cast("string"), 256).alias("content_hash")
    )
    rows = ledger.register_new(batch, "content_hash", "seq", "seq", rows_per_range=30).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 201))
    assert all(r["id"] == r["seq"] + 1 for r in rows)


def test_promotion_archives_the_previous_production(spark):
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    events = spark.createDataFrame(
        [(1, at[0], 7, "production"), (2, at[1], 8, "staging"), (3, at[2], 8, "production")],
        "event bigint, at timestamp, model int, stage string",
    )
    spans = {r["model"]: r for r in ledger.production_history(events, None, "model", "at", "event").collect()}
    assert not spans[7]["is_current"] and spans[7]["until"] == at[2] and spans[8]["is_current"]


def test_illegal_moves_name_the_allowed_ones(spark):
    events = spark.createDataFrame(
        [(1, 1, "archived"), (2, 1, "staging"), (3, 2, "staging"), (4, 2, "production"), (5, 2, "archived")],
        "event bigint, model int, stage string",
    )
    bad = ledger.stage_violations(ledger.stage_moves(events, "model", "event", "event")).collect()
    assert {(r["event"], r["from_stage"], r["allowed"]) for r in bad} == {
        (1, "development", "staging, production"), (2, "archived", "none"),
    }
    registered = ledger.stage_moves(events, "model", "event", "event", initial=None)
    assert {r["event"] for r in ledger.stage_violations(registered).collect()} == {2}


def test_run_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "policy_triggered boolean")
    row = ledger.run_stats(empty, F.col("policy_triggered")).first()
    assert (row["total_runs"], row["trigger_rate"]) == (0, 0.0)
    three = spark.createDataFrame([(True,), (False,), (False,)], "policy_triggered boolean")
    assert ledger.run_stats(three, F.col("policy_triggered")).first()["trigger_rate"] == 0.3333


def test_overview_without_production(spark):
    ids = spark.range(3)
    runs = ids.withColumn("policy_triggered", F.col("id") == 2)
    row = ledger.overview(
        runs, ids.withColumn("version_num", F.col("id")), ids, ids, ids, spark.range(0)
    ).first()
    assert row["last_run_policy_triggered"] and row["production_model_id"] is None
    assert (row["n_runs"], row["latest_model_version"]) == (3, 2)


@pytest.fixture(scope="module")
def day_files(spark):
    """Three days of events, one file each."""
    folder = new_folder(spark, "test-events")
    rng = np.random.default_rng(9)
    start = datetime.datetime(2024, 3, 1)
    for day in range(3):
        frame = pd.DataFrame(
            {
                "ts": [start + datetime.timedelta(days=day, minutes=5 * i) for i in range(200)],
                "value": rng.normal(3.0 * (day == 2), 1, 200),
                "kind": np.where(rng.random(200) < 0.5, "a", "b"),
            }
        )
        spark.createDataFrame(frame).coalesce(1).write.mode("append").parquet(folder)
    return folder


SCHEMA = "ts timestamp, value double, kind string"


def test_monitor_checks_every_batch_once(spark, day_files):
    table = spark.read.schema(SCHEMA).parquet(day_files)
    reference = table.where("ts < '2024-03-02'")
    baseline = fit_baseline(reference, ("value",), ("kind",))
    target = new_folder(spark, "test-monitor")

    def run():
        stream = file_stream(spark, day_files, SCHEMA, maxFilesPerTrigger="1")
        monitor_stream(stream, reference, baseline, f"{target}/runs", f"{target}/state").awaitTermination()
        return spark.read.parquet(f"{target}/runs")

    runs = run()
    assert sorted(r["n_current_rows"] for r in runs.collect()) == [200, 200, 200]
    assert runs.where("policy_triggered").count() == 1
    assert run().count() == 3


def test_windowed_stream_equals_batch(spark, day_files):
    table = spark.read.schema(SCHEMA).parquet(day_files)
    pair = Pair.of(table, F.col("ts") < "2024-03-02", F.col("ts") >= "2024-03-02")
    edges = fit_baseline(pair.reference, ("value",)).edges["value"]
    batch = windowed_bins(table, "ts", "value", edges, by=["kind"])
    stream = windowed_bins(
        file_stream(spark, day_files, SCHEMA, maxFilesPerTrigger="1"), "ts", "value", edges, by=["kind"]
    )
    target = new_folder(spark, "test-windowed")
    write_counts(stream, f"{target}/counts", f"{target}/state", closed_only=False).awaitTermination()
    streamed = spark.read.parquet(f"{target}/counts")
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()

    reference = {r["bin"]: r["n_ref"] for r in bin_counts(pair, {"value": edges}).collect()}
    whole = windowed_bins(table, "ts", "value", edges)
    psi = {str(r["window_start"])[:10]: r for r in windowed_psi(whole, reference).collect()}
    assert psi["2024-03-01"]["psi"] < 1e-12 and psi["2024-03-03"]["psi_band"] == "high"


def test_closed_windows_are_written_once(spark, day_files):
    stream = windowed_bins(
        file_stream(spark, day_files, SCHEMA, maxFilesPerTrigger="1"), "ts", "value", [-9.0, 0.0, 9.0],
        lateness="1 hour",
    )
    target = new_folder(spark, "test-closed")
    write_counts(stream, f"{target}/counts", f"{target}/state").awaitTermination()
    rows = spark.read.parquet(f"{target}/counts").groupBy("window_start").agg(F.sum("n").alias("n")).collect()
    assert {str(r["window_start"])[:10]: r["n"] for r in rows} == {"2024-03-01": 200, "2024-03-02": 200}


def test_model_ids_and_versions_go_on(spark):
    runs = spark.createDataFrame([(k, f"e{k}") for k in range(1, 4)], "id long, run_key string")
    runs = runs.withColumns({"metrics": F.lit(None), "notes": F.lit("n")})
    promoted = spark.createDataFrame([("e1", True), ("e2", False)], "k string, promoted boolean")
    known = spark.createDataFrame([(40, 3), (41, 7)], "id long, version_num long")
    rows = ledger.model_rows(runs, promoted, "k", F.col("run_key"), known).collect()
    assert sorted((r["id"], r["version_num"], r["stage"]) for r in rows) == [
        (42, 8, "production"), (43, 9, "development"), (44, 10, "development"),
    ]


def test_ledgers_refuse_broken_rows(spark, tmp_path):
    ledgers = Ledgers(spark, str(tmp_path))
    ledgers.append("experiments", id=1, name="a", params={}, metrics={}, scenario="s")
    ledgers.append("models", id=1, dataset="d", version_num=5, experiment_id=1)
    for name, values in (
        ("experiments", {"id": 1}),
        ("models", {"id": 2, "version_num": 5, "experiment_id": 1}),
        ("models", {"id": 2, "version_num": 6, "experiment_id": 9}),
        ("stages", {"id": 1, "version_num": 6, "stage": "staging"}),
        ("provenance", {"id": 1, "experiment_id": 1, "baseline_snapshot_id": 3}),
    ):
        with pytest.raises(LedgerError, match=name):
            ledgers.append(name, **values)
    twice = spark.createDataFrame([(7, "x"), (7, "y")], "id long, name string")
    with pytest.raises(LedgerError, match="id 7: repeated"):
        ledgers.append_batch("experiments", twice)
    assert ledgers.read("experiments").count() == 1 and ledgers.read("models").count() == 1
    ledgers.append_batch("experiments", twice.dropDuplicates(["id"]))
    ledgers.append("provenance", id=1, experiment_id=7, model_version_num=5)
    assert [r["id"] for r in ledgers.read("provenance").collect()] == [1]
    with pytest.raises(ValueError):
        ledger.refusals(twice)


def test_windows_close_once_and_drop_late_rows(spark):
    """Out-of-order rows within the lateness count; later ones don't. A stream started
    again from its checkpoint goes on with the open windows."""
    folder = new_folder(spark, "closing-test")
    schema = "at timestamp_ntz, who string, x double"
    edges, reference = [0.0, 1.0, 2.0], {0: 60, 1: 40}

    def feed(*rows):
        data = [(datetime.datetime(2024, 3, d, h), w, x) for d, h, w, x in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = file_stream(spark, f"{folder}/in", schema)
        psi = closed_window_psi(stream, "at", "x", edges, reference, by=["who"])
        write_counts(psi, f"{folder}/out", f"{folder}/state").awaitTermination()
        out = "window_start timestamp, who string, n bigint, psi double, psi_band string"
        found = spark.read.schema(out).parquet(f"{folder}/out").collect()
        return sorted((r["window_start"].day, r["who"] or "", r["n"], round(r["psi"], 6)) for r in found)

    def psi(a, b):
        shares = [max(x / (a + b), 1e-6) for x in (a, b)]
        return round(sum((s - e) * np.log(s / e) for s, e in zip(shares, (0.6, 0.4))), 6)

    one = feed((1, 1, "a", 0.5), (1, 2, "a", 1.5), (1, 3, None, 0.5), (2, 1, "a", 0.5), (1, 9, "a", 9.0))
    assert one == []
    # Day 1 closes with a row of day 3; it still takes a row that came out of order.
    two = feed((1, 5, "a", 2.0), (3, 0, "a", 0.1))
    assert two == [(1, "", 1, psi(1, 0)), (1, "a", 3, psi(1, 2))]
    # Late for day 1, in time for day 2.
    three = feed((1, 7, "a", 0.5), (2, 7, "a", 1.0), (4, 0, "b", 1.0))
    assert three == [*two, (2, "a", 2, psi(1, 1))]


def test_batch_copies_are_removed(spark, tmp_path):
    from plumbline.sources.shared import session_folder

    rows = spark.range(50).select(F.col("id").cast("double").alias("x"))
    rows.write.parquet(f"{tmp_path}/in")
    target = new_folder(spark, "copies")
    baseline = fit_baseline(rows, ("x",))
    stream = file_stream(spark, f"{tmp_path}/in", rows.schema)
    monitor_stream(stream, rows, baseline, f"{target}/runs", f"{target}/state").awaitTermination()
    assert spark.read.parquet(f"{target}/runs").count() == 1
    names = os.listdir(session_folder(spark).removeprefix("file://"))
    assert not [n for n in names if n.startswith("batch-")]
