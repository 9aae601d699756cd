"""Order-dependent operators against brute force, with hot keys and tied orders."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger, metrics, split
from plumbline.operators.promotion import replay_promotions, should_promote
from plumbline.operators.ranges import ordered_cells
from plumbline.operators.sequence import number_rows, previous_row, running_max_before

SMALL = {"rows_per_range": 25}


@pytest.fixture(scope="module")
def history():
    """A third of the rows share one key, a third one order value."""
    rng = np.random.default_rng(11)
    n = 600
    frame = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "key": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 9, n).astype(str)),
            "at": np.where(rng.random(n) < 0.35, 50, rng.integers(0, 100, n)),
            "value": rng.integers(0, 200, n).astype(float),
        }
    )
    return frame.sort_values(["at", "id"], ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, history):
    return spark.createDataFrame(history.sample(frac=1, random_state=1)).repartition(5)


@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_numbering(rows, history, ranges):
    found = number_rows(rows, "at", "id", **ranges).toPandas().sort_values("row_no")
    assert found["row_no"].tolist() == list(range(1, 601))
    assert found["id"].tolist() == history["id"].tolist()


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_neighbours(rows, history, following, ranges):
    found = previous_row(
        rows, ["key"], "at", "id", F.col("value"), "near", following=following, **ranges
    ).toPandas()
    expected = history.assign(near=history.groupby("key")["value"].shift(-1 if following else 1))
    merged = found.merge(expected, on="id")
    assert merged["near_x"].fillna(-1).tolist() == merged["near_y"].fillna(-1).tolist()


@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_running_max(rows, history, ranges):
    found = running_max_before(rows, ["key"], "at", "id", F.col("value"), "best", **ranges).toPandas()
    expected = history.assign(best=history.groupby("key")["value"].transform(lambda s: s.cummax().shift()))
    merged = found.merge(expected, on="id")
    assert merged["best_x"].fillna(-1).tolist() == merged["best_y"].fillna(-1).tolist()


def brute_replay(history, margin):
    champions, out = {}, {}
    for r in history.itertuples():
        before = champions.get(r.key)
        promoted, reason = should_promote(r.value, before, margin)
        if promoted:
            champions[r.key] = r.value
        out[r.id] = (before, promoted, reason)
    return out


@pytest.mark.parametrize("margin", [0.0, 7.0, 60.0])
@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_replay(rows, history, margin, ranges):
    found = replay_promotions(rows, "key", "at", "id", "value", margin, **ranges).collect()
    got = {r["id"]: (r["champion_before"], r["promoted"], r["reason"]) for r in found}
    assert got == brute_replay(history, margin)


def test_replay_of_a_slowly_rising_key(spark):
    """One key whose metric rises by less than the margin each time: a single stretch."""
    rows = spark.range(20_000).select(
        F.lit(None).cast("string").alias("key"),
        F.col("id"),
        (F.col("id") * 0.01 + F.when(F.col("id") % 7 == 3, -5.0).otherwise(0.0)).alias("value"),
    )
    df = rows.repartition(6)
    found = replay_promotions(df, "key", "id", "id", "value", 0.25, rows_per_range=2_000)
    assert not any("Python" in x or "Arrow" in x for x in _nodes(found))
    got = {r["id"]: (r["champion_before"], r["promoted"], r["reason"]) for r in found.collect()}
    history = rows.orderBy("id").toPandas().assign(key="all")
    assert got == brute_replay(history, 0.25)
    assert sum(p for _, p, _ in got.values()) > 700


def _nodes(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.strip(" :+-") for line in plan.splitlines()]


def test_replay_of_missing_metrics(spark):
    data = [("a", 1, None), ("a", 2, float("nan")), ("a", 3, -1.0), ("a", 4, 2.0), ("a", 5, 3.0), (None, 6, None)]
    df = spark.createDataFrame(data, "key string, id int, value double")
    for margin in (0.0, 1.5):
        rows = replay_promotions(df, "key", "id", "id", "value", margin).collect()
        got = {r["id"]: r["promoted"] for r in rows}
        assert got == {1: True, 2: margin == 0.0, 3: False, 4: True, 5: margin == 0.0, 6: True}


def test_promotion_rule():
    assert should_promote(0.6, 0.5) == (True, "f1_macro_improved_or_equal")
    assert should_promote(0.5, 0.5)[0] and not should_promote(0.5, 0.5, margin=0.01)[0]
    assert should_promote(None, None) == (True, "no_existing_champion")
    assert should_promote(None, 0.1) == (False, "f1_macro_below_champion")


def test_negative_margin_is_refused(rows):
    with pytest.raises(ValueError):
        replay_promotions(rows, "key", "at", "id", "value", -0.1)


@pytest.mark.parametrize("n_windows", [2, 3, 7])
@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_temporal_windows(rows, history, n_windows, ranges):
    found = split.temporal_windows(rows, "at", "id", n_windows, **ranges).toPandas()
    cuts = [i * 600 // n_windows for i in range(1, n_windows)]
    expected = {
        r.id: f"D{1 + sum(i >= c for c in cuts)}" for i, r in enumerate(history.itertuples())
    }
    assert dict(zip(found["id"], found["window"])) == expected


def test_remainder_goes_to_the_last_windows(spark):
    df = spark.range(11).select(F.col("id").alias("t"), F.col("id"))
    sizes = split.temporal_windows(df, "t", "id").groupBy("window").count().collect()
    assert {r["window"]: r["count"] for r in sizes} == {"D1": 3, "D2": 4, "D3": 4}


def test_windows_over_timestamps(spark):
    start = datetime.datetime(2024, 1, 1)
    data = [(start + datetime.timedelta(microseconds=i * 300_001), i) for i in range(90)]
    df = spark.createDataFrame(data, "t timestamp_ntz, id bigint")
    for kind in ("timestamp_ntz", "timestamp"):
        cast = df.withColumn("t", F.col("t").cast(kind))
        found = split.temporal_windows(cast, "t", "id", rows_per_range=8).collect()
        assert {r["id"]: r["window"] for r in found} == {i: f"D{1 + i // 30}" for i in range(90)}


@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_stratified_holdout(rows, history, ranges):
    found = split.stratified_holdout(rows, "key", "id", 0.2, **ranges).toPandas()
    for key, group in found.groupby("key"):
        assert group["is_holdout"].sum() == math.ceil(round(0.2 * len(group), 9))


def test_split_ignores_partitioning(spark):
    df = spark.range(2000)
    first = split.hash_split(df, "id").where("side = 'cur'")
    second = split.hash_split(df.repartition(7), "id").where("side = 'cur'")
    assert first.exceptAll(second).isEmpty() and 500 < first.count() < 700
    assert split.hash_split(df, "id", seed=1).where("side = 'cur'").exceptAll(first).count() > 0


ORDERS = {
    # Microseconds run against the id.
    "timestamp_ntz": lambda i: datetime.datetime(2024, 3, 9, 23) + datetime.timedelta(microseconds=(599 - i) * 900),
    "timestamp": lambda i: datetime.datetime(2024, 3, 9, 23) + datetime.timedelta(seconds=(599 - i) * 40),
    "string": lambda i: f"model-{(599 - i) // 3:06d}",
    "tied": lambda i: i // 400,
    "nulls": lambda i: None if i % 5 == 0 else 599 - i,
}


@pytest.fixture(scope="module", params=ORDERS)
def ordered(spark, request):
    """Rows in shuffled order, and their ids along (at, id) with NULLs first."""
    kind = {"tied": "int", "nulls": "int"}.get(request.param, request.param)
    at = [ORDERS[request.param](i) for i in range(600)]
    ids = np.random.default_rng(3).permutation(600).tolist()
    plain = "timestamp_ntz" if kind == "timestamp" else kind
    df = spark.createDataFrame(list(zip(at, ids)), f"at {plain}, id bigint").repartition(5)
    rows = sorted(zip(at, ids), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    return df.withColumn("at", F.col("at").cast(kind)), [i for _, i in rows]


def test_numbering_by_any_order(ordered):
    df, expected = ordered
    found = number_rows(df, "at", "id", rows_per_range=50).collect()
    assert {r["id"]: r["row_no"] for r in found} == {x: k + 1 for k, x in enumerate(expected)}


def test_neighbours_by_any_order(ordered):
    df, expected = ordered
    keyed = df.withColumn("key", F.lit(None).cast("string"))
    found = previous_row(keyed, ["key"], "at", "id", F.col("id"), "near", rows_per_range=50).collect()
    assert {r["id"]: r["near"] for r in found} == dict(zip(expected, [None, *expected]))


def test_windows_by_any_order(ordered):
    df, expected = ordered
    found = split.temporal_windows(df, "at", "id", rows_per_range=50).collect()
    assert {r["id"]: r["window"] for r in found} == {x: f"D{1 + k // 200}" for k, x in enumerate(expected)}


def test_windows_over_a_clock_change(spark):
    """An hour that occurs twice, in a session zone that has one."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # From before to after 2024-11-03 06:00 UTC, ten seconds apart.
        micros = F.lit(1_730_610_000_000_000) + F.col("id") * 10_000_000
        df = spark.range(1200).withColumn("at", F.timestamp_micros(micros))
        found = split.temporal_windows(df, "at", "id", rows_per_range=100).groupBy("window").count()
        assert {r["window"]: r["count"] for r in found.collect()} == {"D1": 400, "D2": 400, "D3": 400}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cells_are_bounded_inside_one_value(spark):
    df = spark.range(5000).select(F.lit(None).cast("string").alias("at"), F.format_string("run-%06d", "id").alias("id"))
    sizes = ordered_cells(df, "at", "id", 100).groupBy("_cell").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] >= 40 and sizes[1] <= 400


def test_null_and_empty_labels_are_two_classes(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") % 2 == 0, ""))
    found = split.stratified_holdout(df, "label", "id", 0.1).where("is_holdout")
    assert {r["label"]: r["count"] for r in found.groupBy("label").count().collect()} == {None: 5, "": 5}


def test_rising_history_is_walked_in_stretches(spark):
    df = spark.range(300).select(
        F.lit("hot").alias("key"), F.col("id").alias("at"), "id", (F.col("id") * 1.0 + F.floor(F.col("id") / 10) * 5).alias("value")
    )
    found = replay_promotions(df, "key", "at", "id", "value", 4.0, rows_per_range=40).collect()
    history = pd.DataFrame([(r["id"], r["key"], r["value"]) for r in sorted(found, key=lambda r: r["id"])], columns=["id", "key", "value"])
    got = {r["id"]: (r["champion_before"], r["promoted"], r["reason"]) for r in found}
    assert got == brute_replay(history, 4.0)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gap = pos[:, None] - neg[None, :]
    return float(((gap > 0) + 0.5 * (gap == 0)).mean())


def brute_ap(y, s):
    total, out, seen_pos, seen = y.sum(), 0.0, 0, 0
    for value in sorted(set(s), reverse=True):
        at = y[s == value]
        seen_pos, seen = seen_pos + at.sum(), seen + len(at)
        out += at.sum() / total * seen_pos / seen
    return float(out)


@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_ranking_metrics(spark, ranges):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    s = np.where(rng.random(500) < 0.3, 0.5, np.round(rng.random(500) + 0.2 * y, 2))
    g = np.where(rng.random(500) < 0.6, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s, "g": g})).repartition(3)
    for r in metrics.ranking_metrics(df, "y", "s", ["g"], **ranges).collect():
        m = g == r["g"]
        assert r["roc_auc"] == pytest.approx(brute_auc(y[m], s[m]), abs=1e-12)
        assert r["pr_auc"] == pytest.approx(brute_ap(y[m], s[m]), abs=1e-12)
    whole = metrics.ranking_metrics(df, "y", "s", **ranges).first()
    assert whole["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    row = metrics.ranking_metrics(df, "y", "s").first()
    assert row["roc_auc"] is None and row["pr_auc"] == 1.0


def test_macro_metrics_count_unseen_classes_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "y int, p int")
    row = metrics.macro_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.5
    assert row["precision_macro"] == pytest.approx((0.5 + 1.0 + 0.0) / 3)
    assert row["recall_macro"] == pytest.approx((0.5 + 0.5 + 0.0) / 3)
    assert row["f1_macro"] == pytest.approx((0.5 + 2 / 3 + 0.0) / 3)


def test_binary_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    row = metrics.binary_metrics(df, "y", "s").first()
    assert (row["f1"], row["precision"], row["recall"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_stage_moves(spark, rows, history, ranges):
    stages = [ledger.DEVELOPMENT, ledger.STAGING, ledger.PRODUCTION, ledger.ARCHIVED]
    pick = F.element_at(F.array(*[F.lit(s) for s in stages]), (F.col("value") % 4 + 1).cast("int"))
    moves = ledger.stage_moves(rows.withColumn("stage", pick), "key", "at", "id", **ranges).collect()
    expected, last = {}, {}
    for r in history.itertuples():
        now = stages[int(r.value % 4)]
        before = last.get(r.key, ledger.DEVELOPMENT)
        expected[r.id] = now in ledger.TRANSITIONS[before]
        last[r.key] = now
    assert {m["id"]: m["is_legal"] for m in moves} == expected


@pytest.mark.parametrize("ranges", [SMALL, {}])
def test_production_history(rows, history, ranges):
    events = rows.withColumns(
        {"stage": F.lit(ledger.PRODUCTION), "model": (F.col("value") % 3).cast("int")}
    )
    spans = ledger.production_history(events, "key", "model", "at", "id", **ranges).collect()
    expected = {}
    for r in history.itertuples():
        told = expected.setdefault(r.key, [])
        if not told or told[-1] != int(r.value % 3):
            told.append(int(r.value % 3))
    assert len(spans) == sum(len(v) for v in expected.values())
    assert {s["dataset"] if "dataset" in s else s["key"]: s["model"] for s in spans if s["is_current"]} == {
        k: v[-1] for k, v in expected.items()
    }
