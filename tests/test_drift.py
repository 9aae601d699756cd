"""Drift statistics on small frames, and the rules that are easy to get wrong."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.stats import chi2_pvalue, lattice_tail, interpret_pvalue, ks_method, ks_pvalue, psi_band
from plumbline.operators import drift, report
from plumbline.operators.quantiles import exact_quantiles, fit_baseline, quantile_edges
from plumbline.sources.shared import written
from plumbline.spec import Baseline, Pair


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` double")


def pair_of(spark, ref, cur, kind="double"):
    rows = [(v, True, False) for v in ref] + [(v, False, True) for v in cur]
    return Pair(spark.createDataFrame(rows, f"x {kind}, _in_ref boolean, _in_cur boolean"))


def brute_psi(ref, cur, edges):
    e, a = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    if e.sum() == 0 or a.sum() == 0:
        return 0.0
    e, a = np.clip(e / e.sum(), 1e-6, 1), np.clip(a / a.sum(), 1e-6, 1)
    return float(((a - e) * np.log(a / e)).sum())


def brute_ks(ref, cur):
    at = np.concatenate([ref, cur])
    f = np.searchsorted(np.sort(ref), at, side="right") / len(ref)
    g = np.searchsorted(np.sort(cur), at, side="right") / len(cur)
    return float(np.abs(f - g).max())


def psi_of(spark, expected, actual):
    rows = [("f", i, e, a) for i, (e, a) in enumerate(zip(expected, actual))]
    counts = spark.createDataFrame(rows, "feature string, bin int, n_ref bigint, n_cur bigint")
    return drift.psi_from_counts(counts).first()["psi"]


def test_psi_of_counts(spark):
    assert psi_of(spark, [100, 200, 300, 400], [100, 200, 300, 400]) < 1e-9
    assert psi_of(spark, [1000, 0, 0, 0], [0, 0, 0, 1000]) > 0.1
    assert psi_of(spark, [0, 0], [5, 5]) == 0.0


def test_proportions_are_clipped_not_renormalised(spark):
    expected = (1e-6 - 1.0) * math.log(1e-6) + (1.0 - 1e-6) * math.log(1 / 1e-6)
    assert psi_of(spark, [10, 0], [0, 10]) == pytest.approx(expected, rel=1e-12)


def test_edges_of_normal_sample(spark):
    values = np.random.default_rng(0).normal(size=500)
    edges = quantile_edges(numbers(spark, values.tolist()), ["x"])["x"]
    assert edges == np.unique(np.quantile(values, np.linspace(0, 1, 11))).tolist()


def test_same_series_has_no_psi(spark):
    values = np.linspace(0, 1, 500).tolist()
    pair = pair_of(spark, values, values)
    edges = quantile_edges(pair.reference, ["x"])
    assert drift.numeric_psi(pair, edges).first()["psi"] < 1e-6


def test_edges_of_constant_and_empty(spark):
    assert quantile_edges(numbers(spark, [3.0] * 9), ["x"])["x"] == [3.0, 3.0 + 1e-6]
    assert quantile_edges(numbers(spark, [None, float("nan")]), ["x"])["x"] == [0.0, 1.0]
    assert len(quantile_edges(numbers(spark, [1.0, 2.0, 3.0]), ["x"], n_bins=0)["x"]) == 2


def test_approximate_edges_are_close(spark):
    values = np.random.default_rng(3).normal(size=5000)
    near = quantile_edges(numbers(spark, values.tolist()), ["x"], approximate=True)["x"]
    assert np.allclose(near, np.quantile(values, np.linspace(0, 1, 11)), atol=0.05)


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,)], "`a.b` string")
    assert exact_quantiles(df, ["a.b"], [0.0, 1.0])["a.b"] == [1.0, 2.5]


def test_complete_shift_is_stable_for_psi_and_seen_by_ks(spark):
    pair = pair_of(spark, [float(i) for i in range(20)], [100.0 + i for i in range(20)])
    rows = report.drift_report(pair, fit_baseline(pair.reference, ("x",))).first()
    assert rows["psi"] == 0.0 and rows["psi_band"] == "stable"
    assert rows["ks_statistic"] == 1.0 and rows["ks_interpretation"] == "significant"
    edges = quantile_edges(pair.reference, ["x"])
    assert drift.numeric_psi(pair, edges, open_ended=True).first()["psi"] > 0.25


def test_upper_edge_belongs_to_last_bin(spark):
    pair = pair_of(spark, [0.0, 1.0, 2.0, 2.0], [2.0, 2.5, -1.0])
    rows = drift.bin_counts(pair, {"x": [0.0, 1.0, 2.0]}).collect()
    assert {r["bin"]: (r["n_ref"], r["n_cur"]) for r in rows} == {0: (1, 0), 1: (3, 1)}


def test_few_values_give_no_ks(spark):
    tested = drift.ks_test(drift.numeric_drift(pair_of(spark, [1.0], [5.0, 6.0, 7.0]), ("x",)))
    row = tested.first()
    assert (row["ks_statistic"], row["ks_pvalue"]) == (0.0, 1.0)


def test_minimum_rows_of_experiment_psi(spark):
    few = pair_of(spark, [float(i) for i in range(19)], [float(i) for i in range(40)])
    assert report.experiment_psi(few, ("x",)).first()["psi"] is None
    flat = pair_of(spark, [1.0] * 30, [2.0] * 30)
    assert report.experiment_psi(flat, ("x",)).first()["psi"] == 0.0


def test_overlapping_samples_count_twice(spark):
    df = numbers(spark, [float(i) for i in range(10)])
    pair = Pair.of(df, F.col("x") < 8, F.col("x") >= 2)
    row = report.report_summary(pair, report.drift_report(pair, fit_baseline(pair.reference, ("x",)))).first()
    assert (row["n_reference_rows"], row["n_current_rows"]) == (8, 8)


@pytest.mark.parametrize("rows_per_range", [7, 40, 10_000])
def test_numeric_drift_matches_numpy(spark, rows_per_range):
    rng = np.random.default_rng(5)
    cases = {
        "same": (rng.normal(size=400), rng.normal(size=300)),
        "moved": (rng.normal(size=400), rng.normal(0.5, 1, size=300)),
        "hot": (
            np.where(rng.random(400) < 0.4, 1.0, rng.normal(size=400)),
            np.where(rng.random(300) < 0.5, 1.0, rng.normal(size=300)),
        ),
        "apart": (rng.normal(size=400), rng.normal(50, 1, size=300)),
        "grid": (rng.integers(0, 5, 400).astype(float), rng.integers(1, 6, 300).astype(float)),
    }
    columns = list(cases)
    ref = list(zip(*[cases[c][0].tolist() for c in columns]))
    cur = list(zip(*[cases[c][1].tolist() for c in columns]))
    rows = [(*r, True, False) for r in ref] + [(*r, False, True) for r in cur]
    schema = ", ".join(f"{c} double" for c in columns) + ", _in_ref boolean, _in_cur boolean"
    pair = Pair(spark.createDataFrame(rows, schema).repartition(4))
    edges = quantile_edges(pair.reference, columns, rows_per_range=rows_per_range)
    found = {
        r["feature"]: r
        for r in drift.numeric_drift(pair, tuple(columns), edges, rows_per_range).collect()
    }
    for name, (a, b) in cases.items():
        assert edges[name] == np.unique(np.quantile(a, np.linspace(0, 1, 11))).tolist()
        assert found[name]["ks_statistic"] == pytest.approx(brute_ks(a, b), abs=1e-12), name
        assert found[name]["psi"] == pytest.approx(brute_psi(a, b, edges[name]), abs=1e-12), name
        assert (found[name]["n_ref"], found[name]["n_cur"]) == (400, 300)


def test_oversized_cells_are_cut_again(spark, monkeypatch):
    """Values over many orders of magnitude crowd into the first even cells."""
    from plumbline.operators import quantiles as q

    refined = []
    for module in (q, drift):
        plain = module.inner_grid
        monkeypatch.setattr(
            module, "inner_grid", lambda *a, _f=plain, _m=module.__name__, **k: (refined.append(_m), _f(*a, **k))[1]
        )
    rng = np.random.default_rng(12)
    a, b = np.exp(rng.normal(0, 9, 800)), np.exp(rng.normal(0.3, 9, 700))
    pair = pair_of(spark, a.tolist(), b.tolist())
    probs = np.linspace(0, 1, 11)
    found = exact_quantiles(pair.reference, ["x"], probs.tolist(), rows_per_range=10)["x"]
    assert found == np.quantile(a, probs).tolist()
    row = drift.numeric_drift(pair, ("x",), rows_per_range=10).first()
    assert row["ks_statistic"] == pytest.approx(brute_ks(a, b), abs=1e-12)
    stale = {"x": [0.0, 1e-9, 1e12]}
    row = drift.numeric_drift(pair, ("x",), stale, rows_per_range=10).first()
    assert row["ks_statistic"] == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert row["psi"] == pytest.approx(brute_psi(a, b, stale["x"]), abs=1e-9)
    assert len(refined) > 3 and len(set(refined)) == 2


def test_cells_are_divided_until_they_are_small(spark):
    """Half of the values lie in a span that several passes have to find."""
    rng = np.random.default_rng(3)
    inner = 1e-9 + 1e-15 * rng.random(500)
    values = np.concatenate([rng.normal(0, 1e6, 400), inner, [1.7e308, -1.7e308]])
    df = numbers(spark, values.tolist())
    found = exact_quantiles(df, ["x"], [0.3, 0.5, 0.6], rows_per_range=5)["x"]
    assert found == np.quantile(values, [0.3, 0.5, 0.6]).tolist()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    ref=st.lists(st.floats(-50, 50) | st.sampled_from([0.0, 1.0]), min_size=2, max_size=40),
    cur=st.lists(st.floats(-50, 50) | st.sampled_from([0.0, 1.0]), min_size=2, max_size=40),
)
def test_drift_properties(spark, ref, cur):
    pair = pair_of(spark, ref, cur)
    edges = quantile_edges(pair.reference, ["x"], rows_per_range=5)
    row = drift.numeric_drift(pair, ("x",), edges, rows_per_range=5).first()
    assert row["ks_statistic"] == pytest.approx(brute_ks(np.array(ref), np.array(cur)), abs=1e-12)
    assert row["psi"] == pytest.approx(brute_psi(np.array(ref), np.array(cur), edges["x"]), abs=1e-9)
    assert 0.0 <= row["ks_statistic"] <= 1.0 and row["psi"] >= 0.0


def test_bands_and_strict_alpha(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.2499,), (0.25,), (None,)], "p double")
    assert [r[0] for r in df.select(psi_band(F.col("p"))).collect()] == [
        "stable", "moderate", "moderate", "high", None,
    ]
    df = spark.createDataFrame([(0.05,), (0.0499,)], "p double")
    assert [r[0] for r in df.select(interpret_pvalue(F.col("p"))).collect()] == [
        "no_signal", "significant",
    ]


def brute_equal_tail(n, h):
    """Share of lattice paths from (0, 0) to (n, n) that reach |i - j| >= h."""
    inside = {(0, 0): 1}
    for step in range(2 * n):
        following = {}
        for (i, j), ways in inside.items():
            for a, b in ((i + 1, j), (i, j + 1)):
                if a <= n and b <= n and abs(a - b) < h:
                    following[a, b] = following.get((a, b), 0) + ways
        inside = following
    return 1 - inside.get((n, n), 0) / math.comb(2 * n, n)


def test_ks_pvalue_is_exact_for_equal_sizes(spark):
    cases = [(n, h) for n in (2, 5, 12, 40) for h in range(0, n + 1, max(1, n // 6))]
    df = spark.createDataFrame([(n, h / n) for n, h in cases], "n bigint, d double")
    found = [r[0] for r in df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("n"), "exact")).collect()]
    assert np.allclose(found, [brute_equal_tail(n, h) if h else 1.0 for n, h in cases], atol=1e-12)


def brute_tail(n, m, h):
    """Share of all orders of n and m values whose functions part by h / (n * m) or more."""
    apart = total = 0
    for chosen in itertools.combinations(range(n + m), n):
        chosen, i, gap = set(chosen), 0, 0
        for step in range(n + m):
            i += step in chosen
            gap = max(gap, abs(i * m - (step + 1 - i) * n))
        total += 1
        apart += gap >= h
    return apart / total


def test_exact_ks_for_unequal_sizes(spark):
    cases = [(n, m, h) for n, m in ((2, 3), (3, 7), (6, 4), (5, 8)) for h in range(1, n * m + 1, 3)]
    expected = [brute_tail(n, m, h) for n, m, h in cases]
    assert np.allclose([lattice_tail(h / (n * m), n, m) for n, m, h in cases], expected, atol=1e-13)
    df = spark.createDataFrame([(n, m, h / (n * m)) for n, m, h in cases], "n bigint, m bigint, d double")
    found = df.select(
        ks_pvalue(F.col("d"), F.col("n"), F.col("m"), "exact"), ks_method(F.col("n"), F.col("m"), "exact")
    ).collect()
    assert np.allclose([r[0] for r in found], expected, atol=1e-13)
    assert {r[1] for r in found} == {"exact"}
    # A tiny tail keeps its digits: only two of all orders part the samples wholly.
    assert lattice_tail(1.0, 30, 41) == pytest.approx(2 / math.comb(71, 30), rel=1e-9)
    assert lattice_tail(0.0196, 9_000, 10_500) == pytest.approx(0.0477, abs=3e-3)


def test_ks_pvalue_forms(spark):
    rows = [(12, 12, 7 / 12), (100, 100, 0.19), (200, 300, 0.1233), (400, 390, 0.0968), (10_000, 10_000, 0.01)]
    df = spark.createDataFrame(rows, "n bigint, m bigint, d double")
    found = [r[0] for r in df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("m"), "exact")).collect()]
    assert np.allclose(found[:2], [0.0314, 0.0539], atol=2e-4)
    assert found[4] == pytest.approx(0.699, abs=5e-3)
    # By default one more row never changes the formula.
    plain = df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("m")), ks_method(F.col("n"), F.col("m")))
    assert {r[1] for r in plain.collect()} == {"stephens"}
    assert np.allclose([r[0] for r in plain.collect()[2:4]], [0.0476, 0.0462], atol=2e-4)
    # Exact as well, and near the series at such sizes; beyond the bound the series itself.
    assert np.allclose(found[2:4], [0.0476, 0.0462], atol=5e-3) and found[2] != plain.collect()[2][0]
    large = spark.createDataFrame([(80_000, 120_000, 0.0062)], "n bigint, m bigint, d double").select(
        ks_pvalue(F.col("d"), F.col("n"), F.col("m"), "exact").alias("a"),
        ks_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("b"),
        ks_method(F.col("n"), F.col("m"), "exact").alias("how"),
    ).first()
    assert large["a"] == large["b"] and large["how"] == "stephens"
    with pytest.raises(ValueError):
        ks_method(F.lit(5), F.lit(5), "asymptotic")


def test_sides_of_different_types_are_coerced(spark):
    """A bad value on one side is dropped there, as where each side is read on its own."""
    rows = [(float(i), "a" if i % 2 else "b") for i in range(40)]
    reference = spark.createDataFrame(rows, "x double, k string")
    texts = [(str(v), 1 if k == "a" else None) for v, k in rows[:20]] + [("abc", 2), (None, 2), ("NaN", 2)]
    incoming = spark.createDataFrame(texts, "x string, k int")
    pair = Pair.union(reference, incoming)
    found = report.drift_report(pair, fit_baseline(pair.reference, ("x",), ("k",))).collect()
    assert {r["feature"] for r in found} == {"x", "k"}
    row = drift.numeric_drift(pair, ("x",)).first()
    assert (row["n_ref"], row["n_cur"]) == (40, 20)
    assert dict(pair.frame.dtypes)["x"] == "double" and dict(pair.frame.dtypes)["k"] == "string"


def test_infinite_values_keep_edges_sorted(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [-inf, -inf, 0.0, 1.0, 2.0, inf, inf]], "x double")
    found = exact_quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])["x"]
    assert found == sorted(found) and found[0] == -inf and found[3] == 1.0 and found[-1] == inf
    assert not any(math.isnan(v) for v in found)


def test_chi2_tail(spark):
    def tail(x, k):
        h = x / 2
        total, p = (math.erfc(math.sqrt(h)), 0.5) if k % 2 else (math.exp(-h), 1.0)
        while p < k / 2:
            total += math.exp(p * math.log(h) - h - math.lgamma(p + 1))
            p += 1
        return total

    cases = [(x, k) for x in (0.01, 1.0, 3.84, 7.9, 8.1, 30.0, 400.0) for k in (1, 2, 3, 4, 9, 10, 301)]
    df = spark.createDataFrame(cases, "x double, k int")
    for r in df.withColumn("p", chi2_pvalue(F.col("x"), F.col("k"))).collect():
        assert r["p"] == pytest.approx(min(1.0, tail(r["x"], r["k"])), rel=1e-9, abs=1e-13)


def chi(spark, ref, cur, minimum=5.0):
    pair = pair_of(spark, ref, cur, "string")
    return drift.categorical_drift(pair, ("x",), minimum).first()


def test_equal_categories_are_homogeneous(spark):
    row = chi(spark, ["a", "b"] * 50, ["a", "b"] * 50)
    assert row["chi2_dof"] == 1 and row["chi2_pvalue"] > 0.05 and row["psi"] == 0.0


def test_yates_and_statistic(spark):
    row = chi(spark, ["a"] * 30 + ["b"] * 70, ["a"] * 50 + ["b"] * 50)
    table = np.array([[30, 70], [50, 50]], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert row["chi2_statistic"] == pytest.approx((((abs(table - expected) - 0.5) ** 2) / expected).sum())


def test_rare_and_unseen_are_pooled_by_reference_count(spark):
    pair = pair_of(
        spark, ["a"] * 20 + ["b"] * 4 + [None], ["a"] * 5 + ["c"] * 30 + ["__other__"] * 2 + [None], "string"
    )
    pooled = drift.pool_rare(drift.category_counts(pair, ("x",))).collect()
    assert {r["category"]: (r["n_ref"], r["n_cur"]) for r in pooled} == {
        "a": (20, 5), "__other__": (4, 32),
    }


def test_single_category_and_empty_side(spark):
    one = chi(spark, ["a"] * 9, ["a"] * 9)
    assert (one["chi2_statistic"], one["chi2_pvalue"], one["chi2_dof"]) == (0.0, 1.0, 0)
    empty = chi(spark, ["a"] * 9 + ["b"] * 9, [None, None])
    assert empty["chi2_statistic"] is None and empty["chi2_pvalue"] is None and empty["psi"] == 0.0
    none = chi(spark, [None], [None])
    assert (none["chi2_statistic"], none["chi2_dof"], none["psi"]) == (0.0, 0, 0.0)


def test_report_columns_and_dotted_names(spark):
    df = spark.createDataFrame(
        [(float(i), "p" if i % 3 else "q", i) for i in range(60)],
        "`education.num` double, `marital.status` string, i int",
    )
    pair = Pair.of(df, F.col("i") < 30, F.col("i") >= 30)
    baseline = fit_baseline(pair.reference, ("education.num",), ("marital.status",))
    rows = {r["feature"]: r for r in report.drift_report(pair, baseline).collect()}
    assert set(rows) == {"education.num", "marital.status"}
    assert rows["education.num"]["chi2_statistic"] is None
    assert rows["marital.status"]["ks_statistic"] is None
    assert list(report.REPORT_COLUMNS) == report.drift_report(pair, baseline).columns


def test_missing_feature_is_named(spark):
    with pytest.raises(KeyError, match="nope"):
        fit_baseline(numbers(spark, [1.0]), ("x", "nope"))


@pytest.mark.parametrize("rows_per_range", [15, 10_000])
def test_frozen_reference_gives_the_same_report(spark, rows_per_range):
    rng = np.random.default_rng(6)

    def sample(n, shift):
        rows = zip(rng.normal(shift, 1, n).tolist(), rng.integers(0, 9, n).tolist(), rng.integers(0, 40, n).tolist())
        return spark.createDataFrame([(x, float(g), f"k{k}") for x, g, k in rows], "x double, g double, k string")

    reference = sample(300, 0.0)
    baseline = fit_baseline(reference, ("x", "g"), ("k",))
    frozen = drift.freeze_reference(reference, baseline)
    for shift in (0.0, 0.4, 20.0):
        pair = Pair.union(reference, sample(200, shift))
        plain = report.drift_report(pair, baseline, rows_per_range=rows_per_range)
        quick = report.drift_report(pair, baseline, rows_per_range=rows_per_range, frozen=frozen)
        by_feature = [{r["feature"]: r.asDict() for r in found.collect()} for found in (plain, quick)]
        for name in ("x", "g", "k"):
            assert by_feature[0][name] == pytest.approx(by_feature[1][name], nan_ok=True)
        sums = [report.report_summary(pair, r, f).first().asDict() for r, f in ((plain, None), (quick, frozen))]
        assert sums[0] == pytest.approx(sums[1])
    other = fit_baseline(reference, ("x",), ("k",))
    with pytest.raises(ValueError):
        report.drift_report(pair, other, frozen=frozen)


def test_frozen_reference_is_not_scanned_for_counts(spark):
    reference = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("k"))
    path = written(reference)
    frame = Pair.union(path, reference).frame.where("_in_cur AND NOT _in_ref")
    assert "FileScan" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert path.inputFiles()[0].split("/")[-2] not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_open_cells_read_their_folders_only(spark):
    """Once counted, a reference is not read again, and of its store only what is open."""
    rng = np.random.default_rng(8)
    numbers_of = [(float(x),) for x in rng.normal(0, 1, 3000)]
    reference = written(spark.createDataFrame(numbers_of, "x double"), "frozen-test")
    baseline = fit_baseline(reference, ("x",))
    frozen = drift.freeze_reference(reference, baseline)
    batch = spark.createDataFrame([(float(x),) for x in rng.normal(0.05, 1, 500)], "x double")
    expected = report.drift_report(Pair.union(reference, batch), baseline).first()["ks_statistic"]

    cells = [c.number for c in frozen.cells["x"]]
    wanted = {"x": [cells[10], cells[-3]]}
    plan = frozen.values_in(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = frozen.values_in(wanted)
    assert sum(r["n"] for r in read.collect()) == sum(
        c.n_ref for c in frozen.cells["x"] if c.number in wanted["x"]
    )
    folders = {f.split("/part=")[1].split("/")[0] for f in frozen.values.inputFiles()}
    assert len(folders) > 20

    # The reference itself may be gone.
    gone = Pair.union(spark.createDataFrame([], "x double"), batch)
    found = report.drift_report(gone, baseline, frozen=frozen).first()
    assert found["ks_statistic"] == pytest.approx(expected)
    small = report.drift_report(gone, baseline, frozen=frozen, rows_per_range=2).first()
    assert small["ks_statistic"] == pytest.approx(expected)


def test_every_feature_out_of_range(spark):
    """A later sample beyond all earlier values, over the whole card layout."""
    from plumbline.spec import CARD_FRAUD

    def sample(start):
        steps = [F.sqrt(F.col("id") + start + 3 * k) for k in range(len(CARD_FRAUD.numeric))]
        return spark.range(35).select(*[s.alias(n) for s, n in zip(steps, CARD_FRAUD.numeric)])

    pair = Pair.union(sample(0), sample(400))
    rows = report.drift_report(pair, fit_baseline(pair.reference, CARD_FRAUD.numeric)).collect()
    assert len(rows) == len(CARD_FRAUD.numeric)
    assert all(r["psi"] == 0.0 and r["ks_statistic"] == 1.0 for r in rows)


def test_baseline_may_be_given_by_hand(spark):
    pair = pair_of(spark, [0.5, 1.5], [0.5, 0.6])
    row = report.drift_report(pair, Baseline({"x": [0.0, 1.0, 2.0]})).first()
    assert row["psi"] > 0
