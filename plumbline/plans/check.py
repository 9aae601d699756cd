"""One drift check from samples to ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.drift import FrozenReference
from plumbline.operators.policy import apply_policy
from plumbline.operators.quantiles import fit_baseline
from plumbline.operators.report import drift_report, report_summary
from plumbline.sources.baselines import fit_or_load_baseline
from plumbline.sources.tables import append_rows
from plumbline.spec import Baseline, DriftPolicy, FeatureSpec, Pair

SUMMARY_COUNTS = (
    "n_reference_rows",
    "n_current_rows",
    "n_numeric_features",
    "n_categorical_features",
    "n_features_high_psi",
    "n_numeric_ks_significant",
    "n_categorical_chi2_significant",
)


@dataclass
class CheckResult:
    """What hooks get to see. Labeled frames are None where a side has no labels."""

    scenario: str
    report: DataFrame
    summary: dict
    triggered: bool
    reasons: list[str]
    labeled_reference: DataFrame | None = None
    labeled_current: DataFrame | None = None
    metadata: dict = field(default_factory=dict)


Hook = Callable[[CheckResult], None]


def evaluate_pair(
    pair: Pair,
    baseline: Baseline,
    policy: DriftPolicy = DriftPolicy(),
    frozen: FrozenReference | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Report and its one-row verdict."""
    report = drift_report(pair, baseline, frozen=frozen, **options)
    return report, apply_policy(report_summary(pair, report, frozen), policy)


def run_drift_check(
    spark: SparkSession,
    pair: Pair,
    spec: FeatureSpec,
    scenario: str,
    policy: DriftPolicy = DriftPolicy(),
    baseline: Baseline | None = None,
    baseline_path: str | None = None,
    hooks: Iterable[Hook] = (),
    run_table: str | None = None,
    psi_bins: int = 10,
    **options,
) -> CheckResult:
    """Baseline, report, policy, hooks, run ledger, in that order.

    The report has one row per feature; it is read once and everything after it works
    on those rows. The run is recorded even if a hook fails, and then the failure is
    raised.
    """
    started = spark.sql("SELECT current_timestamp()").first()[0]
    if baseline is None and baseline_path is not None:
        baseline = fit_or_load_baseline(pair.reference, baseline_path, spec, psi_bins)
    elif baseline is None:
        baseline = fit_baseline(pair.reference, spec.numeric, spec.categorical, psi_bins)
    lazy = drift_report(pair, baseline, **options)
    report = spark.createDataFrame(lazy.collect(), lazy.schema)
    verdict = apply_policy(report_summary(pair, report), policy).first()

    target = spec.target
    labeled = target is not None and target in pair.frame.columns
    result = CheckResult(
        scenario=scenario,
        report=report,
        summary={c: verdict[c] for c in (*SUMMARY_COUNTS, "mean_psi")},
        triggered=verdict["policy_triggered"],
        reasons=list(verdict["trigger_reasons"]),
        labeled_reference=pair.reference if labeled else None,
        labeled_current=pair.current if labeled else None,
        metadata={"scenario": scenario},
    )
    try:
        for hook in hooks:
            hook(result)
    finally:
        if run_table is not None:
            append_rows(run_row(spark, result, started), run_table)
    return result


def run_row(spark: SparkSession, result: CheckResult, started) -> DataFrame:
    """The run as a ledger row."""
    row = spark.createDataFrame(
        [
            (
                result.scenario,
                result.triggered,
                result.reasons,
                {c: int(result.summary[c]) for c in SUMMARY_COUNTS},
                started,
            )
        ],
        "scenario string, policy_triggered boolean, trigger_reasons array<string>, "
        "summary map<string,bigint>, started_at timestamp",
    )
    return row.withColumn("finished_at", F.current_timestamp())


def log_hook(write: Callable[[str], None] = print) -> Hook:
    def hook(result: CheckResult) -> None:
        verdict = "; ".join(result.reasons) if result.triggered else "within limits"
        write(f"{result.scenario}: {verdict} {result.summary}")

    return hook


def retrain_hook(retrain: Callable[[DataFrame, DataFrame, str], object]) -> Hook:
    """Retrain on a triggered check; skipped where labels are missing."""

    def hook(result: CheckResult) -> None:
        if not result.triggered:
            return
        if result.labeled_reference is None or result.labeled_current is None:
            return
        retrain(result.labeled_reference, result.labeled_current, result.scenario)

    return hook
