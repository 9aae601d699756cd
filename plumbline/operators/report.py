"""Drift report, its summary and the rankings made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import BAND_HIGH, SIGNIFICANT, interpret_pvalue, psi_band
from plumbline.operators.drift import (
    MIN_EXPECTED,
    FrozenReference,
    categorical_drift,
    ks_test,
    numeric_drift,
    numeric_psi,
)
from plumbline.operators.frames import one_row
from plumbline.operators.quantiles import quantile_edges
from plumbline.operators.ranges import ROWS_PER_RANGE
from plumbline.spec import Baseline, Pair

# Columns of a report.
REPORT_COLUMNS = {
    "feature": "string",
    "kind": "string",
    "psi": "double",
    "psi_band": "string",
    "ks_statistic": "double",
    "ks_pvalue": "double",
    "ks_interpretation": "string",
    "chi2_statistic": "double",
    "chi2_pvalue": "double",
    "chi2_dof": "int",
    "chi2_interpretation": "string",
}


def _as_report(rows: DataFrame) -> DataFrame:
    """Fixed columns; metrics of the other kind are NULL."""
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
            for c, t in REPORT_COLUMNS.items()
        ]
    )


def drift_report(
    pair: Pair,
    baseline: Baseline,
    ks_alpha: float = 0.05,
    chi2_alpha: float = 0.05,
    min_expected: float = MIN_EXPECTED,
    rows_per_range: int = ROWS_PER_RANGE,
    frozen: FrozenReference | None = None,
) -> DataFrame:
    """One row per feature of the baseline."""
    if frozen is not None and frozen.baseline != baseline:
        raise ValueError("The frozen reference belongs to another baseline")
    kinds = []
    if baseline.numeric:
        numeric = ks_test(
            numeric_drift(pair, baseline.numeric, baseline.edges, rows_per_range, frozen)
        )
        kinds.append(
            numeric.withColumns(
                {
                    "kind": F.lit("numeric"),
                    "ks_interpretation": interpret_pvalue(F.col("ks_pvalue"), ks_alpha),
                }
            )
        )
    if baseline.categorical:
        kinds.append(
            categorical_drift(pair, baseline.categorical, min_expected, frozen).withColumns(
                {
                    "kind": F.lit("categorical"),
                    "chi2_interpretation": interpret_pvalue(F.col("chi2_pvalue"), chi2_alpha),
                }
            )
        )
    if not kinds:
        raise ValueError("The baseline names no feature")
    rows = [_as_report(k.withColumn("psi_band", psi_band(F.col("psi")))) for k in kinds]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def report_summary(
    pair: Pair, report: DataFrame, frozen: FrozenReference | None = None
) -> DataFrame:
    """One row of counts over the samples and the report."""
    if frozen is None:
        sizes = pair.frame.agg(
            F.count_if(Pair.IN_REF).alias("n_reference_rows"),
            F.count_if(Pair.IN_CUR).alias("n_current_rows"),
        )
    else:
        sizes = (
            pair.frame.where(Pair.IN_CUR)
            .agg(F.count("*").alias("n_current_rows"))
            .withColumn("n_reference_rows", F.lit(frozen.n_rows).cast("bigint"))
        )

    def significant(column: str):
        return F.count_if(F.col(column) == SIGNIFICANT)

    counts = report.agg(
        F.count_if(F.col("kind") == "numeric").alias("n_numeric_features"),
        F.count_if(F.col("kind") == "categorical").alias("n_categorical_features"),
        F.count_if(F.col("psi_band") == BAND_HIGH).alias("n_features_high_psi"),
        significant("ks_interpretation").alias("n_numeric_ks_significant"),
        significant("chi2_interpretation").alias("n_categorical_chi2_significant"),
        F.avg("psi").alias("mean_psi"),
    )
    return one_row(sizes, counts)


def drift_ranking(
    pair: Pair,
    features: tuple[str, ...],
    n_bins: int = 10,
    min_rows: int = 20,
    alpha: float = 0.05,
) -> DataFrame:
    """Numeric features by falling PSI, with KS; bins come from the pair itself.

    ``feature, psi, ks_statistic, ks_pvalue, ks_significant, psi_rank``. PSI is NULL
    where a sample has fewer than ``min_rows`` values and 0.0 for a constant feature.
    """
    edges = quantile_edges(pair.reference, list(features), n_bins, widen_constant=False)
    rows = ks_test(numeric_drift(pair, features, edges))
    psi = F.when(F.least("n_ref", "n_cur") >= min_rows, F.col("psi"))
    # One row per feature: the window is as small as the feature list.
    by_psi = Window.orderBy(F.desc_nulls_last("psi"), "feature")
    return rows.select(
        "feature",
        psi.alias("psi"),
        "ks_statistic",
        "ks_pvalue",
        (F.col("ks_pvalue") < alpha).alias("ks_significant"),
    ).withColumn("psi_rank", F.row_number().over(by_psi).cast("bigint"))


def ranking_summary(ranking: DataFrame, high_psi: float = 0.2) -> DataFrame:
    return ranking.agg(
        F.count_if(F.col("psi") > high_psi).alias("n_features_high_psi"),
        F.count_if("ks_significant").alias("n_features_ks_significant"),
        F.avg("psi").alias("mean_psi"),
    )


def experiment_psi(
    pair: Pair, features: tuple[str, ...], n_bins: int = 10, min_rows: int = 20
) -> DataFrame:
    """PSI alone, over bins fitted on the pair's own reference."""
    edges = quantile_edges(pair.reference, list(features), n_bins, widen_constant=False)
    return numeric_psi(pair, edges, min_rows=min_rows)


def window_profile(df: DataFrame, window: str, target: str, time: str) -> DataFrame:
    """Rows, positives, positive rate and time span of each window."""
    label = F.col("`" + target + "`").cast("int")
    when = F.col("`" + time + "`")
    return df.groupBy(F.col("`" + window + "`").alias("window")).agg(
        F.count("*").alias("n_rows"),
        F.sum(label).cast("bigint").alias("n_positive"),
        F.avg(label).alias("positive_rate"),
        F.min(when).alias("time_min"),
        F.max(when).alias("time_max"),
    )
