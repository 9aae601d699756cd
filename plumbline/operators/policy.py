"""Threshold policy over report summaries, and alert rows for triggered checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.spec import DriftPolicy

# Wording of the reasons and the name of the event.
REASON_PSI = "high_psi count"
REASON_KS = "KS significant"
REASON_CHI2 = "chi2 significant"
ALERT_EVENT = "drift_policy_triggered"


def apply_policy(summaries: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """Add ``trigger_reasons`` and ``policy_triggered`` to any number of summaries.

    A count a summary lacks reads as zero. Limits are strict.
    """

    def reason(column: str, words: str, limit: int) -> Column:
        n = F.coalesce(F.col(column), F.lit(0)) if column in summaries.columns else F.lit(0)
        text = F.concat(F.lit(words + " "), n.cast("string"), F.lit(f" > {limit}"))
        return F.when(n > limit, text)

    reasons = F.array_compact(
        F.array(
            reason("n_features_high_psi", REASON_PSI, policy.max_high_psi),
            reason("n_numeric_ks_significant", REASON_KS, policy.max_ks),
            reason("n_categorical_chi2_significant", REASON_CHI2, policy.max_chi2),
        )
    )
    return summaries.withColumn("trigger_reasons", reasons).withColumn(
        "policy_triggered", F.size("trigger_reasons") > 0
    )


def alert_payloads(
    checks: DataFrame, scenario: str, summary: Iterable[str], metadata: Iterable[str] = ()
) -> DataFrame:
    """One alert row per triggered check; ``payload`` is the JSON to hand on."""
    meta = [F.col(c) for c in dict.fromkeys([scenario, *metadata])]
    payload = F.struct(
        F.lit(ALERT_EVENT).alias("event"),
        F.current_timestamp().alias("sent_at"),
        F.col(scenario).cast("string").alias("scenario"),
        F.col("trigger_reasons"),
        F.struct(*[F.col(c) for c in summary]).alias("summary"),
        F.struct(*meta).alias("metadata"),
    )
    return (
        checks.where("policy_triggered")
        .withColumn("alert", payload)
        .select(
            F.col("alert.event"),
            F.col("alert.sent_at"),
            F.col("alert.scenario"),
            F.array_join("alert.trigger_reasons", "; ").alias("reasons"),
            F.to_json("alert.summary").alias("summary"),
            F.to_json("alert").alias("payload"),
        )
    )
