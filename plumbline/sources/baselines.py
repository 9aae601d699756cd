"""Frozen baselines as tables, one row per feature."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.frames import small_frame
from plumbline.operators.quantiles import fit_baseline
from plumbline.sources.shared import is_missing
from plumbline.spec import Baseline, FeatureSpec

_SCHEMA = pa.schema(
    [
        ("position", pa.int32()),
        ("feature", pa.string()),
        ("kind", pa.string()),
        ("edges", pa.list_(pa.float64())),
        ("psi_bins", pa.int32()),
        ("metadata", pa.map_(pa.string(), pa.string())),
    ]
)


def baseline_frame(spark: SparkSession, baseline: Baseline) -> DataFrame:
    meta = list(baseline.metadata.items())
    rows = [(n, "numeric", list(e)) for n, e in baseline.edges.items()]
    rows += [(n, "categorical", []) for n in baseline.categorical]
    return small_frame(
        spark,
        [(i, *row, baseline.psi_bins, meta) for i, row in enumerate(rows)],
        _SCHEMA,
    )


def baseline_from_frame(df: DataFrame) -> Baseline:
    """Back from rows; as many as there are features."""
    rows = df.orderBy("position").collect()
    return Baseline(
        edges={r["feature"]: list(r["edges"]) for r in rows if r["kind"] == "numeric"},
        categorical=tuple(r["feature"] for r in rows if r["kind"] == "categorical"),
        psi_bins=rows[0]["psi_bins"] if rows else 10,
        metadata=dict(rows[0]["metadata"] or {}) if rows else {},
    )


def save_baseline(spark: SparkSession, baseline: Baseline, path: str, fmt: str = "parquet") -> None:
    baseline_frame(spark, baseline).coalesce(1).write.mode("overwrite").format(fmt).save(path)


def load_baseline(spark: SparkSession, path: str, fmt: str = "parquet") -> Baseline:
    schema = (
        "position int, feature string, kind string, edges array<double>, "
        "psi_bins int, metadata map<string,string>"
    )
    return baseline_from_frame(spark.read.schema(schema).format(fmt).load(path))


def fit_or_load_baseline(
    reference: DataFrame, path: str, spec: FeatureSpec, psi_bins: int = 10, source: str = "check"
) -> Baseline:
    """The stored baseline if its features and bin count match, else a new one.

    The reference sample is not compared: a baseline stays frozen until the
    features or the number of bins change.
    """
    spark = reference.sparkSession
    metadata = {"source": source}
    stored = None
    try:
        stored = load_baseline(spark, path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
    if stored is not None:
        same = (stored.numeric, stored.categorical, stored.psi_bins) == (
            spec.numeric,
            spec.categorical,
            psi_bins,
        )
        if same:
            return stored
        metadata["rebuilt"] = "true"
    fresh = fit_baseline(reference, spec.numeric, spec.categorical, psi_bins, metadata)
    save_baseline(spark, fresh, path)
    return fresh
