"""Training pools and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.sources.shared import written


def merge_training_data(
    reference: DataFrame, current: DataFrame, target: str, drop_duplicates: bool = True
) -> DataFrame:
    """Reference and current rows together; a column one side lacks is NULL there.

    Exact duplicate rows (NULLs equal) are dropped, also those within one side.
    """
    for frame in (reference, current):
        if target not in frame.columns:
            raise ValueError(f"No target column {target!r} in a labeled frame")
    merged = reference.unionByName(current, allowMissingColumns=True)
    return merged.dropDuplicates() if drop_duplicates else merged


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight n / (k * n_class) on every row, so all classes weigh the same.

    Class sizes are an aggregate, stored so that the planner knows how small they are: a
    few classes reach every task, many are joined with skewed classes split. NULL labels
    form a class.
    """
    sizes = written(
        df.groupBy(col(label).alias("_label")).agg(F.count("*").alias("_n")), "classes"
    )
    whole = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    each = F.lit((whole["n"] or 0) / max(whole["k"], 1))
    weights = sizes.select("_label", (each / F.col("_n")).alias(name))
    return df.join(weights, col(label).eqNullSafe(F.col("_label"))).drop("_label")
