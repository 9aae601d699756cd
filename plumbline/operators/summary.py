"""Column profiles: a compact snapshot of a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, to_category
from plumbline.operators.frames import feature_frame, melt, small_frame
from plumbline.operators.quantiles import quantiles_and_moments

QUANTILES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
MAX_CATEGORIES = 15


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns profiled as numbers; booleans count as numbers."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, range and quantiles per column.

    ``feature, empty, mean, std, min, max, q05, q50, q95``; a column without values
    is flagged empty, one value has deviation 0.
    """
    quantiles, known = quantiles_and_moments(
        df, columns, list(QUANTILES.values()), {"mean": F.avg, "std": F.stddev_samp}
    )
    rows = []
    for name, found in known.items():
        deviation = 0.0 if found["count"] == 1 else found["std"]
        cuts = quantiles[name] or [None] * len(QUANTILES)
        rows.append(
            (name, found["count"] == 0, found["mean"], deviation, found["min"], found["max"], *cuts)
        )
    numbers = ("mean", "std", "min", "max", *QUANTILES)
    return small_frame(
        df.sparkSession,
        rows,
        pa.schema(
            [("feature", pa.string()), ("empty", pa.bool_()), *((n, pa.float64()) for n in numbers)]
        ),
    )


def categorical_profile(
    df: DataFrame,
    columns: list[str],
    max_categories: int = MAX_CATEGORIES,
    approximate: bool = False,
) -> DataFrame:
    """Most frequent values per column, with the number of distinct values:
    ``feature, n_unique, value, n, position``. Ties are broken by value.

    Keeping the first positions of a ranked window lets Spark cut every task's input
    to ``max_categories`` rows before the shuffle, however many categories there are.
    """
    long = melt(df, {n: {"value": to_category(col(n))} for n in columns}).where(
        F.col("value").isNotNull()
    )
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    distinct = (
        long.groupBy("feature").agg(F.approx_count_distinct("value").alias("n_unique"))
        if approximate
        else counts.groupBy("feature").agg(F.count("*").alias("n_unique"))
    )
    ranked = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    top = (
        counts.withColumn("position", F.row_number().over(ranked).cast("bigint"))
        .where(F.col("position") <= max_categories)
    )
    return top.join(distinct, "feature").select("feature", "n_unique", "value", "n", "position")


def table_snapshot(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """One row per column as JSON, with the row count of the table:
    ``feature, kind, n_rows, profile``."""
    numeric = numeric_columns(df)
    other = [c for c in df.columns if c not in numeric]
    n_rows = df.count()
    parts = []
    if numeric:
        profile = numeric_profile(df, numeric)
        values = F.struct("mean", "std", "min", "max", *QUANTILES)
        parts.append(
            profile.select(
                "feature",
                F.lit("numeric").alias("kind"),
                F.when(F.col("empty"), F.to_json(F.struct(F.col("empty"))))
                .otherwise(F.to_json(values))
                .alias("profile"),
            )
        )
    if other:
        profile = categorical_profile(df, other, max_categories)
        ordered = F.array_sort(F.collect_list(F.struct("position", "value", "n")))
        merged = profile.groupBy("feature").agg(
            F.first("n_unique").alias("n_unique"), ordered.alias("top")
        )
        top = F.map_from_entries(F.transform("top", lambda t: F.struct(t["value"], t["n"])))
        filled = feature_frame(df.sparkSession, other).join(merged, "feature", "left")
        parts.append(
            filled.select(
                "feature",
                F.lit("categorical").alias("kind"),
                F.to_json(
                    F.struct(
                        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
                        top.alias("top_values"),
                    )
                ).alias("profile"),
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select("feature", "kind", F.lit(n_rows).cast("bigint").alias("n_rows"), "profile")
