"""Baselines and profiles from sketches that are kept per part of a table and merged.

A part is a day, say: its rows are read once, when the day is over, and leave one small row
per feature in a store. Any run of days is then merged from the store, without a look at the
rows. Counts, means, deviations, smallest and largest values merge exactly. Quantiles and
numbers of distinct values are estimates with stated errors; the most frequent values are
exact as long as a feature has few distinct ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col, to_category, to_numeric
from plumbline.functions.stats import PSI_FLOOR
from plumbline.operators.summary import MAX_CATEGORIES, QUANTILES
from plumbline.spec import Baseline, FeatureSpec

#: Size of a quantile sketch: about 36 kB a feature and part once it is full.
QUANTILE_K = 2048
#: Registers of a distinct count, as a power of two.
DISTINCT_BITS = 14
#: Values a sketch of frequent ones follows. Counts are exact up to three quarters of it.
TRACKED = 4096

_FREQUENT = "struct<sketch:binary, maxItemsTracked:int, itemDataType:string, itemDataTypeDDL:string>"
#: Columns of a store beside the part.
STORE = {
    "feature": "string", "kind": "string", "n_rows": "bigint", "n": "bigint", "low": "double",
    "high": "double", "mean": "double", "squares": "double", "quantiles": "binary",
    "uniques": "binary", "frequent": _FREQUENT,
}


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound on the distance, as a share of the rows, between the rank of an estimated
    quantile and the rank asked for; it holds for 99 of 100 sketches, merged ones too.

    Fixed values: the two constants of the published error curve of this sketch.
    """
    return 2.296 / k**0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Relative error of a distinct count that 99.7 of 100 estimates stay within."""
    return 3 * 1.04 / math.sqrt(2**bits)


def sketch_parts(
    df: DataFrame,
    spec: FeatureSpec,
    part: Column,
    k: int = QUANTILE_K,
    bits: int = DISTINCT_BITS,
    tracked: int = TRACKED,
) -> DataFrame:
    """One row per part and feature: ``part``, the value as text, and the columns of ``STORE``.

    The table is scanned once. Every task sends one row of sketches per part, whatever the
    number of rows, so a part that holds most of the table is no hot key. A NULL part is one
    of its own. What is not a number, and NULL, counts in ``n_rows`` only.
    """

    def one(name: str, kind: str, value: Column, **held: Column) -> Column:
        held |= {"feature": F.lit(name), "kind": F.lit(kind)}
        held |= {"n_rows": F.count("*"), "n": F.count(value)}
        return F.struct(*[held.get(f, F.lit(None)).cast(t).alias(f) for f, t in STORE.items()])

    def number(name: str) -> Column:
        value = to_numeric(col(name))
        return one(
            name,
            "numeric",
            value,
            low=F.min(value),
            high=F.max(value),
            mean=F.avg(value),
            squares=F.var_pop(value) * F.count(value),
            quantiles=F.kll_sketch_agg_double(value, F.lit(k)),
        )

    def category(name: str) -> Column:
        value = to_category(col(name))
        return one(
            name,
            "categorical",
            value,
            uniques=F.hll_sketch_agg(value, F.lit(bits)),
            frequent=F.call_function("approx_top_k_accumulate", value, F.lit(tracked)),
        )

    sketches = [number(n) for n in spec.numeric] + [category(n) for n in spec.categorical]
    names = [f"s{i}" for i in range(len(sketches))]
    return (
        df.groupBy(part.cast("string").alias("part"))
        .agg(*[s.alias(n) for s, n in zip(sketches, names)])
        .select("part", F.explode(F.array(*names)).alias("s"))
        .select("part", "s.*")
    )


def store_parts(sketches: DataFrame, path: str) -> None:
    """Keep the sketches in a folder per part. Parts that are there already are replaced, so
    a day that is counted again counts once; other parts stay as they are."""
    (
        sketches.repartition("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def stored_parts(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Sketches of the parts from ``first`` to ``last``; folders of others are not read."""
    columns = ", ".join(f"{f} {t}" for f, t in (STORE | {"part": "string"}).items())
    parts = spark.read.schema(columns).parquet(path)
    if first is not None:
        parts = parts.where(F.col("part") >= first)
    if last is not None:
        parts = parts.where(F.col("part") <= last)
    return parts


def merged(parts: DataFrame, k: int = QUANTILE_K, tracked: int = TRACKED) -> DataFrame:
    """One row per feature: ``n_parts`` and the columns of ``STORE`` over all given parts.

    There are as many rows as parts times features; tasks merge what they read before the
    shuffle.
    Squares are added around the mean of all parts, so they lose no digits.
    """
    means = parts.groupBy("feature").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))))
        .alias("_mean")
    )
    off = F.col("mean") - F.col("_mean")
    combined = F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(tracked))
    numeric = (F.col("kind") == "numeric") & (F.col("n") > 0)
    everything = parts.join(F.broadcast(means), "feature")
    base = everything.groupBy("feature", "kind").agg(
        F.count("*").alias("n_parts"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * off * off).alias("squares"),
        F.kll_merge_agg_double(F.when(numeric, F.col("quantiles")), F.lit(k)).alias("quantiles"),
    )
    sets = (
        parts.where((F.col("kind") == "categorical") & F.col("uniques").isNotNull())
        .groupBy("feature")
        .agg(F.hll_union_agg("uniques").alias("uniques"), combined.alias("frequent"))
    )
    return base.join(F.broadcast(sets), "feature", "left")


def _quantiles(probs: list[float]) -> Column:
    """Estimates at the given shares; NULL without values, as an empty sketch has none."""
    found = F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, probs)))
    return F.when((F.col("kind") == "numeric") & (F.col("n") > 0), found)


def sketched_quantiles(features: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, share, value) of the numeric features that have values."""
    pairs = F.arrays_zip(F.array(*map(F.lit, probs)).alias("share"), _quantiles(probs).alias("value"))
    return (
        features.where((F.col("kind") == "numeric") & (F.col("n") > 0))
        .select("feature", F.explode(pairs).alias("q"))
        .select("feature", "q.share", "q.value")
    )


def sketched_baseline(
    features: DataFrame, psi_bins: int = 10, metadata: dict[str, str] | None = None
) -> Baseline:
    """Bin edges from merged sketches. The outer edges are exact; an inner one is a value of
    the table whose rank is within ``rank_error`` of the one asked for. The driver sees one
    row per feature."""
    parts = max(psi_bins, 1)
    probs = [i / parts for i in range(parts)] + [1.0]
    rows = features.select("feature", "kind", "low", "high", _quantiles(probs).alias("q")).collect()
    edges = {}
    for row in sorted(rows, key=lambda r: r["feature"]):
        if row["kind"] != "numeric":
            continue
        distinct = sorted({row["low"], *row["q"][1:-1], row["high"]}) if row["q"] else [0.0, 1.0]
        if len(distinct) == 1:
            distinct.append(distinct[0] + PSI_FLOOR)
        edges[row["feature"]] = distinct
    return Baseline(
        edges=edges,
        categorical=tuple(sorted(r["feature"] for r in rows if r["kind"] == "categorical")),
        psi_bins=psi_bins,
        metadata={"source": "sketches"} | (metadata or {}),
    )


def sketched_numeric_profile(features: DataFrame) -> DataFrame:
    """The columns of ``numeric_profile``, with estimated quantiles and all else exact."""
    deviation = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(
        F.sqrt(F.col("squares") / F.nullif(F.col("n") - 1, F.lit(0)))
    )
    found = _quantiles(list(QUANTILES.values()))
    return features.where(F.col("kind") == "numeric").select(
        "feature",
        (F.col("n") == 0).alias("empty"),
        "mean",
        deviation.alias("std"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        *[found[i].alias(name) for i, name in enumerate(QUANTILES)],
    )


def sketched_categorical_profile(
    features: DataFrame, max_categories: int = MAX_CATEGORIES, tracked: int = TRACKED
) -> DataFrame:
    """The columns of ``categorical_profile``: the number of distinct values is within
    ``distinct_error``; counts are exact for features of up to three quarters of ``tracked``
    distinct values, and off by at most 3.5 / ``tracked`` of the rows beyond that. A feature
    none of whose values stands out of that error has one row, with ``value`` NULL."""
    top = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(tracked * 3 // 4))
    held = F.filter(top, lambda t: t["item"].isNotNull())  # NULL is followed as well
    ordered = F.array_sort(
        F.transform(held, lambda t: F.struct((-t["count"]).alias("less"), t["item"].alias("value")))
    )
    return (
        features.where((F.col("kind") == "categorical") & (F.col("n") > 0))
        .select(
            "feature",
            F.hll_sketch_estimate("uniques").alias("n_unique"),
            F.posexplode_outer(F.slice(ordered, 1, max_categories)).alias("position", "found"),
        )
        .select(
            "feature",
            "n_unique",
            "found.value",
            (-F.col("found.less")).alias("n"),
            (F.col("position") + 1).cast("bigint").alias("position"),
        )
    )
