"""Evaluation of classifiers: confusion counts, class averages, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.ranges import CELL, ROWS_PER_RANGE, ordered_cells


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(2.0 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def confusion_counts(
    df: DataFrame, label: str, prediction: str, count: str | None = None
) -> DataFrame:
    """label, prediction, n; combined before the shuffle. ``count`` names how many rows a
    row stands for."""
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        (F.sum(col(count)) if count else F.count("*")).alias("n")
    )


def class_metrics(
    df: DataFrame, label: str, prediction: str, count: str | None = None
) -> DataFrame:
    """Precision, recall and F1 per class seen as label or prediction."""
    counts = confusion_counts(df, label, prediction, count)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    roles = F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = (
        counts.select(F.inline(roles))
        .groupBy("label")
        .agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    return per_class.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("actual")),
        }
    ).withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def macro_metrics(
    df: DataFrame, label: str, prediction: str, count: str | None = None
) -> DataFrame:
    """One row: accuracy and unweighted class averages."""
    return class_metrics(df, label, prediction, count).agg(
        _ratio(F.sum("hits"), F.sum("actual")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.sum("actual").alias("n_test"),
    )


def binary_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, groups: list[str] = ()
) -> DataFrame:
    """F1, precision, recall and accuracy at score >= threshold."""
    said = col(score) >= threshold
    is_pos = col(label) == 1
    counts = df.groupBy(*[col(g).alias(g) for g in groups]).agg(
        F.count_if(said & is_pos).alias("tp"),
        F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & is_pos).alias("fn"),
        F.count_if(~said & ~is_pos).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *[col(g) for g in groups],
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def ranking_metrics(
    df: DataFrame,
    label: str,
    score: str,
    groups: list[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """ROC-AUC and average precision per group: roc_auc, pr_auc.

    AUC is the rank sum with ties counted half; average precision is the step sum
    over falling scores. Rows are first counted per distinct score, so tied scores
    cost one row; the scores are cut into cells of bounded size along their order, and what
    a cell needs from the higher ones is one small row per (group, cell). One class only
    gives a NULL AUC.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(
        *[col(g).alias(n) for g, n in zip(groups, names)],
        col(score).cast("double").alias("_s"),
        (col(label) == 1).alias("_pos"),
    ).where(F.col("_s").isNotNull() & F.col("_pos").isNotNull())
    per_score = rows.groupBy(*names, "_s").agg(
        F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg")
    )
    per_score = ordered_cells(per_score, "_s", "_s", rows_per_range, derived=True)
    per_range = per_score.groupBy(*names, CELL).agg(
        F.sum("pos").alias("r_pos"), F.sum("neg").alias("r_neg")
    )
    higher = (
        Window.partitionBy(*names)
        .orderBy(F.desc(CELL))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = per_range.select(
        *[F.col(n).alias(n + "k") for n in names],
        F.col(CELL).alias("_rngk"),
        F.coalesce(F.sum("r_pos").over(higher), F.lit(0)).alias("above_pos"),
        F.coalesce(F.sum("r_neg").over(higher), F.lit(0)).alias("above_neg"),
    )
    same = F.col(CELL) == F.col("_rngk")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(n + "k"))
    falling = Window.partitionBy(*names, CELL).orderBy(F.desc("_s"))
    at_pos = F.col("above_pos") + F.sum("pos").over(falling)
    at_neg = F.col("above_neg") + F.sum("neg").over(falling)
    pos, neg = F.col("pos"), F.col("neg")
    summed = (
        per_score.join(starts, same)
        .withColumns({"at_pos": at_pos, "at_neg": at_neg})
        .groupBy(*names)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            # Negatives meet the positives above them, ties by half.
            F.sum(neg.cast("double") * (F.col("at_pos") - pos + pos / 2)).alias("won"),
            F.sum(pos.cast("double") * F.col("at_pos") / (F.col("at_pos") + F.col("at_neg"))).alias("steps"),
        )
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return summed.select(
        *[F.col(n).alias(g) for g, n in zip(groups, names)],
        (F.col("won") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
        _ratio(F.col("steps"), F.col("n_pos")).alias("pr_auc"),
    )


def evaluation(df: DataFrame, label: str, score: str, groups: list[str], threshold: float = 0.5) -> DataFrame:
    """Ranking and threshold metrics side by side, one row per group."""
    ranked = ranking_metrics(df, label, score, groups)
    return ranked.join(binary_metrics(df, label, score, threshold, groups), list(groups))
