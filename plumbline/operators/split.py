"""How reference and current samples, and train and holdout rows, are chosen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, hash_bucket, hash_order
from plumbline.operators.ranges import ROWS_PER_RANGE
from plumbline.operators.sequence import before, exact_text, exact_value, rows_at_ranks
from plumbline.sources.shared import written
from plumbline.spec import Pair

HASH_BUCKETS = 10_000
# Leading bits by which ordered hashes are counted, and those that follow.
CELL_BITS = 16
REST_BITS = 52 - CELL_BITS
# Classes up to which their cuts go to every task.
BROADCAST_CUTS = 10_000


def in_holdout(key: str, fraction: float, seed: int) -> Column:
    """Fixed pseudo-random choice by key: about ``fraction`` of the keys."""
    return hash_bucket(col(key), seed, HASH_BUCKETS) < round(fraction * HASH_BUCKETS)


def hash_split(df: DataFrame, key: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``side``: 'cur' for the held-out fraction, 'ref' for the rest. A row keeps
    its side whatever the partitioning, so the split can be computed again."""
    return df.withColumn(
        "side", F.when(in_holdout(key, fraction, seed), "cur").otherwise("ref")
    )


def random_pair(df: DataFrame, key: str, fraction: float = 0.3, seed: int = 42) -> Pair:
    held = in_holdout(key, fraction, seed)
    return Pair.of(df, ~held, held)


def shifted_pair(
    df: DataFrame, key: str, current: Column, fraction: float = 0.3, seed: int = 42
) -> Pair:
    """Reference as in the random split; current is a slice of the whole table, so
    the two overlap."""
    return Pair.of(df, ~in_holdout(key, fraction, seed), current)


def incoming_pair(
    df: DataFrame, incoming: DataFrame, key: str, fraction: float = 0.3, seed: int = 42
) -> Pair:
    """Reference as in the random split; current is an external batch."""
    return Pair.union(df.where(~in_holdout(key, fraction, seed)), incoming)


def labeled_sides(pair: Pair, target: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Labeled frames of a pair; a frame without the target column is None."""
    return tuple(
        f if target in f.columns else None for f in (pair.reference, pair.current)
    )


def rows_of_split(full: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Full rows of the keys in a split."""
    return full.join(split.select(col(key)), key, "left_semi")


def stratified_holdout(
    df: DataFrame,
    label: str,
    key: str,
    fraction: float = 0.2,
    seed: int = 42,
    hashed_as: str | None = None,
    **ranges,
) -> DataFrame:
    """Add ``is_holdout``: of each class the same share, rounded up.

    The holdout of a class is the rows with the smallest hashes, found by selecting
    the cut hash; no class is sorted, however many rows it holds. NULL labels form a
    class. One class only is the unstratified case. ``hashed_as`` names a column, left out
    of the result, that holds ``hash_order`` of key and seed already.
    """
    hashed = df.withColumn("_hash", col(hashed_as) if hashed_as else hash_order(col(key), seed))
    hashed = hashed.drop(hashed_as) if hashed_as else hashed

    def rank(total: Column) -> Column:
        return F.ceil(F.round(total * fraction, 9))

    # One row per class that has rows beyond its holdout.
    if hashed.count() <= ranges.get("rows_per_range", ROWS_PER_RANGE):
        cuts = rows_at_ranks(hashed, "_hash", key, lambda n: F.array(rank(n)), group=label, **ranges)
        cuts = cuts.withColumn("class", F.col("group"))
    else:
        cuts = _cuts_in_cells(hashed, label, key, rank, **ranges)
    cuts = written(cuts.select("class", "order", "tie"), "cuts")
    few = cuts.count() <= BROADCAST_CUTS
    cuts = cuts.select(
        F.col("class").alias("_class"), F.col("order").alias("_cut"), F.col("tie").alias("_cut_tie")
    )
    chosen = before(F.col("_hash"), col(key), F.col("_cut"), F.col("_cut_tie"))
    return (
        hashed.withColumn("_own", F.struct(col(label).alias("v")))
        .join(F.broadcast(cuts) if few else cuts, F.col("_own") == F.col("_class"), "left")
        .withColumn("is_holdout", F.col("_class").isNull() | chosen)
        .drop("_hash", "_own", "_class", "_cut", "_cut_tie")
    )


def _cuts_in_cells(
    hashed: DataFrame, label: str, key: str, rank: Callable[[Column], Column], **ranges
) -> DataFrame:
    """(class, order, tie) of the row at the rank of each class along (_hash, key).

    Hashes are even, so counts by their leading bits tell where a rank lies, and only the
    rows of that cell are moved and ordered.
    """
    placed = hashed.select(
        F.struct(col(label).alias("v")).alias("class"),
        F.shiftright("_hash", REST_BITS).alias("cell"),
        F.col("_hash").alias("order"),
        col(key).alias("tie"),
    )
    own = Window.partitionBy("class")
    earlier = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        placed.groupBy("class", "cell")
        .agg(F.count("*").alias("n"))
        .withColumns(
            {
                "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
                "total": F.sum("n").over(own),
            }
        )
        .withColumn("at", (rank(F.col("total")) - F.col("before")).cast("bigint"))
        .where((F.col("at") >= 0) & (F.col("at") < F.col("n")))
        .select("class", "cell", "at")
    )
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_CUTS
    held = placed.join(F.broadcast(wanted) if few else wanted, ["class", "cell"]).select(
        F.struct("class", "at").alias("place"), "order", "tie"
    )
    found = rows_at_ranks(
        written(held, "held"), "order", "tie",
        lambda _: F.array(F.col("group")["v"]["at"]), group="place", **ranges,
    )
    return found.select(F.col("group")["v"]["class"].alias("class"), "order", "tie")


def temporal_windows(
    df: DataFrame, order: str, tie: str, n_windows: int = 3, name: str = "window", **ranges
) -> DataFrame:
    """Contiguous windows D1, D2, ... along (order, tie), cut at floor(i * n / N).

    ``tie`` must be unique, so that equal times have one order; NULL times come first. Only
    the rows at the cuts are looked up, ``n_windows`` - 1 at most; every row is then
    compared with them.
    """

    def ranks(total: Column) -> Column:
        cuts = [F.floor(total * i / n_windows) for i in range(1, n_windows)]
        return F.array(*cuts).cast("array<bigint>")

    found = rows_at_ranks(df, order, tie, ranks, **ranges)
    kinds = [found.schema[c].dataType for c in ("order", "tie")]
    texts = [exact_text(F.col(c), k).alias(c) for c, k in zip(("order", "tie"), kinds)]
    label = F.lit(f"D{n_windows}")
    for row in sorted(found.select("place", *texts).collect(), reverse=True):
        cut = [exact_value(row[c], k) for c, k in zip(("order", "tie"), kinds)]
        is_before = before(col(order), col(tie), *cut)
        label = F.when(is_before, F.lit(f"D{row['place'] + 1}")).otherwise(label)
    return df.withColumn(name, label)


def window_pair(df: DataFrame, reference: str, current: str, name: str = "window") -> Pair:
    """Two windows of one table as a pair."""
    return Pair.of(df, col(name) == reference, col(name) == current)
