"""Category vocabularies as tables: counted, ranked and joined back without the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, to_category
from plumbline.operators.frames import melt
from plumbline.operators.ranges import ROWS_PER_RANGE
from plumbline.operators.sequence import number_rows
from plumbline.sources.shared import written

# The most frequent categories of a feature, which are broadcast to its rows.
FREQUENT = 1024
# Ways to spread rows that need no other join.
SALTS = 4096


def category_index(
    df: DataFrame, features: tuple[str, ...], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(feature, category, n, position): every category of every feature with its number of
    rows and its place, from 0, by falling number and then by name.

    Counts are combined before their shuffle, the order is cut into cells, and no
    vocabulary ever meets in one task. NULL is no category.
    """
    if not features:
        raise ValueError("no features given")
    counts = (
        melt(df, {c: {"category": to_category(col(c))} for c in features})
        .where(F.col("category").isNotNull())
        .groupBy("feature", "category")
        .agg(F.count("*").alias("n"))
        .withColumn("_order", F.struct("feature", (-F.col("n")).alias("n")))
    )
    numbered = written(
        number_rows(counts, "_order", "category", "_no", rows_per_range, derived=True).drop("_order"),
        "vocabulary",
    )
    first = numbered.groupBy("feature").agg(F.min("_no").alias("_first"))
    return numbered.join(F.broadcast(first), "feature").select(  # one row per feature
        "feature", "category", "n", (F.col("_no") - F.col("_first")).alias("position")
    )


def vocabulary_sizes(index: DataFrame) -> dict[str, int]:
    """Number of categories of each feature."""
    return {r["feature"]: r["count"] for r in index.groupBy("feature").count().collect()}


def add_positions(
    df: DataFrame, index: DataFrame, names: dict[str, str], sizes: dict[str, int] | None = None
) -> DataFrame:
    """The rows with the position of each feature's category under a name of its own, NULL
    for NULL and for what the index lacks. ``names`` maps features to new columns.

    The FREQUENT most frequent categories of a feature are broadcast; the others, which no
    large share of the rows has, are joined by a shuffle that rows without need of it
    cross under salted keys.
    """
    sizes = vocabulary_sizes(index) if sizes is None else sizes
    # Written down, so that a row keeps its salt whatever is computed again.
    rows = written(df, "rows").withColumn(
        "_salt", F.monotonically_increasing_id() % SALTS + 1
    )
    for feature, name in names.items():
        own = index.where(F.col("feature") == feature).select(
            F.col("category").alias("_category"), F.col("position").alias(name)
        )
        category = to_category(col(feature))
        frequent = own.where(F.col(name) < FREQUENT)
        rows = rows.join(F.broadcast(frequent), category == F.col("_category"), "left").drop("_category")
        if sizes.get(feature, 0) <= FREQUENT:
            continue
        rare = own.where(F.col(name) >= FREQUENT).select(
            "_category", F.col(name).alias("_rare"), (F.col(name) % 1).alias("_none")
        )
        open_ = F.col(name).isNull() & category.isNotNull()
        rows = (
            rows.withColumns(
                {
                    "_key": F.when(open_, category).otherwise(""),
                    "_spread": F.when(open_, F.lit(0)).otherwise(F.col("_salt")),
                }
            )
            .join(
                rare, (F.col("_key") == F.col("_category")) & (F.col("_spread") == F.col("_none")), "left"
            )
            .withColumn(name, F.coalesce(name, "_rare"))
            .drop("_key", "_spread", "_category", "_rare", "_none")
        )
    return rows.drop("_salt")


def sparse_vector(numeric: list[Column], hot: list[tuple[Column, int]]) -> Column:
    """The fields of a sparse vector: the numbers, NaN for NULL, then for each categorical
    feature (position, size) a one at the position; NULL gives zeros only."""
    places, start = [], len(numeric)
    for position, size in hot:
        places.append((position + F.lit(start)).cast("int"))
        start += size
    ones = F.filter(F.array(*places), lambda x: x.isNotNull()) if places else F.array().cast("array<int>")
    numbers = [F.coalesce(x, F.lit(float("nan"))) for x in numeric]
    first = F.array(*[F.lit(k) for k in range(len(numeric))]).cast("array<int>")
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(start).alias("size"),
        F.concat(first, ones).alias("indices"),
        F.concat(
            F.array(*numbers).cast("array<double>"), F.transform(ones, lambda _: F.lit(1.0))
        ).alias("values"),
    )
