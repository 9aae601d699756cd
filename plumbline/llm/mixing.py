"""Mixing sources to target weights by Poisson replication.

A source's target share over its present share is the mean number of times its documents
are repeated. Each document draws its own count: a Poisson distribution of that mean is
inverted at a hash of the document's id, so the draw needs no state and comes out the
same wherever and however often it runs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.names import unused
from plumbline.sources.shared import written

# Without weights, a source's share follows its size to this power.
TEMPERATURE = 0.5
EPOCHS = 1.0
SEED = 17

# A mean above LARGEST_MEAN is the sum of several draws of smaller means; at that mean the
# distribution ends before TERMS for any double.
LARGEST_MEAN = 16.0
TERMS = 80
# Sources up to which their rows (under 1 kB each) are broadcast.
BROADCAST_SOURCES = 10_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame,
    text_column: str = "text",
    source_column: str = "source",
    weights: Mapping[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = EPOCHS,
) -> tuple[DataFrame, int]:
    """(source, rate, parts, cdf) of each source, and their number.

    ``weights`` are relative; a source they don't name gets none. The size of a document
    is its length in UTF-8 bytes plus one. All draws together aim at ``epochs`` times the
    size of the input.
    """
    size = F.coalesce(F.octet_length(col(text_column)), F.lit(0)) + 1
    sizes = docs.groupBy(col(source_column).cast("string").alias("source")).agg(
        F.sum(size).alias("size")
    )
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(share)).otherwise(weight)
    sizes = written(sizes.withColumn("weight", weight), "sources")
    totals = sizes.agg(
        F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("n")
    ).first()
    if totals["n"] and not totals["weight"]:
        raise ValueError("no source of the table has a weight")
    scale = epochs * (totals["size"] or 0) / (totals["weight"] or 1.0)
    rate = F.lit(scale) * F.col("weight") / F.col("size")
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def grow(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(
            p.alias("p"), F.array_append(state["c"], F.element_at(state["c"], -1) + p).alias("c")
        )

    rates = (
        sizes.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)))
        .withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow)["c"])
        .select("source", "rate", "parts", "cdf")
    )
    return rates, totals["n"]


def drawn(parts: Column, cdf: Column, *key: Column) -> Column:
    """The inverse of the distribution at the key's hash, summed over its parts."""

    def one(k: Column) -> Column:
        at = unit(*key, k.cast("string"))
        return F.size(F.filter(cdf, lambda c: c <= at)).cast("bigint")

    return F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), parts),
        F.lit(0).cast("bigint"),
        lambda total, k: total + one(k),
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Mapping[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = EPOCHS,
    seed: int = SEED,
    details: bool = False,
) -> DataFrame:
    """The documents, each as often as it was drawn, in a global shuffle.

    Rows keep their columns. ``details`` adds ``rate`` (the mean of the row's source),
    ``copy`` (from 1) and ``shuffle_key``, by which rows are dealt to partitions and
    ordered inside them. A NULL source is a source of its own. A row without id draws by
    its text. Repeated rows draw the same count. NULL text has size 1. No rows give no rows.
    """
    rates, n_sources = source_rates(docs, text_column, source_column, weights, temperature, epochs)
    if n_sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    names = [unused(docs, n) for n in ("rate", "parts", "cdf", "copy", "shuffle_key", "drawn_for")]
    rate, parts, cdf, copy, shuffle_key, drawn_for = names
    rates = rates.select(
        F.col("source").alias(drawn_for),
        F.col("rate").alias(rate),
        F.col("parts").alias(parts),
        F.col("cdf").alias(cdf),
    )
    key = F.coalesce(col(id_column).cast("string"), F.md5(F.coalesce(col(text_column), F.lit(""))))
    salt = F.lit(str(seed))
    count = drawn(F.col(parts), F.col(cdf), salt, key)
    out = (
        docs.join(rates, col(source_column).cast("string").eqNullSafe(F.col(drawn_for)))
        .withColumn(copy, count)
        .where(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copy))))
        .withColumn(shuffle_key, F.md5(F.concat_ws("|", salt, key, F.col(copy).cast("string"))))
        .repartition(shuffle_key)
        .sortWithinPartitions(shuffle_key)
    )
    extra = [F.col(rate), F.col(copy), F.col(shuffle_key)] if details else []
    return out.select(*[col(c) for c in docs.columns], *extra)
