"""Champion promotion replayed over a history of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.ranges import CELL, ordered_cells
from plumbline.operators.sequence import running_max_in
from plumbline.sources.shared import counted, written

# Why a run was or was not promoted.
FIRST_CHAMPION = "no_existing_champion"
IMPROVED = "{metric}_improved_or_equal"
NOT_IMPROVED = "{metric}_below_champion"
PRIMARY_METRIC = "f1_macro"


def should_promote(
    new: float | None, champion: float | None, margin: float = 0.0, metric: str = PRIMARY_METRIC
) -> tuple[bool, str]:
    """Decision for one new run; a missing metric counts as 0, None is no champion."""
    if champion is None:
        return True, FIRST_CHAMPION
    better = (new or 0.0) >= champion + margin
    return better, (IMPROVED if better else NOT_IMPROVED).format(metric=metric)


def replay_promotions(
    runs: DataFrame,
    key: str,
    order: str,
    tie: str,
    value: str,
    margin: float = 0.0,
    metric: str = PRIMARY_METRIC,
    **ranges,
) -> DataFrame:
    """Add ``champion_before``, ``promoted`` and ``reason`` to every run of a history.

    Every ``key`` (dataset) has its own champion. Without a margin the champion is the
    running maximum. With one, promotions are linked to the next ones and the links are
    followed by doubling; no history is walked in order. A NULL or NaN metric counts as 0.
    """
    if margin < 0:
        raise ValueError("margin must not be negative")
    scored = runs.withColumn("_m", F.coalesce(F.nanvl(col(value).cast("double"), F.lit(0.0)), F.lit(0.0)))
    cells = ordered_cells(scored, order, tie, **ranges)
    if margin == 0.0:
        cells = running_max_in(cells, [key], order, tie, F.col("_m"), "champion_before")
    else:
        cells = _with_margin(cells, key, order, tie, margin)
    champion = cells.drop(CELL)
    first = F.col("champion_before").isNull()
    better = F.col("_m") >= F.col("champion_before") + margin
    return champion.withColumns(
        {
            "promoted": first | better,
            "reason": F.when(first, FIRST_CHAMPION)
            .when(better, IMPROVED.format(metric=metric))
            .otherwise(NOT_IMPROVED.format(metric=metric)),
        }
    ).drop("_m")


def _with_margin(cells: DataFrame, key: str, order: str, tie: str, margin: float) -> DataFrame:
    """Champion before each run when a promotion needs ``margin`` more.

    A promoted run beats the champion and every run since, so it is a record of its key,
    and records ascend along the order and in value alike. Were a record promoted, the
    next promotion would be the record with the smallest value from ``margin`` above it
    on: a link that hangs on the two values alone. What links lead to from the certain
    promotions is found by doubling their reach each turn. The champion before any run is
    then the largest promoted one so far.
    """
    best = written(running_max_in(cells, [key], order, tie, F.col("_m"), "_best"))
    record = F.col("_best").isNull() | (F.col("_m") > F.col("_best"))
    # A record this far above the one before it is promoted whatever came before.
    certain = F.col("_best").isNull() | (F.col("_m") >= F.col("_best") + margin)
    records = written(
        best.where(record).select(
            # In a struct NULL is a key like any other.
            F.struct(col(key).alias("k")).alias("_key"), "_m", certain.alias("_certain")
        )
    )
    promoted = _reached(
        records.where("_certain").select("_key", F.col("_m").alias("_at")),
        _next_records(records, margin),
    ).select(F.col("_key").alias("_pk"), F.col("_at").alias("_pm"), F.lit(True).alias("_promoted"))
    same = (F.struct(col(key).alias("k")) == F.col("_pk")) & (F.col("_m") == F.col("_pm"))
    marked = best.where(record).join(promoted, same, "left").drop("_pk", "_pm")
    marked = marked.unionByName(
        best.where(~record).withColumn("_promoted", F.lit(None).cast("boolean"))
    ).drop("_best")
    promoted_value = F.when(F.col("_promoted"), F.col("_m"))
    return running_max_in(marked, [key], order, tie, promoted_value, "champion_before").drop(
        "_promoted"
    )


def _next_records(records: DataFrame, margin: float) -> DataFrame:
    """(_key, _from, _to): the smallest record from ``margin`` above each record on.

    Records and the points they ask about are put into one falling order, cut into cells;
    the record wanted is the smallest one before the point in it.
    """
    none = F.lit(None).cast("double")
    points = records.select(
        "_key", (-F.col("_m")).alias("_p"), F.lit(0).alias("_t"), none.alias("_from"),
        (-F.col("_m")).alias("_low"),
    ).unionByName(
        records.select(
            "_key", (-(F.col("_m") + margin)).alias("_p"), F.lit(1).alias("_t"),
            F.col("_m").alias("_from"), none.alias("_low"),
        )
    )
    cells = ordered_cells(points, "_p", "_t", derived=True)
    found = running_max_in(cells, ["_key"], "_p", "_t", F.col("_low"), "_next")
    return found.where(F.col("_from").isNotNull() & F.col("_next").isNotNull()).select(
        "_key", "_from", (-F.col("_next")).alias("_to")
    )


def _reached(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(_key, _at) of all that links (_key, _from, _to) lead to from the starts.

    After k turns, places up to 2^k links away are found and a jump is 2^k links long, so
    the turns grow with the logarithm of the longest chain. A turn is two joins on (key,
    value), which no key can fill; the driver sees one number.
    """
    found, jumps = written(starts), written(links)
    while True:
        ahead = found.join(
            jumps, (found["_key"] == jumps["_key"]) & (found["_at"] == jumps["_from"])
        ).select(jumps["_key"], jumps["_to"].alias("_at"))
        fresh, n = counted(ahead.distinct().join(found, ["_key", "_at"], "left_anti"))
        if not n:
            return found
        found = found.unionByName(fresh)
        further = jumps.select(
            F.col("_key").alias("_k"), F.col("_from").alias("_f"), F.col("_to").alias("_end")
        )
        jumps = written(
            jumps.join(further, (F.col("_key") == F.col("_k")) & (F.col("_to") == F.col("_f")))
            .select("_key", "_from", F.col("_end").alias("_to"))
        )
