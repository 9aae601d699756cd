"""Order-dependent operators that stay parallel inside a hot key.

A window partitioned by a key gives the whole key to one task. Here the rows are
first cut into cells along the order (see ``ranges``); windows run inside
(key, cell), and what a cell needs from earlier cells enters the same window as one
extra row in front.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col
from plumbline.operators.ranges import CELL, ROWS_PER_RANGE, ordered_cells


def _window(keys: list[str], *more: str):
    return Window.partitionBy(*[col(k) for k in keys], *[F.col(m) for m in more])


def number_rows(
    df: DataFrame,
    order: str,
    tie: str,
    name: str = "row_no",
    rows_per_range: int = ROWS_PER_RANGE,
    derived: bool = False,
) -> DataFrame:
    """Consecutive numbers from 1 along (order, tie), without a global sort."""
    cells = ordered_cells(df, order, tie, rows_per_range, derived)
    inside = Window.partitionBy(CELL).orderBy(col(order), col(tie))
    # One row per cell.
    sizes = cells.groupBy(CELL).count()
    before = Window.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(CELL, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        cells.withColumn(name, F.row_number().over(inside).cast("bigint"))
        .join(starts, CELL)
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_start", CELL)
    )


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    value: Column,
    name: str,
    following: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
    derived: bool = False,
) -> DataFrame:
    """Value of the row before (or, with ``following``, after) within the key."""
    cells = ordered_cells(df, order, tie, rows_per_range, derived)
    frame = cells.withColumn("_v", F.struct(value.alias("v")))
    shift = F.lead if following else F.lag
    pick = F.min_by if following else F.max_by
    edge = frame.groupBy(*[col(k).alias(k) for k in keys], CELL).agg(
        pick("_v", F.struct(col(order), col(tie))).alias("_edge")
    )
    along = _window(keys).orderBy(CELL)
    carried = edge.withColumn("_v", shift("_edge").over(along)).drop("_edge")
    both = _with_carried(frame, carried, 2 if following else 0)
    inside = _window(keys, CELL).orderBy("_turn", col(order), col(tie))
    return _own_rows(both.withColumn(name, shift("_v").over(inside)["v"])).drop("_v", CELL)


def running_max_before(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    value: Column,
    name: str,
    rows_per_range: int = ROWS_PER_RANGE,
    derived: bool = False,
) -> DataFrame:
    """Largest value among the earlier rows of the key, NULL on the first."""
    cells = ordered_cells(df, order, tie, rows_per_range, derived)
    return running_max_in(cells, keys, order, tie, value, name).drop(CELL)


def running_max_in(
    cells: DataFrame, keys: list[str], order: str, tie: str, value: Column, name: str
) -> DataFrame:
    """The same over rows that are cut into cells already, which they stay."""
    frame = cells.withColumn("_v", value)
    top = frame.groupBy(*[col(k).alias(k) for k in keys], CELL).agg(F.max("_v").alias("_top"))
    along = _window(keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carried = top.withColumn("_v", F.max("_top").over(along)).drop("_top")
    both = _with_carried(frame, carried, 0)
    inside = (
        _window(keys, CELL)
        .orderBy("_turn", col(order), col(tie))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return _own_rows(both.withColumn(name, F.max("_v").over(inside))).drop("_v")


def _with_carried(frame: DataFrame, carried: DataFrame, turn: int) -> DataFrame:
    """The rows (turn 1) and one row per (key, cell) with what other cells hand over, so
    that one shuffle serves both."""
    extra = carried.where(F.col("_v").isNotNull()).withColumn("_turn", F.lit(turn))
    return frame.withColumn("_turn", F.lit(1)).unionByName(extra, allowMissingColumns=True)


def _own_rows(both: DataFrame) -> DataFrame:
    return both.where(F.col("_turn") == 1).drop("_turn")


def latest_per_key(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Newest row of each key, by aggregation: combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(col(order), col(tie)))
    return (
        df.groupBy(*[col(k).alias(k) for k in keys])
        .agg(newest.alias("_row"))
        .select(*[col(k) for k in keys], *[F.col("_row").getField(c).alias(c) for c in rest])
    )


def rows_at_ranks(
    df: DataFrame,
    order: str,
    tie: str,
    ranks: Callable[[Column], Column],
    group: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(group, place, order, tie) of the rows at given 0-based ranks along (order, tie).

    ``ranks`` makes the array of ranks from the number of rows of a group (of all rows
    without groups), ``place`` is the place in it; ranks that don't exist give nothing. The
    group column is a struct, in
    which NULL is a group like any other. Only the cells that hold a wanted rank are sorted.
    """
    key = F.struct(col(group).alias("v")) if group else F.struct(F.lit(None).alias("v"))
    cells = ordered_cells(
        df.select(key.alias("group"), col(order).alias("order"), col(tie).alias("tie")),
        "order",
        "tie",
        rows_per_range,
    )
    along = Window.partitionBy("group").orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("group", CELL).agg(F.count("*").alias("n"))
    wanted = (
        sizes.withColumns(
            {
                "before": F.coalesce(F.sum("n").over(along), F.lit(0)),
                "total": F.sum("n").over(Window.partitionBy("group")),
            }
        )
        .select("group", CELL, "n", "before", F.posexplode(ranks(F.col("total"))))
        .withColumn("at", (F.col("col") - F.col("before")).cast("bigint"))
        .where((F.col("at") >= 0) & (F.col("at") < F.col("n")))
        .select("group", CELL, F.col("pos").alias("place"), "at")
    )
    inside = Window.partitionBy("group", CELL).orderBy("order", "tie")
    return (
        cells.join(wanted.select("group", CELL).distinct(), ["group", CELL], "left_semi")
        .withColumn("at", (F.row_number().over(inside) - 1).cast("bigint"))
        .join(wanted, ["group", CELL, "at"])
        .select("group", "place", "order", "tie")
    )


def before(order: Column, tie: Column, cut_order: Column, cut_tie: Column) -> Column:
    """Does (order, tie) come before the cut? Values keep their types, NULL comes first."""
    own = F.struct(order.alias("o"), tie.alias("t"))
    return own < F.struct(cut_order.alias("o"), cut_tie.alias("t"))


def exact_text(value: Column, kind: T.DataType) -> Column:
    """Text that ``exact_value`` turns into the same value, in any time zone."""
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    return value.cast("string")


def exact_value(text: str | None, kind: T.DataType) -> Column:
    if text is not None and isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    return F.lit(text).cast(kind)
