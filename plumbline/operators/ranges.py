"""Cutting ordered data into ranges of bounded size.

Ranks, cumulative distributions and running values need an order, but a window
over a whole feature or a whole key would put it into one task. Numbers are counted on
even grids, and a cell that still holds too much is divided again, 4096 times each pass;
rows in an order of any type are cut by Spark's own range partitioning. Cuts only steer
how work is spread: a result is exact wherever they fall.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.sources.shared import counted, written

ROWS_PER_RANGE = 200_000

# Cells of a grid per column.
GRID_CELLS = 4096
# A cell may hold this many times the rows of a range before it is divided again.
OVERSIZE = 5


def double_array(values: list[float]) -> Column:
    """Literal array of finite doubles."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def add_ranges(df: DataFrame, splits: dict[str, list[float]], suffix: str = "_rng") -> DataFrame:
    """Range number (0-based) of each column; NULL for a NULL value."""
    cut = {c: s for c, s in splits.items() if s}
    whole = [c for c in splits if c not in cut]
    if cut:
        df = Bucketizer(
            inputCols=list(cut),
            outputCols=[c + suffix for c in cut],
            splitsArray=[[-math.inf, *s, math.inf] for s in cut.values()],
            handleInvalid="keep",
        ).transform(df)
    return df.withColumns(
        {c + suffix: F.col(c + suffix).cast("int") for c in cut}
        | {c + suffix: F.when(F.col(c).isNotNull(), F.lit(0)) for c in whole}
    )


@dataclass(frozen=True)
class Grid:
    """Cut points of a column, and how many even cells each range is divided into.

    The cells cost arithmetic only, so a few cut points give thousands of them. Cell
    numbers never decrease with the value.
    """

    splits: list[float]
    parts: int

    def range_of(self, cell: int) -> int:
        return cell // self.parts


_LARGEST = sys.float_info.max


def even_grid(low: float | None, high: float | None) -> Grid:
    """Grid of even cells from the smallest to the largest value."""
    return Grid([], 1) if low is None else inner_grid([(low, high)])


def inner_grid(spans: list[tuple[float, float]]) -> Grid:
    """Grid that divides each of some disjoint spans of values, both ends included."""
    cuts = set()
    for low, high in spans:
        low, high = max(low, -_LARGEST), min(high, _LARGEST)
        cuts |= {low, min(math.nextafter(high, math.inf), _LARGEST)}
    return Grid(sorted(cuts), max(1, GRID_CELLS // max(1, len(cuts) - 1)))


def edge_grid(edges: list[float]) -> Grid:
    """Grid of even cells between the edges of a baseline. The last bin holds its upper
    edge, so a cut follows right behind it."""
    return Grid([*edges, math.nextafter(edges[-1], math.inf)], max(1, GRID_CELLS // len(edges)))


def too_large(cell_rows: int, rows_per_range: int = ROWS_PER_RANGE) -> bool:
    """Is a cell worth another pass that divides it further?"""
    return cell_rows > OVERSIZE * rows_per_range


def add_cells(df: DataFrame, grids: dict[str, Grid], suffix: str = "_cell") -> DataFrame:
    """Cell number of each column; NULL for a NULL value."""
    df = add_ranges(df, {c: g.splits for c, g in grids.items()}, suffix)
    divided = {}
    for c, grid in grids.items():
        if grid.parts == 1 or len(grid.splits) < 2:
            divided[c + suffix] = F.col(c + suffix) * grid.parts
            continue
        # Range 0 and the last one are open: one cell each.
        place = F.col(c + suffix) - 1
        low = F.get(double_array(grid.splits), place)
        # Halved, as the whole span of doubles is no double.
        widths = [b / 2 - a / 2 for a, b in zip(grid.splits, grid.splits[1:])]
        scales = [grid.parts / w if w > 0 else 0.0 for w in widths]
        # A range of a single heavy value is too narrow to divide.
        scale = F.get(double_array([x if math.isfinite(x) else 0.0 for x in scales]), place)
        step = F.floor((F.col(c) / 2 - low / 2) * scale)
        part = F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(grid.parts - 1)), F.lit(0))
        divided[c + suffix] = (F.col(c + suffix) * grid.parts + part).cast("int")
    return df.withColumns(divided)


CELL = "_cell"


def ordered_cells(
    df: DataFrame,
    order: str,
    tie: str,
    rows_per_range: int = ROWS_PER_RANGE,
    derived: bool = False,
) -> DataFrame:
    """The rows with a ``_cell`` number that never decreases along (order, tie).

    Rows are range-partitioned by the real values, NULLs first, as a window orders them,
    and a cell is a partition of about ``rows_per_range`` rows. One order value that many
    rows share is cut along ``tie``. Rows that fill no more than one cell are one as they
    are. A ``derived`` frame (the result of a shuffle) is written first, as it is read for
    its size, its sample and its rows.
    """
    if derived:
        df, n_rows = counted(df)
    else:
        n_rows = df.count()
    n_cells = max(1, math.ceil(n_rows / rows_per_range))
    if n_cells == 1:
        return df.withColumn(CELL, F.lit(0))
    ranged = df.repartitionByRange(n_cells, col(order), col(tie))
    return written(ranged.withColumn(CELL, F.spark_partition_id()), "cells")
