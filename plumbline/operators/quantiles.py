"""Exact quantiles, and the bin edges made from them."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.bins import among
from plumbline.functions.columns import col, to_numeric
from plumbline.functions.stats import PSI_FLOOR
from plumbline.operators.frames import melt, small_frame
from plumbline.operators.ranges import (
    ROWS_PER_RANGE,
    Grid,
    add_cells,
    even_grid,
    inner_grid,
    too_large,
)
from plumbline.spec import Baseline


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    rows_per_range: int = ROWS_PER_RANGE,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of each column, see ``quantiles_and_moments``."""
    return quantiles_and_moments(df, columns, probs, {}, rows_per_range)[0]


def quantiles_and_moments(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    moments: dict[str, Callable[[str], Column]],
    rows_per_range: int = ROWS_PER_RANGE,
) -> tuple[dict[str, list[float]], dict[str, dict]]:
    """Linearly interpolated quantiles of each column; no values give an empty list. Next
    to an infinite value the nearer of both values is taken.

    The ranks are looked up by selection rather than by sorting: count the cells of a
    grid, keep only those that hold a wanted rank, then order the values of these.
    Besides cell counts, only the kept cells (at most two per quantile) are shuffled,
    as counts per distinct value. The first grid is even between the smallest and the
    largest value; as long as that leaves a wanted rank in an oversized cell, the cells of
    wanted ranks are divided in another pass. The built-in exact percentile would gather
    every distinct value of a feature in one task.

    The pass that finds smallest and largest values also takes ``moments``, aggregates by
    name; they come back per column, with ``count``, ``min`` and ``max``.
    """
    spark = df.sparkSession
    safe = {name: f"c{i}" for i, name in enumerate(columns)}
    values = df.select(*[to_numeric(col(n)).alias(s) for n, s in safe.items()])
    wanted = {"": F.count, "_low": F.min, "_high": F.max}
    wanted |= {f"_{name}": f for name, f in moments.items()}
    aggregates = [f(s).alias(s + suffix) for s in safe.values() for suffix, f in wanted.items()]
    known = values.agg(*aggregates).first() if aggregates else None
    taken = {
        n: {"count": known[s], "min": known[s + "_low"], "max": known[s + "_high"]}
        | {name: known[f"{s}_{name}"] for name in moments}
        for n, s in safe.items()
    }
    size = {name: known[s] for name, s in safe.items()}
    filled = [n for n in columns if size[n] > 0]
    if not filled:
        return {n: [] for n in columns}, taken
    grids = {n: even_grid(taken[n]["min"], taken[n]["max"]) for n in filled}
    found: dict[tuple[str, int], float] = {}
    while True:
        celled = add_cells(values, {safe[n]: g for n, g in grids.items()})
        cells = _cell_counts(celled, safe, filled)
        ends, targets = _locate(cells, size, probs)
        # What was found stays: later grids are fine only around the other ranks.
        found = ends | found
        targets = [t for t in targets if (t[0], t[2]) not in found]
        finer = _finer(cells, targets, rows_per_range)
        if all(grids[n] == g for n, g in finer.items()):
            break
        grids |= finer
    kept: dict[str, set[int]] = {}
    for name, cell, *_ in targets:
        kept.setdefault(name, set()).add(cell)

    if targets:
        kept_values = melt(
            celled,
            {
                n: {
                    "cell": F.col(safe[n] + "_cell"),
                    "value": F.when(among(safe[n] + "_cell", list(kept[n])), F.col(safe[n])),
                }
                for n in kept
            },
        ).where(F.col("value").isNotNull())
        in_cell = Window.partitionBy("feature", "cell").orderBy("value")
        ordered = (
            kept_values.groupBy("feature", "cell", "value")
            .agg(F.count("*").alias("n"))
            .withColumn("upto", F.sum("n").over(in_cell))
        )
        target = small_frame(
            spark,
            targets,
            pa.schema(
                [
                    ("feature", pa.string()),
                    ("cell", pa.int32()),
                    ("rank", pa.int64()),
                    ("local_rank", pa.int64()),
                ]
            ),
        )
        # At most two targets per quantile and feature.
        picked = ordered.join(F.broadcast(target), ["feature", "cell"]).where(
            (F.col("local_rank") < F.col("upto"))
            & (F.col("local_rank") >= F.col("upto") - F.col("n"))
        )
        found |= {(r["feature"], r["rank"]): r["value"] for r in picked.collect()}

    def quantile(name: str, q: float) -> float:
        place = q * (size[name] - 1)
        low, high = found[name, math.floor(place)], found[name, math.ceil(place)]
        part = place - math.floor(place)
        if low == high or math.isinf(low) or math.isinf(high):
            return low if part < 0.5 else high  # nothing to interpolate
        # Measured from the nearer end, so rounding agrees with NumPy's quantile.
        if part < 0.5:
            return low + (high - low) * part
        return high - (high - low) * (1.0 - part)

    return {n: [quantile(n, q) for q in probs] if size[n] else [] for n in columns}, taken


def _cell_counts(celled: DataFrame, safe: dict[str, str], columns: list[str]) -> dict[str, list]:
    """(cell, rows, smallest, largest value) of every column, in cell order."""
    histogram = (
        melt(celled, {n: {"cell": F.col(safe[n] + "_cell"), "v": F.col(safe[n])} for n in columns})
        .where(F.col("cell").isNotNull())
        .groupBy("feature", "cell")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    cells: dict[str, list] = {n: [] for n in columns}
    for r in histogram.collect():
        cells[r["feature"]].append((r["cell"], r["n"], r["low"], r["high"]))
    return {n: sorted(found, key=lambda c: c[0]) for n, found in cells.items()}


def _finer(cells: dict[str, list], targets: list[tuple], rows_per_range: int) -> dict[str, Grid]:
    """Grids that divide the cells of wanted ranks, for columns where one is too large."""
    wanted: dict[str, set[int]] = {}
    for name, cell, *_ in targets:
        wanted.setdefault(name, set()).add(cell)
    grids = {}
    for name, numbers in wanted.items():
        held = [c for c in cells[name] if c[0] in numbers]
        if any(too_large(rows, rows_per_range) for _, rows, *_ in held):
            grids[name] = inner_grid([(low, high) for *_, low, high in held])
    return grids


def _locate(cells: dict[str, list], size: dict[str, int], probs: list[float]):
    """Values already known from the ends of cells, and (column, cell, rank, rank in the
    cell) of the others. Ranks are 0-based; a quantile needs the value at its floor and
    at its ceiling."""
    found, targets = {}, []
    for name, counted in cells.items():
        places = {q * (size[name] - 1) for q in probs}
        ranks = {math.floor(p) for p in places} | {math.ceil(p) for p in places}
        before = 0
        for cell, n, low, high in counted:
            for rank in ranks:
                if not before <= rank < before + n:
                    continue
                if low is not None and (low == high or rank == before):
                    found[name, rank] = low
                elif low is not None and rank == before + n - 1:
                    found[name, rank] = high
                else:
                    targets.append((name, cell, rank, rank - before))
            before += n
    return found, targets


def quantile_edges(
    df: DataFrame,
    columns: list[str],
    n_bins: int = 10,
    rows_per_range: int = ROWS_PER_RANGE,
    approximate: bool = False,
    widen_constant: bool = True,
) -> dict[str, list[float]]:
    """Equal-frequency bin edges, ascending and without duplicates.

    ``approximate`` takes them from a quantile sketch in a single pass instead.
    A constant column gets a hair-wide bin, an empty one the unit bin.
    """
    parts = max(n_bins, 1)
    probs = [i * (1.0 / parts) for i in range(parts)] + [1.0]
    if approximate:
        safe = {name: f"c{i}" for i, name in enumerate(columns)}
        long = melt(df, {n: {"value": to_numeric(col(n))} for n in safe}).where(
            F.col("value").isNotNull()
        )
        rows = (
            long.groupBy("feature").agg(F.percentile_approx("value", probs).alias("q")).collect()
        )
        quantiles = {r["feature"]: list(r["q"]) for r in rows}
    else:
        quantiles = exact_quantiles(df, columns, probs, rows_per_range)

    edges = {}
    for name in columns:
        distinct = sorted(set(quantiles.get(name, [])))
        if not distinct:
            distinct = [0.0, 1.0]
        elif len(distinct) == 1 and widen_constant:
            distinct = [distinct[0], distinct[0] + PSI_FLOOR]
        edges[name] = distinct
    return edges


def fit_baseline(
    reference: DataFrame,
    numeric: tuple[str, ...],
    categorical: tuple[str, ...] = (),
    psi_bins: int = 10,
    metadata: dict[str, str] | None = None,
    approximate: bool = False,
) -> Baseline:
    """Freeze the bin edges of the reference sample."""
    missing = [c for c in (*numeric, *categorical) if c not in reference.columns]
    if missing:
        raise KeyError(f"Columns not found: {', '.join(sorted(missing))}")
    return Baseline(
        edges=quantile_edges(
            reference, list(numeric), psi_bins, approximate=approximate
        ),
        categorical=tuple(categorical),
        psi_bins=psi_bins,
        metadata=dict(metadata or {}),
    )


def edge_rows(spark, baseline: Baseline) -> DataFrame:
    """Edges as rows: feature, edge number, edge."""
    rows = [
        (name, i, edge)
        for name, edges in baseline.edges.items()
        for i, edge in enumerate(edges)
    ]
    return small_frame(
        spark,
        rows,
        pa.schema(
            [("feature", pa.string()), ("edge_no", pa.int64()), ("edge", pa.float64())]
        ),
    )
