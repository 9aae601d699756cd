"""Distribution drift between the two samples of a pair."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.bins import among, bin_index
from plumbline.functions.columns import col, to_category, to_numeric
from plumbline.functions.stats import (
    chi2_pvalue,
    ks_method,
    ks_pvalue,
    psi_term,
)
from plumbline.operators.frames import feature_frame, melt, small_frame
from plumbline.operators.ranges import (
    GRID_CELLS,
    ROWS_PER_RANGE,
    Grid,
    add_cells,
    edge_grid,
    even_grid,
    inner_grid,
    too_large,
)
from plumbline.sources.shared import written
from plumbline.spec import Baseline, Pair

# Name of the pooled category and the reference count it starts below.
OTHER = "__other__"
MIN_EXPECTED = 5.0

# Neighbouring cells of a stored reference that share a folder.
CELLS_PER_FOLDER = 64

_SIDES = [Pair.IN_REF, Pair.IN_CUR]
_ONLY_CURRENT = f"{Pair.IN_CUR} AND NOT {Pair.IN_REF}"
_NUMERIC_SCHEMA = pa.schema(
    [
        ("feature", pa.string()),
        ("n_ref", pa.int64()),
        ("n_cur", pa.int64()),
        ("ks_statistic", pa.float64()),
        ("bins", pa.list_(pa.struct([("n_ref", pa.int64()), ("n_cur", pa.int64())]))),
        ("total_ref", pa.int64()),
        ("total_cur", pa.int64()),
    ]
)


def _side_counts():
    return (
        F.count_if(Pair.IN_REF).alias("n_ref"),
        F.count_if(Pair.IN_CUR).alias("n_cur"),
    )


# --- binned counts and PSI --------------------------------------------------


def bin_counts(
    pair: Pair,
    edges: dict[str, list[float]],
    open_ended: bool = False,
    keep_outside: bool = False,
) -> DataFrame:
    """Counts per feature and bin of both samples: feature, bin, n_ref, n_cur.

    Values outside the edges are dropped; with ``keep_outside`` they are counted
    under a NULL bin. Rows are combined before the shuffle, which carries at most
    features x bins rows per task.
    """
    safe = {name: f"c{i}" for i, name in enumerate(edges)}
    values = pair.frame.select(
        *[to_numeric(col(n)).alias(c) for n, c in safe.items()], *_SIDES
    )
    parts = {}
    for name, cuts in edges.items():
        index = F.lit(None).cast("int")
        if len(cuts) > 1:
            index = bin_index(safe[name], cuts, open_ended)
        parts[name] = {"bin": index, "known": F.col(safe[name]).isNotNull()}
    long = melt(values, parts, keep=_SIDES)
    inside = F.col("known") if keep_outside else F.col("bin").isNotNull()
    return long.where(inside).groupBy("feature", "bin").agg(*_side_counts())


def _feature_totals(counts: DataFrame) -> DataFrame:
    """Both sides of every feature. The counts are shuffled once for this and for what
    they are joined with."""
    return counts.groupBy("feature").agg(
        F.sum("n_ref").alias("total_ref"), F.sum("n_cur").alias("total_cur")
    )


def psi_from_counts(counts: DataFrame) -> DataFrame:
    """PSI per feature from rows of (feature, n_ref, n_cur), one per bin or category.

    Totals are an aggregate joined back, not a window: a feature may have any number
    of categories and must not land in one task.
    """
    totals = _feature_totals(counts)
    term = psi_term(F.col("n_ref"), F.col("n_cur"), F.col("total_ref"), F.col("total_cur"))
    return (
        counts.join(F.broadcast(totals), "feature")  # one row per feature of the call
        .groupBy("feature")
        .agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))
    )


def psi_of_bins(bins: str, total_ref: str, total_cur: str) -> Column:
    """PSI of one row that holds its bins as an array of (n_ref, n_cur)."""
    totals = F.col(total_ref), F.col(total_cur)
    return F.aggregate(
        bins,
        F.lit(0.0),
        lambda total, b: total + F.coalesce(psi_term(b["n_ref"], b["n_cur"], *totals), F.lit(0.0)),
    )


def numeric_psi(
    pair: Pair,
    edges: dict[str, list[float]],
    open_ended: bool = False,
    min_rows: int = 0,
) -> DataFrame:
    """PSI of every numeric feature over fixed edges: feature, psi.

    Values outside the edges do not count, so a complete shift gives 0.0;
    ``open_ended`` closes that gap. Below ``min_rows`` known values on a side the
    result is NULL; a single edge gives 0.0.
    """
    counts = bin_counts(pair, edges, open_ended, keep_outside=min_rows > 0)
    binned = F.col("bin").isNotNull()
    # As many entries as the feature has bins.
    found = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("known_ref"),
        F.sum("n_cur").alias("known_cur"),
        F.sum(F.when(binned, F.col("n_ref"))).alias("total_ref"),
        F.sum(F.when(binned, F.col("n_cur"))).alias("total_cur"),
        F.collect_list(F.when(binned, F.struct("n_ref", "n_cur"))).alias("bins"),
    )
    psi = psi_of_bins("bins", "total_ref", "total_cur")
    enough = (F.coalesce("known_ref", F.lit(0)) >= min_rows) & (
        F.coalesce("known_cur", F.lit(0)) >= min_rows
    )
    return (
        feature_frame(pair.frame.sparkSession, edges)
        .join(found, "feature", "left")
        .select("feature", F.when(enough, F.coalesce(psi, F.lit(0.0))).alias("psi"))
    )


def category_counts(pair: Pair, features: tuple[str, ...]) -> DataFrame:
    """feature, category, n_ref, n_cur over the union of categories."""
    long = melt(
        pair.frame, {n: {"category": to_category(col(n))} for n in features}, keep=_SIDES
    )
    return (
        long.where(F.col("category").isNotNull())
        .groupBy("feature", "category")
        .agg(*_side_counts())
    )


def pool_rare(counts: DataFrame, min_expected: float = MIN_EXPECTED) -> DataFrame:
    """Pool categories the reference holds fewer than ``min_expected`` times."""
    return (
        counts.groupBy("feature", _pooled_name(min_expected).alias("category"))
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )


def _pooled_name(min_expected: float) -> Column:
    return F.when(F.col("n_ref") < min_expected, F.lit(OTHER)).otherwise(F.col("category"))


def category_statistics(counts: DataFrame, min_expected: float = MIN_EXPECTED) -> DataFrame:
    """PSI and chi-square per feature from category counts:
    feature, psi, chi2_statistic, chi2_dof, chi2_pvalue.

    PSI is over all categories, chi-square over the pooled ones with Yates' correction
    at one degree of freedom. Fewer than two categories give (0.0, 0, 1.0); a sample
    without any value gives NULLs. Every step combines before its shuffle, so neither a
    feature with many categories nor the pooled rest lands whole in one task.
    """
    totals = _feature_totals(counts)
    sides = F.col("total_ref"), F.col("total_cur")
    pooled = (
        counts.join(F.broadcast(totals), "feature")  # one row per feature of the call
        .groupBy("feature", _pooled_name(min_expected).alias("category"), "total_ref", "total_cur")
        .agg(
            F.sum("n_ref").alias("ref"),
            F.sum("n_cur").alias("cur"),
            F.sum(psi_term(F.col("n_ref"), F.col("n_cur"), *sides)).alias("psi"),
        )
    )
    size = (F.col("ref") + F.col("cur")).cast("double")

    def cell(observed: str, row_total: Column, yates: bool) -> Column:
        expected = F.nullif(size * row_total / F.nullif(sides[0] + sides[1], F.lit(0)), F.lit(0.0))
        gap = F.abs(F.col(observed) - expected)
        if yates:
            gap = gap - F.least(F.lit(0.5), gap)
        return gap * gap / expected

    def statistic(yates: bool) -> Column:
        return F.sum(cell("ref", sides[0], yates) + cell("cur", sides[1], yates))

    summed = pooled.groupBy("feature", "total_ref", "total_cur").agg(
        F.coalesce(F.sum("psi"), F.lit(0.0)).alias("psi"),
        (F.count("*") - 1).cast("int").alias("dof"),
        statistic(False).alias("plain"),
        statistic(True).alias("yates"),
    )
    both = (sides[0] > 0) & (sides[1] > 0)
    dof = F.col("dof")
    return summed.select(
        "feature",
        "psi",
        F.when(dof < 1, 0.0)
        .when(both & (dof == 1), F.col("yates"))
        .when(both, F.col("plain"))
        .alias("chi2_statistic"),
        F.when(dof < 1, 0).when(both, dof).alias("chi2_dof"),
    ).withColumn("chi2_pvalue", chi2_pvalue(F.col("chi2_statistic"), F.col("chi2_dof")))


def categorical_drift(
    pair: Pair,
    features: tuple[str, ...],
    min_expected: float = MIN_EXPECTED,
    frozen: FrozenReference | None = None,
) -> DataFrame:
    """PSI and chi-square of every categorical feature; a feature without any value has
    no drift. With a ``frozen`` reference only the current sample is read."""
    if frozen is None:
        counts = category_counts(pair, features)
    else:
        current = category_counts(Pair(pair.frame.where(_ONLY_CURRENT)), features)
        counts = (
            frozen.categories.where(F.col("feature").isin(list(features)))
            .unionByName(current)
            .groupBy("feature", "category")
            .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
        )
    found = category_statistics(counts, min_expected).withColumn("tested", F.lit(True))

    def known(column: str, default) -> Column:
        return F.when(F.col("tested").isNull(), F.lit(default)).otherwise(F.col(column)).alias(column)

    return (
        feature_frame(pair.frame.sparkSession, features)
        .join(found, "feature", "left")
        .select(
            "feature",
            known("psi", 0.0),
            known("chi2_statistic", 0.0),
            known("chi2_pvalue", 1.0),
            known("chi2_dof", 0),
        )
    )


def categorical_psi(pair: Pair, features: tuple[str, ...]) -> DataFrame:
    """PSI of every categorical feature; rare categories are not pooled."""
    found = psi_from_counts(category_counts(pair, features))
    return (
        feature_frame(pair.frame.sparkSession, features)
        .join(found, "feature", "left")
        .select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))
    )


def chi_square(counts: DataFrame, min_expected: float = MIN_EXPECTED) -> DataFrame:
    """Homogeneity of the two samples: feature, chi2_statistic, chi2_dof, chi2_pvalue."""
    return category_statistics(counts, min_expected).drop("psi")


# --- Kolmogorov-Smirnov ------------------------------------------------------


@dataclass(frozen=True)
class _Cell:
    """Counts of one grid cell and the values it spans."""

    number: int
    n_ref: int
    n_cur: int
    low: float
    high: float


@dataclass(frozen=True)
class _Bounds:
    """What the counts of a feature's cells say about its KS gap.

    ``open`` maps the cells where a larger gap may hide to the counts before them.
    """

    n_ref: int
    n_cur: int
    gap: float
    open: dict[int, tuple[int, int]]


def _bound_gap(cells: list[_Cell]) -> _Bounds:
    """Largest gap between cells, and the cells that could still beat it.

    Inside a cell both distribution functions run between their values at its ends,
    which bounds the gap. A cell reached by one sample only, or holding one value, has
    its extremes at the ends.
    """
    n_ref = sum(c.n_ref for c in cells)
    n_cur = sum(c.n_cur for c in cells)
    if n_ref < 2 or n_cur < 2:
        return _Bounds(n_ref, n_cur, 0.0, {})
    gap, ref, cur, limits = 0.0, 0, 0, []
    for c in cells:
        before = ref, cur
        ref, cur = ref + c.n_ref, cur + c.n_cur
        gap = max(gap, abs(ref / n_ref - cur / n_cur))
        if c.n_ref and c.n_cur and c.low != c.high:
            limit = max(abs(ref / n_ref - before[1] / n_cur), abs(cur / n_cur - before[0] / n_ref))
            limits.append((limit, c.number, before))
    return _Bounds(n_ref, n_cur, gap, {n: before for limit, n, before in limits if limit > gap})


def numeric_drift(
    pair: Pair,
    features: tuple[str, ...],
    edges: dict[str, list[float]] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    frozen: FrozenReference | None = None,
) -> DataFrame:
    """KS of every numeric feature, and PSI where ``edges`` are given:
    feature, psi, n_ref, n_cur, ks_statistic.

    One pass counts the cells of a grid. The grid contains the PSI edges, so PSI is
    done; and the counts bound the KS gap, so only the cells that can still hold the
    largest gap are ordered by value. Those are shuffled as counts per distinct value,
    each cell reports its extreme gap, and that is added to the counts before it. The
    first grid divides the baseline's bins (or the range of values) evenly; as long as an
    open cell is oversized, the open cells are divided in another pass.

    The passes run when this is called; the result is one row per feature, so using it
    several times repeats none of them. With a ``frozen`` reference every pass reads the
    current sample, and of the reference only the stored values of open cells.
    """
    spark = pair.frame.sparkSession
    edges = edges or {}
    safe = {name: f"c{i}" for i, name in enumerate(features)}
    values = pair.frame.select(
        *[to_numeric(col(n)).alias(s) for n, s in safe.items()], *_SIDES
    )
    grids = {safe[n]: edge_grid(e) for n, e in edges.items() if n in safe and len(e) > 1}
    rest = [s for s in safe.values() if s not in grids]
    if rest:
        spans = values.agg(
            *[f(s).alias(s + suffix) for s in rest for f, suffix in ((F.min, "_low"), (F.max, "_high"))]
        ).first()
        grids |= {s: even_grid(spans[s + "_low"], spans[s + "_high"]) for s in rest}
    celled = add_cells(values, grids)
    if frozen is None:
        cells = _count_cells(celled, safe)
    else:
        current = _count_cells(celled.where(_ONLY_CURRENT), safe)
        cells = {n: _merge_cells(frozen.cells[n], current[n]) for n in features}
    binned = {n: _bins(cells[n], grids[safe[n]], edges.get(n, [])) for n in features}
    bounds = {n: _bound_gap(found) for n, found in cells.items()}
    while frozen is None:
        crowded = _crowded(cells, bounds, rows_per_range)
        grids |= {safe[n]: inner_grid([(c.low, c.high) for c in x]) for n, x in crowded.items()}
        if not crowded:
            break
        celled = add_cells(values, grids)
        counted = _count_cells(celled, {n: safe[n] for n in crowded})
        divided = {n: _divide(cells[n], x, counted[n]) for n, x in crowded.items()}
        stuck = all(len(found) == len(cells[n]) for n, found in divided.items())
        cells |= divided
        bounds |= {n: _bound_gap(found) for n, found in divided.items()}
        if stuck:
            break

    if frozen is None:
        inside = _gaps_inside(celled, safe, bounds)
    else:
        inside = _gaps_with_store(frozen, celled.where(_ONLY_CURRENT), safe, cells, bounds, rows_per_range)
    rows = []
    for n, b in bounds.items():
        bins = binned[n]
        totals = [sum(x[side] for x in bins) for side in ("n_ref", "n_cur")]
        rows.append((n, b.n_ref, b.n_cur, max(b.gap, inside.get(n, 0.0)), bins, *totals))
    base = small_frame(spark, rows, _NUMERIC_SCHEMA)
    out = base.select("feature", "n_ref", "n_cur", "ks_statistic")
    if edges:
        out = base.select(
            "feature",
            psi_of_bins("bins", "total_ref", "total_cur").alias("psi"),
            "n_ref",
            "n_cur",
            "ks_statistic",
        )
    return out


def _crowded(
    cells: dict[str, list[_Cell]], bounds: dict[str, _Bounds], rows_per_range: int
) -> dict[str, list[_Cell]]:
    """Open cells of the features that have an oversized one among them."""
    found = {}
    for n, b in bounds.items():
        opened = [c for c in cells[n] if c.number in b.open]
        if any(too_large(c.n_ref + c.n_cur, rows_per_range) for c in opened):
            found[n] = opened
    return found


def _divide(cells: list[_Cell], opened: list[_Cell], counted: list[_Cell]) -> list[_Cell]:
    """The cells with the open ones replaced by what a finer grid counted inside them. A
    closed cell stays closed, as gaps found only grow, so its number is not used again."""
    numbers = {c.number for c in opened}
    starts = sorted((c.low, c.high) for c in opened)
    lows = [low for low, _ in starts]

    def inside(c: _Cell) -> bool:
        at = bisect_right(lows, c.low) - 1
        return at >= 0 and c.high <= starts[at][1]

    kept = [replace(c, number=-1) for c in cells if c.number not in numbers]
    return sorted(kept + [c for c in counted if inside(c)], key=lambda c: c.low)


def _merge_cells(reference: list[_Cell], current: list[_Cell]) -> list[_Cell]:
    """Counts of the two samples over one grid, put together."""
    merged = {c.number: c for c in reference}
    for c in current:
        r = merged.get(c.number)
        merged[c.number] = c if r is None else _Cell(
            c.number, r.n_ref, c.n_cur, min(r.low, c.low), max(r.high, c.high)
        )
    return [merged[n] for n in sorted(merged)]


def _count_cells(celled: DataFrame, safe: dict[str, str]) -> dict[str, list[_Cell]]:
    """Cells of every feature in value order."""
    counted = (
        melt(
            celled,
            {n: {"cell": F.col(s + "_cell"), "v": F.col(s)} for n, s in safe.items()},
            keep=_SIDES,
        )
        .where(F.col("cell").isNotNull())
        .groupBy("feature", "cell")
        .agg(*_side_counts(), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    cells: dict[str, list[_Cell]] = {n: [] for n in safe}
    for r in counted.collect():
        cells[r["feature"]].append(_Cell(r["cell"], r["n_ref"], r["n_cur"], r["low"], r["high"]))
    for found in cells.values():
        found.sort(key=lambda c: c.number)
    return cells


def _bins(cells: list[_Cell], grid: Grid, edges: list[float]) -> list[dict]:
    """Cells added up to PSI bins. The edges are cut points of the grid, so every cell
    lies in one bin or outside all of them."""
    if len(edges) < 2:
        return []
    bins = [{"n_ref": 0, "n_cur": 0} for _ in edges[1:]]
    for c in cells:
        number = grid.range_of(c.number)
        start = grid.splits[number - 1] if number else -math.inf
        if edges[0] <= start <= edges[-1]:
            at = bins[min(bisect_right(edges, start), len(bins)) - 1]
            at["n_ref"] += c.n_ref
            at["n_cur"] += c.n_cur
    return bins


def _gaps_inside(
    celled: DataFrame, safe: dict[str, str], bounds: dict[str, _Bounds]
) -> dict[str, float]:
    """Largest gap within the open cells of each feature."""
    opened = {n: b.open for n, b in bounds.items() if b.open}
    if not opened:
        return {}
    by_value = (
        _open_values(celled, safe, {n: list(found) for n, found in opened.items()})
        .groupBy("feature", "cell", "value")
        .agg(F.count_if(Pair.IN_REF).alias("ref"), F.count_if(Pair.IN_CUR).alias("cur"))
    )
    return _largest_gaps(by_value, bounds)


def _open_values(celled: DataFrame, safe: dict[str, str], opened: dict[str, list[int]]) -> DataFrame:
    """The rows in open cells, one for each feature: (feature, cell, value) and both sides."""
    return melt(
        celled,
        {
            n: {
                "cell": F.when(among(safe[n] + "_cell", found), F.col(safe[n] + "_cell")),
                "value": F.col(safe[n]),
            }
            for n, found in opened.items()
        },
        keep=_SIDES,
    ).where(F.col("cell").isNotNull())


def _largest_gaps(by_value: DataFrame, bounds: dict[str, _Bounds]) -> dict[str, float]:
    """Largest gap of each feature, from counts (feature, cell, value, ref, cur) of the
    distinct values in open cells."""
    # One row per open cell, at most about GRID_CELLS per feature.
    start = small_frame(
        by_value.sparkSession,
        [
            (n, number, ref, cur, b.n_ref, b.n_cur)
            for n, b in bounds.items()
            for number, (ref, cur) in b.open.items()
        ],
        pa.schema(
            [
                ("feature", pa.string()),
                ("cell", pa.int32()),
                ("before_ref", pa.int64()),
                ("before_cur", pa.int64()),
                ("n_ref", pa.int64()),
                ("n_cur", pa.int64()),
            ]
        ),
    )
    along = Window.partitionBy("feature", "cell").orderBy("value")

    def reached(side: str):
        return (F.col(f"before_{side}") + F.sum(side).over(along)) / F.col(f"n_{side}")

    gaps = (
        by_value.join(F.broadcast(start), ["feature", "cell"])
        .select("feature", F.abs(reached("ref") - reached("cur")).alias("gap"))
        .groupBy("feature")
        .agg(F.max("gap").alias("gap"))
    )
    return {r["feature"]: r["gap"] for r in gaps.collect()}


def _gaps_with_store(
    frozen: FrozenReference,
    current: DataFrame,
    safe: dict[str, str],
    cells: dict[str, list[_Cell]],
    bounds: dict[str, _Bounds],
    rows_per_range: int,
) -> dict[str, float]:
    """``_gaps_inside`` where the reference is a table of value counts by cell: only the
    folders of open cells are read, and as long as an open cell is oversized, the values
    in open cells are divided further."""
    opened = {n: list(b.open) for n, b in bounds.items() if b.open}
    if not opened:
        return {}
    rows = (
        frozen.values_in(opened)
        .select("feature", "cell", "value", F.col("n").alias("ref"), F.lit(0).cast("bigint").alias("cur"))
        .unionByName(
            _open_values(current, safe, opened)
            .groupBy("feature", "cell", "value")
            .agg(F.lit(0).cast("bigint").alias("ref"), F.count("*").alias("cur"))
        )
        .groupBy("feature", "cell", "value")
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    cells, bounds = dict(cells), dict(bounds)
    while crowded := _crowded(cells, bounds, rows_per_range):
        spans = [
            (n, c.number, place * GRID_CELLS, c.low, c.high)
            for n, found in crowded.items()
            for place, c in enumerate(found)
        ]
        # One row per open cell, at most about GRID_CELLS per feature.
        frame = small_frame(
            rows.sparkSession, spans,
            pa.schema(
                [("feature", pa.string()), ("cell", pa.int32()), ("first", pa.int64()),
                 ("low", pa.float64()), ("high", pa.float64())]
            ),
        )
        width = F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0))
        share = (F.col("value") / 2 - F.col("low") / 2) / width
        part = F.floor(F.coalesce(share, F.lit(0.0)) * GRID_CELLS).cast("bigint")
        part = F.least(F.greatest(part, F.lit(0)), F.lit(GRID_CELLS - 1))
        # A crowded feature goes on with its open cells only, under new numbers.
        kept = F.col("first").isNotNull() | ~F.col("feature").isin(list(crowded))
        finer = rows.join(F.broadcast(frame), ["feature", "cell"], "left").where(kept).select(
            "feature", F.coalesce((F.col("first") + part).cast("int"), "cell").alias("cell"),
            "value", "ref", "cur",
        )
        counted: dict[str, list[_Cell]] = {n: [] for n in crowded}
        for r in (
            finer.where(F.col("feature").isin(list(crowded)))
            .groupBy("feature", "cell")
            .agg(
                F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
                F.min("value").alias("low"), F.max("value").alias("high"),
            )
            .collect()
        ):
            counted[r["feature"]].append(_Cell(r["cell"], r["n_ref"], r["n_cur"], r["low"], r["high"]))
        divided = {
            n: _divide(cells[n], x, sorted(counted[n], key=lambda c: c.number))
            for n, x in crowded.items()
        }
        stuck = all(len(found) == len(cells[n]) for n, found in divided.items())
        rows = written(finer, "values")
        cells |= divided
        bounds |= {n: _bound_gap(found) for n, found in divided.items()}
        if stuck:
            break
    return _largest_gaps(rows, bounds)


# --- reference taken once ------------------------------------------------------


@dataclass(frozen=True)
class FrozenReference:
    """Counts of a reference sample, taken once for many checks against it.

    It serves pairs made of two tables (no row in both samples) and belongs to the
    edges of its baseline. ``values`` holds how often each value of a cell occurs, in
    folders by feature and run of cells: what is left to read of the reference in a check
    are the folders of those cells that may hold a feature's largest KS gap.
    """

    baseline: Baseline
    n_rows: int
    cells: dict[str, list[_Cell]]
    values: DataFrame | None
    categories: DataFrame | None

    def values_in(self, cells: dict[str, list[int]]) -> DataFrame:
        """(feature, cell, value, n) of some cells of some features."""
        place = {n: i for i, n in enumerate(self.baseline.numeric)}
        wanted = reduce(
            or_,
            (
                (F.col("feature_no") == place[n])
                & F.col("part").isin(sorted({c // CELLS_PER_FOLDER for c in found}))
                & among("cell", found)
                for n, found in cells.items()
            ),
        )
        return self.values.where(wanted)


def freeze_reference(reference: DataFrame, baseline: Baseline) -> FrozenReference:
    """Count a reference sample; its value and category counts become tables in the shared
    folder, and the reference itself is not read again."""
    frame = reference.withColumns({Pair.IN_REF: F.lit(True), Pair.IN_CUR: F.lit(False)})
    safe = {name: f"c{i}" for i, name in enumerate(baseline.numeric)}
    cells, values, categories = {}, None, None
    if baseline.numeric:
        numbers = frame.select(*[to_numeric(col(n)).alias(s) for n, s in safe.items()], *_SIDES)
        grids = {safe[n]: edge_grid(e) for n, e in baseline.edges.items()}
        celled = add_cells(numbers, grids)
        place = F.create_map(*[F.lit(x) for i, n in enumerate(baseline.numeric) for x in (n, i)])
        values = written(
            melt(celled, {n: {"cell": F.col(s + "_cell"), "value": F.col(s)} for n, s in safe.items()})
            .where(F.col("cell").isNotNull())
            .groupBy("feature", "cell", "value")
            .agg(F.count("*").alias("n"))
            .select(
                "*",
                place[F.col("feature")].alias("feature_no"),
                F.floor(F.col("cell") / CELLS_PER_FOLDER).cast("int").alias("part"),
            )
            # Neighbouring cells lie together, and a cell of many values in several tasks.
            .repartitionByRange("feature_no", "cell", "value")
            .sortWithinPartitions("feature_no", "cell", "value"),
            "reference",
            ("feature_no", "part"),
        )
        cells = {n: [] for n in baseline.numeric}
        for r in (
            values.groupBy("feature", "cell")
            .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .collect()
        ):
            cells[r["feature"]].append(_Cell(r["cell"], r["n"], 0, r["low"], r["high"]))
        for found in cells.values():
            found.sort(key=lambda c: c.number)
    if baseline.categorical:
        categories = written(category_counts(Pair(frame), baseline.categorical), "categories")
    return FrozenReference(baseline, reference.count(), cells, values, categories)


def ks_test(numeric: DataFrame, method: str = "stephens") -> DataFrame:
    """Add ks_pvalue and ks_pvalue_method to rows with ks_statistic, n_ref, n_cur."""
    sizes = F.col("n_ref"), F.col("n_cur")
    return numeric.withColumns(
        {
            "ks_pvalue": ks_pvalue(F.col("ks_statistic"), *sizes, method),
            "ks_pvalue_method": ks_method(*sizes, method),
        }
    )
