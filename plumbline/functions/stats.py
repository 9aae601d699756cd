"""Statistics of one result row: PSI terms, bands, tests and their p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping floor of proportions, PSI bands, names of the outcomes.
PSI_FLOOR = 1e-6
PSI_MODERATE_FROM = 0.1
PSI_HIGH_FROM = 0.25
BAND_STABLE = "stable"
BAND_MODERATE = "moderate"
BAND_HIGH = "high"
SIGNIFICANT = "significant"
NO_SIGNAL = "no_signal"

# Two-sample KS: ways to a p-value. The exact sum for samples of one size ends where its
# terms fall below exp(-depth).
KS_METHODS = ("stephens", "exact")
KS_EXACT_DEPTH = 45.0
# Samples of unequal size get an exact value up to this many rows together.
KS_EXACT_ROWS = 100_000
KS_TERMS = 100

ERFC_TERMS = 80


def psi_term(n_ref: Column, n_cur: Column, ref_total: Column, cur_total: Column) -> Column:
    """Contribution of one bin. An empty bin contributes nothing, so bins that
    neither sample reaches need not be listed."""

    def share(n: Column, total: Column) -> Column:
        part = n / F.nullif(total, F.lit(0))
        return F.least(F.greatest(part, F.lit(PSI_FLOOR)), F.lit(1.0))

    e, a = share(n_ref, ref_total), share(n_cur, cur_total)
    return F.when((ref_total > 0) & (cur_total > 0), (a - e) * F.ln(a / e))


def psi_band(psi: Column) -> Column:
    return (
        F.when(psi < PSI_MODERATE_FROM, BAND_STABLE)
        .when(psi < PSI_HIGH_FROM, BAND_MODERATE)
        .when(psi.isNotNull(), BAND_HIGH)
    )


def interpret_pvalue(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, SIGNIFICANT).when(p.isNotNull(), NO_SIGNAL)


def ks_method(n_ref: Column, n_cur: Column, method: str = "stephens") -> Column:
    """What ``ks_pvalue`` does for these sizes."""
    if method not in KS_METHODS:
        raise ValueError(f"method must be one of {', '.join(KS_METHODS)}")
    few = F.when((n_ref < 2) | (n_cur < 2), "too_few")
    if method == "exact":
        few = few.when((n_ref == n_cur) | (n_ref + n_cur <= KS_EXACT_ROWS), "exact")
    return few.otherwise("stephens")


def ks_pvalue(d: Column, n_ref: Column, n_cur: Column, method: str = "stephens") -> Column:
    """Two-sided p-value from the Kolmogorov series with Stephens' (1970) small-sample
    argument. With ``method="exact"`` samples of one size get the exact value, and so do
    others of up to KS_EXACT_ROWS rows together."""
    product = n_ref.cast("double") * n_cur
    size = F.nullif(F.sqrt(product / F.nullif(n_ref + n_cur, F.lit(0))), F.lit(0.0))
    chosen = ks_method(n_ref, n_cur, method)
    lam = d * (size + 0.12 + 0.11 / size)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )

    def clamped(p: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

    exact = _ks_equal_sizes(d, n_ref)
    if method == "exact":
        small = (n_ref != n_cur) & (chosen == "exact")
        walked = F.pandas_udf(_ks_lattice, "double")(
            F.when(small, d), F.when(small, n_ref).cast("long"), F.when(small, n_cur).cast("long")
        )
        exact = F.when(n_ref == n_cur, exact).otherwise(walked)
    return (
        F.when(chosen == "too_few", 1.0)
        .when(chosen == "exact", clamped(exact))
        .when(lam < 0.2, 1.0)
        .otherwise(clamped(series))
    )


def _ks_equal_sizes(d: Column, n: Column) -> Column:
    """Exact tail for two samples of n values (Gnedenko and Korolyuk, 1951): with
    h = n * d, twice the alternating sum over j of C(2n, n - j h) / C(2n, n).

    The ratio of binomials is a product of j * h factors. Terms fall like
    exp(-j^2 h^2 / n), so few of them matter.
    """
    h = F.greatest(F.round(d * n), F.lit(1.0)).cast("bigint")
    enough = F.ceil(F.sqrt(F.lit(KS_EXACT_DEPTH) * n) / h)
    last = F.greatest(F.least(F.floor(n / h), enough), F.lit(1).cast("bigint"))

    def log_ratio(steps: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1).cast("bigint"), steps),
            F.lit(0.0),
            lambda total, i: total + F.ln((n - steps + i) / (n + i)),
        )

    total = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), last),
        F.lit(0.0),
        lambda total, j: total
        + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(log_ratio(j * h)),
    )
    return F.when(d <= 0, 1.0).otherwise(total)


def lattice_tail(d: float, n: int, m: int) -> float:
    """Probability that the distribution functions of samples of n and m values, drawn from
    one continuous distribution, are d or more apart somewhere.

    The merged samples are a path of n + m steps, all orders alike. Diagonal by diagonal,
    the paths that have stayed inside the band around equal shares carry their probability
    on, and what steps over its edge is added up; every term is positive, so a small tail
    keeps its digits. Work is n + m times the width of the band.
    """
    least = max(1, round(d * n * m))
    inside = np.ones(1)  # by values drawn from the first sample, from ``low`` on
    low, tail = 0, 0.0
    for step in range(n + m):
        i = np.arange(low, low + len(inside))
        up = inside * (n - i) / (n + m - step)
        stay = inside * (m - (step - i)) / (n + m - step)
        inside = np.append(stay, 0.0)
        inside[1:] += up
        i = np.arange(low, low + len(inside))
        out = np.abs(i * m - (step + 1 - i) * n) >= least
        tail += float(inside[out].sum())
        kept = np.flatnonzero(~out)
        if not len(kept):
            return tail
        # The band is one run of places.
        inside, low = inside[kept[0] : kept[-1] + 1], low + int(kept[0])
    return tail


def _ks_lattice(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """``lattice_tail`` of one row per feature; NULL where it is not asked for."""
    return pd.Series(
        [
            None if pd.isna(x) or pd.isna(a) else 1.0 if x <= 0 else lattice_tail(float(x), int(a), int(b))
            for x, a, b in zip(d, n, m)
        ],
        dtype="float64",
    )


def _erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: power series up to 2, continued
    fraction beyond. Spark has no built-in; this keeps the result off Python."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERFC_TERMS)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda s, k: F.struct(
            (s["term"] * 2.0 * z * z / (2.0 * k + 1.0)).alias("term"),
            (s["total"] + s["term"] * 2.0 * z * z / (2.0 * k + 1.0)).alias("total"),
        ),
        lambda s: s["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(ERFC_TERMS), F.lit(1), F.lit(-1)),
        z,
        lambda below, k: z + (k / 2.0) / below,
    )
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 2.0, 1.0 - 2.0 * scale * series).otherwise(scale / fraction)


def chi2_pvalue(statistic: Column, dof: Column) -> Column:
    """P(X > statistic) for a chi-square variable with whole degrees of freedom.

    The tail is a finite sum that starts from the tail at one or two degrees of
    freedom; its terms run in logs so that many degrees of freedom do not overflow.
    """
    half = F.when(statistic > 0, statistic / 2.0)
    odd = dof % 2 == 1
    log_first = F.when(odd, 0.5 * F.ln(half) - half - math.lgamma(1.5)).otherwise(-half)
    shift = F.when(odd, 0.5).otherwise(0.0)
    steps = F.when(odd, F.floor((dof - 1) / 2)).otherwise(F.floor(dof / 2)).cast("int")
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(log_first.alias("log"), F.lit(0.0).alias("total")),
        lambda s, k: F.struct(
            (s["log"] + F.ln(half) - F.ln(k + shift)).alias("log"),
            (s["total"] + F.exp(s["log"])).alias("total"),
        ),
        lambda s: s["total"],
    )
    start = F.when(odd, _erfc(F.sqrt(half))).otherwise(0.0)
    return (
        F.when((dof < 1) | (statistic <= 0), 1.0)
        .when(statistic.isNotNull(), F.least(F.lit(1.0), start + summed))
    )
