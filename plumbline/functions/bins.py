"""Bin index of a value among fixed edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted


def bin_index(column: str, edges: list[float], open_ended: bool = False) -> Column:
    """0-based bin of a numeric column: half-open bins, the last one closed, NULL
    outside the edges.

    With ``open_ended`` the outer bins also take what lies beyond them. Written as a sum
    of comparisons, which stays inside generated code.
    """
    c = quoted(column)
    index = " + ".join(f"CAST({c} >= {edge!r}D AS INT)" for edge in map(float, edges[1:-1])) or "0"
    inside = f"{c} >= {float(edges[0])!r}D AND {c} <= {float(edges[-1])!r}D"
    if open_ended:
        inside = f"{c} IS NOT NULL"
    return F.expr(f"CASE WHEN {inside} THEN {index} END")


def among(column: str, numbers: list[int]) -> Column:
    """Is an integer column one of the numbers? Consecutive ones become ranges."""
    runs: list[list[int]] = []
    for n in sorted(numbers):
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    c = quoted(column)
    single = [str(a) for a, b in runs if a == b]
    tests = [f"{c} BETWEEN {a} AND {b}" for a, b in runs if a < b]
    if len(tests) > 50:
        single, tests = [str(n) for n in sorted(numbers)], []
    if single:
        tests.append(f"{c} IN ({', '.join(single)})")
    return F.expr(" OR ".join(tests))
