"""Best-fit packing of documents into sequences, under conflicts.

Rows are dealt by a hash of what they hold and of a number among equal ones into groups of
bounded size, so neither a source nor a cluster of copies gathers in one task, and the same
documents are packed alike on any cluster. Each group is packed on its own. Inside a group the
pieces come in descending length. Open bins are ordered by what is left in them and carry
a bitmap of their sources and duplicate clusters; the search starts at the smallest
residual that is enough and goes on to the next larger one until a bin is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.sources.shared import counted

CAPACITY = 2048
GROUP_ROWS = 4096
BYTES_PER_TOKEN = 4
# Equal rows that are unfolded at a time.
COPIES = 1024

_BIN_BITS = 24


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes over BYTES_PER_TOKEN, rounded up, and one for the separator."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return F.ceil(size / BYTES_PER_TOKEN).cast("bigint") + 1


def _bits(*columns: list) -> list[int]:
    """A bitmap per row: one bit for each source or cluster that the row shares with
    another row. NULL conflicts with nothing."""
    maps, bit = [0] * len(columns[0]), 0
    for column in columns:
        counts = Counter(x for x in column if x is not None)
        bits = {}
        for k, x in enumerate(column):
            if x is not None and counts[x] > 1:
                if x not in bits:
                    bits[x] = 1 << bit
                    bit += 1
                maps[k] |= bits[x]
    return maps


def best_fit(
    lengths: list[int], bitmaps: list[int], capacity: int
) -> list[tuple[int, int]]:
    """(bin, offset) of each item, taken in the given order."""
    residuals: list[int] = []  # that some bin has, ascending
    open_bins: dict[int, list[int]] = {}  # by residual, oldest first
    held: list[int] = []  # bitmap of each bin
    placed = []
    for length, own in zip(lengths, bitmaps):
        found = None
        at = bisect_left(residuals, length)
        while found is None and at < len(residuals):
            left = residuals[at]
            for k, b in enumerate(open_bins[left]):
                if not held[b] & own:
                    found = b
                    open_bins[left].pop(k)
                    if not open_bins[left]:
                        del open_bins[left]
                        residuals.pop(at)
                    break
            at += 1
        if found is None:
            found, left = len(held), capacity
            held.append(0)
        held[found] |= own
        rest = left - length
        placed.append((found, capacity - left))
        if rest:
            if rest not in open_bins:
                open_bins[rest] = []
                insort(residuals, rest)
            open_bins[rest].append(found)
    return placed


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True])

        def plain(name):
            return [None if pd.isna(x) else x for x in rows[name]]

        lengths = rows["n_tokens"].tolist()
        placed = best_fit(lengths, _bits(*map(plain, ("source", "cluster", "near"))), capacity)
        bins = pd.Series([b for b, _ in placed], index=rows.index, dtype="int64")
        fill = rows["n_tokens"].groupby(bins).transform("sum")
        return rows.assign(
            bin_id=rows["pack"] * (1 << _BIN_BITS) + bins,
            bin_offset=[o for _, o in placed],
            bin_tokens=fill,
        )[["id", "piece", "n_tokens", "source", "bin_id", "bin_offset", "bin_tokens"]]

    return run


def _numbered(items: DataFrame) -> DataFrame:
    """The rows with a key ``row`` made of what they hold and of a number among equal rows.

    Equal rows are counted, which combines them before the shuffle, and come back in runs
    of COPIES that are dealt out before they are unfolded.
    """
    columns = items.columns
    runs = items.groupBy(*columns).agg((F.count("*") - 1).alias("last")).select(
        *columns,
        "last",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / COPIES))).alias("run"),
    )
    first = F.col("run") * COPIES
    return (
        runs.repartition(*columns, "run")
        .select(
            *columns,
            F.explode(F.sequence(first, F.least("last", first + COPIES - 1))).alias("copy"),
        )
        .select(*columns, F.xxhash64(*columns, "copy").alias("row"))
    )


def packed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    length: Column | None = None,
    cluster: Column | None = None,
    near: DataFrame | None = None,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id, piece, n_tokens, source, bin_id, bin_offset, bin_tokens) of every piece.

    A bin holds ``capacity`` tokens, and no two documents of one source or one cluster. A
    document longer than a bin is cut into pieces that fill a bin each, and a rest that is
    packed like a document. ``length`` defaults to ``token_estimate``, ``cluster`` to the
    digest of the text, so copies never share a bin. ``near`` is a table (id, component_id) of
    near copies, which share none either; ids it doesn't name have none. Source, cluster and text may be NULL,
    which conflicts with nothing; an empty text takes one token and is in no cluster; a row
    without length takes one token. Repeated rows are placed one by one. No rows give no rows.
    """
    text = col(text_column)
    length = token_estimate(text) if length is None else length
    cluster = F.when(text != "", F.xxhash64(text)) if cluster is None else cluster
    items = docs.select(
        col(id_column).cast("bigint").alias("id"),
        col(source_column).cast("string").alias("source"),
        cluster.alias("cluster"),
        F.greatest(F.coalesce(length.cast("bigint"), F.lit(1)), F.lit(1)).alias("whole"),
    )
    if near is None:
        items = items.withColumn("near", F.lit(None).cast("bigint"))
    else:
        named = near.select(
            col(id_column).cast("bigint").alias("id"), F.col("component_id").alias("near")
        )
        named = named.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("near").alias("near"))
        items = items.join(named, "id", "left")
    items, n_items = counted(
        _numbered(items)
        .withColumn(
            "piece",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("whole") / capacity) - 1)),
        )
        .withColumn("n_tokens", F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)))
        .drop("whole"),
        "pieces",
    )
    n_groups = max(1, -(-n_items // group_rows))
    return (
        items.withColumn("pack", F.pmod(F.xxhash64("row", "piece"), F.lit(n_groups)).cast("bigint"))
        .groupBy("pack")
        .applyInPandas(
            _pack(capacity),
            "id bigint, piece bigint, n_tokens bigint, source string, "
            "bin_id bigint, bin_offset bigint, bin_tokens bigint",
        )
        .withColumnRenamed("id", id_column)
    )
