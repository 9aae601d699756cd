"""Shapes shared by the operators: long form and small literal tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted

# Rows from which another task is worth its start, and rows that one should not exceed.
LEAST_ROWS = 50_000
MOST_ROWS = 500_000
# Times the shortest possible wait for the last task at which rows are dealt again.
UNEVEN = 1.5


def melt(df: DataFrame, parts: Mapping[str, Mapping[str, Column]], keep: Iterable[str] = ()) -> DataFrame:
    """One row per (input row, feature): ``feature`` plus the columns of its part.

    An unpivot, not a union: the input is scanned once, only the named columns are
    read, and the expansion stays inside generated code.
    """
    structs = [
        F.struct(*[c.alias(n) for n, c in part.items()]).alias(name)
        for name, part in parts.items()
    ]
    fields = list(next(iter(parts.values())))
    keep = list(keep)
    return (
        df.select(*keep, *structs)
        .unpivot(keep, [quoted(n) for n in parts], "feature", "_part")
        .select(*keep, "feature", *[F.col("_part." + f) for f in fields])
    )


def small_frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows the driver already holds (edges, cut points, per-feature counts)."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for f in frames for c in f.columns])


def feature_frame(spark: SparkSession, features: Iterable[str]) -> DataFrame:
    return small_frame(
        spark, [(f,) for f in features], pa.schema([("feature", pa.string())])
    )


def spread_evenly(df: DataFrame, n_rows: int) -> DataFrame:
    """The rows in partitions of one size, the same number for each slot of the cluster.

    For work that goes over them many times: a scan has no more busy tasks than its files
    have row groups, on any number of machines. Few rows stay as they are, and so do those
    whose partitions keep the slots about as busy; their sizes cost a table its footers.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    turns = max(1, math.ceil(n_rows / (slots * MOST_ROWS)))
    parts = min(slots * turns, math.ceil(n_rows / LEAST_ROWS))
    if parts <= 1:
        return df
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    busy, largest = sizes.agg(F.count("*"), F.max("n")).first()
    if busy and math.ceil(busy / slots) * largest <= UNEVEN * n_rows / min(slots, parts):
        return df
    return df.repartition(parts)
