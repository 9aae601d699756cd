"""Drift over a stream: one check per micro-batch, or counts per event-time window."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.bins import bin_index
from plumbline.functions.columns import col, to_numeric
from plumbline.functions.stats import psi_band, psi_term
from plumbline.operators.drift import FrozenReference, freeze_reference
from plumbline.plans.check import evaluate_pair
from plumbline.sources.shared import short_lived
from plumbline.spec import Baseline, DriftPolicy, Pair


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, glob: str | None = None,
    fmt: str = "parquet", **options: str,
) -> DataFrame:
    """Files of a folder as a stream; new files are new batches."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.options(**options).load(folder)


def monitor_stream(
    stream: DataFrame,
    reference: DataFrame,
    baseline: Baseline,
    run_table: str,
    checkpoint: str,
    policy: DriftPolicy = DriftPolicy(),
    trigger: dict | None = None,
    frozen: FrozenReference | None = None,
) -> StreamingQuery:
    """Check every micro-batch against the reference and keep one run row per batch.

    The reference is counted once, when the stream starts, or was before (``frozen``); a
    check reads the batch and those folders of the counts that hold open cells. The copy
    of a batch that its passes read is removed with the verdict. A batch that is run again
    after a failure overwrites its own folder, so the run table holds each batch once.
    """
    if frozen is None:
        frozen = freeze_reference(reference, baseline)

    def check(batch: DataFrame, batch_id: int) -> None:
        with short_lived(batch, "batch") as rows:
            pair = Pair.union(reference, rows)
            _, verdict = evaluate_pair(pair, baseline, policy, frozen)
            verdict.write.mode("overwrite").parquet(f"{run_table}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def windowed_bins(
    stream: DataFrame,
    time: str,
    value: str,
    edges: list[float],
    window: str = "1 day",
    lateness: str = "1 day",
    by: list[str] = (),
) -> DataFrame:
    """Counts per event-time window and baseline bin, for a stream or a table.

    State is windows x bins, whatever the number of events.
    """
    stamped = stream.select(
        col(time).cast("timestamp").alias("_ts"),
        to_numeric(col(value)).alias("_value"),
        *[col(b) for b in by],
    )
    binned = stamped.withColumn("bin", bin_index("_value", edges)).where(F.col("bin").isNotNull())
    if stream.isStreaming:
        binned = binned.withWatermark("_ts", lateness)
    span = F.window("_ts", window)
    return (
        binned.groupBy(span.alias("span"), *[col(b).alias(b) for b in by], "bin")
        .agg(F.count("*").alias("n"))
        .select(F.col("span.start").alias("window_start"), *[col(b) for b in by], "bin", "n")
    )


def closed_window_psi(
    stream: DataFrame,
    time: str,
    value: str,
    edges: list[float],
    reference: dict[int, int],
    window: str = "1 day",
    lateness: str = "1 day",
    by: list[str] = (),
) -> DataFrame:
    """One row per event-time window and group of a stream, when the window closes:
    window_start, the groups, n, psi, psi_band.

    The state of a window is its bin counts; rows reach it as counts of their Arrow batch,
    so a busy window costs a task few rows. A window closes once an event has come from a
    window that begins ``lateness`` after its end; then its row is given, its state dropped,
    and rows that still come for it are dropped too. ``reference`` maps bin to count.
    """
    spans = stream.sparkSession.sql(
        f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {window}) AS w, "
        f"unix_micros(timestamp_micros(0) + INTERVAL {lateness}) AS l"
    ).first()
    bins = sorted(reference)
    names = [f"by{k}" for k in range(len(by))]
    span = F.window("_ts", window)
    rows = (
        stream.select(
            col(time).cast("timestamp").alias("_ts"),
            to_numeric(col(value)).alias("_value"),
            *[col(b).alias(n) for b, n in zip(by, names)],
        )
        .withColumn("bin", bin_index("_value", edges))
        .where(F.col("bin").isNotNull() & F.col("_ts").isNotNull())
        .select(F.unix_micros(span["start"]).alias("start"), *names, "bin")
    )
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{n} {kinds[n]}" for n in ["start", *names])
    counted = rows.mapInArrow(_count_batch(["start", *names, "bin"]), f"{keys}, bin int, n bigint")
    # The clock of the stream is the last moment of a row's window.
    stamped = counted.withColumn(
        "_last", F.timestamp_micros(F.col("start") + F.lit(spans["w"] - 1))
    ).withWatermark("_last", f"{spans['w'] + spans['l'] - 1} microseconds")
    closed = stamped.groupBy("start", *names).applyInPandasWithState(
        _close(bins, spans["w"]),
        outputStructType=f"{keys}, counts array<bigint>",
        stateStructType="counts string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    total = sum(reference.values())
    n = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    psi = sum(
        (
            F.coalesce(
                psi_term(F.lit(reference[b]), F.get("counts", F.lit(k)), F.lit(total), F.col("n")),
                F.lit(0.0),
            )
            for k, b in enumerate(bins)
        ),
        F.lit(0.0),
    )
    return (
        closed.withColumn("n", n)
        .select(
            F.timestamp_micros("start").alias("window_start"),
            *[F.col(k).alias(b) for k, b in zip(names, by)],
            "n",
            psi.alias("psi"),
        )
        .withColumn("psi_band", psi_band(F.col("psi")))
    )


def _count_batch(keys: list[str]):
    """How often each key occurs in an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = pa.Table.from_batches([batch]).group_by(keys).aggregate([([], "count_all")])
                counts = counts.select([*keys, "count_all"]).rename_columns([*keys, "n"])
                yield from counts.combine_chunks().to_batches()

    return run


def _close(bins: list[int], window_micros: int):
    """Adds up the counts of a window, and hands them on when it closes."""
    place = {b: k for k, b in enumerate(bins)}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            counts = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame(
                [[*key, counts]],
                columns=["start", *[f"by{k}" for k in range(len(key) - 1)], "counts"],
            )
            return
        counts = json.loads(state.get[0]) if state.exists else [0] * len(bins)
        for part in parts:
            for b, n in zip(part["bin"].tolist(), part["n"].tolist()):
                if b in place:
                    counts[place[b]] += n
        state.update((json.dumps(counts),))
        # A timeout fires once the clock is past it, and the end belongs to the next window.
        state.setTimeoutTimestamp((int(key[0]) + window_micros) // 1000 - 1)

    return run


def write_counts(
    counts: DataFrame,
    path: str,
    checkpoint: str,
    closed_only: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write windowed counts as a table.

    A window is written once, when the watermark has passed it, and its state is dropped:
    the form for an endless stream. Without ``closed_only`` the table is the newest state
    of all windows, open ones included, for a stream that ends. A batch that is run again
    replaces what it wrote.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch_id={batch_id}" if closed_only else path
        batch.write.mode("overwrite").parquet(target)

    return (
        counts.writeStream.outputMode("append" if closed_only else "complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def windowed_psi(counts: DataFrame, reference: dict[int, int], by: list[str] = ()) -> DataFrame:
    """PSI of each window of the counts against the reference's bin counts.

    ``reference`` maps bin to count; the bins a window lacks are filled in from it, so
    the window is one aggregate row with a short array.
    """
    keys = ["window_start", *by]
    bins = sorted(reference)
    total = sum(reference.values())
    per_bin = [
        F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).alias(f"b{b}")
        for b in bins
    ]
    rows = counts.groupBy(*[col(k).alias(k) for k in keys]).agg(F.sum("n").alias("n"), *per_bin)

    def term(b: int) -> Column:
        return psi_term(F.lit(reference[b]), F.col(f"b{b}"), F.lit(total), F.col("n"))

    psi = sum((F.coalesce(term(b), F.lit(0.0)) for b in bins), F.lit(0.0))
    return rows.select(*[col(k) for k in keys], "n", psi.alias("psi")).withColumn(
        "psi_band", psi_band(F.col("psi"))
    )
