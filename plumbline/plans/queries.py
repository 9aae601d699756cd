"""Registered queries: every operator bound to the given tables.

Each takes (spark, folder of the tables) and returns a DataFrame over whole tables.
Doubles are rounded to six places, so that other engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import positive_label, to_numeric
from plumbline.functions.stats import interpret_pvalue, psi_band
from plumbline.operators import drift, ledger, metrics, report, split, summary, training
from plumbline.operators.categories import add_positions, category_index
from plumbline.operators.fingerprint import file_fingerprints, row_digest, table_fingerprint
from plumbline.operators.frames import spread_evenly
from plumbline.operators.policy import alert_payloads, apply_policy
from plumbline.operators.promotion import replay_promotions
from plumbline.operators.quantiles import edge_rows, fit_baseline, quantile_edges
from plumbline.operators.sequence import number_rows, previous_row, running_max_before
from plumbline.operators.sketches import (
    distinct_error,
    merged,
    rank_error,
    sketch_parts,
    sketched_categorical_profile,
    sketched_numeric_profile,
    sketched_quantiles,
    store_parts,
    stored_parts,
)
from plumbline.plans import models
from plumbline.plans.check import evaluate_pair, run_drift_check
from plumbline.plans.retrain import Ledgers, run_retrain, score_with_production
from plumbline.sources.baselines import fit_or_load_baseline
from plumbline.sources.shared import new_folder
from plumbline.sources.tables import (
    append_rows,
    clean_markers,
    drop_incomplete,
    read_csv,
    read_csv_checked,
    require_columns,
    select_features,
    write_windows,
)
from plumbline.spec import DriftPolicy, FeatureSpec, Pair
from plumbline.streaming.drift import (
    closed_window_psi,
    file_stream,
    monitor_stream,
    windowed_bins,
    windowed_psi,
    write_counts,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_CATEGORICAL = ("l_returnflag", "l_linenumber")
LINE = FeatureSpec(LINE_NUMERIC, LINE_CATEGORICAL)


def query(function: Query) -> Query:
    """Register under the function's name; ``_query`` at its end only avoids a clash."""
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def line_pair(spark: SparkSession, folder: str) -> Pair:
    """Line items shipped before 1998 against later ones."""
    before = F.col("l_shipdate") < _day("1998-01-01")
    return Pair.of(table(spark, folder, "lineitem"), before, ~before)


def shifted_pair(spark: SparkSession, folder: str) -> Pair:
    """Line items shipped before 1998 against all large ones; the two overlap."""
    return Pair.of(
        table(spark, folder, "lineitem"),
        F.col("l_shipdate") < _day("1998-01-01"),
        F.col("l_quantity") >= 20,
    )


def order_pair(spark: SparkSession, folder: str) -> Pair:
    before = F.col("o_orderdate") < _day("1998-01-01")
    return Pair.of(table(spark, folder, "orders"), before, ~before)


def event_pair(spark: SparkSession, folder: str) -> Pair:
    before = F.col("ts") < _day("2024-01-16")
    return Pair.of(table(spark, folder, "events"), before, ~before)


def document_pair(spark: SparkSession, folder: str) -> Pair:
    """Short documents against long ones."""
    short = F.col("n_chars") < 1000
    return Pair.of(table(spark, folder, "documents"), short, ~short)


def labeled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").drop("text").join(
        table(spark, folder, "labels"), "doc_id"
    )


# --- projections, filters, contracts -----------------------------------------


@query
def clean_markers_query(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority"
    )
    return drop_incomplete(clean_markers(orders, ["4-NOT SPECIFIED"]))


@query
def numeric_coercion(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.lit("orders").alias("source"),
        F.col("o_orderkey").alias("key"),
        to_numeric(F.substring("o_orderpriority", 1, 1)).alias("value"),
    )
    part = table(spark, folder, "part").select(
        F.lit("part").alias("source"),
        F.col("p_partkey").alias("key"),
        to_numeric(F.col("p_name")).alias("value"),
    )
    return orders.unionByName(part)


@query
def feature_contract(spark, folder):
    items = require_columns(
        table(spark, folder, "lineitem"), ["l_orderkey", *LINE.features, "l_shipdate"]
    )
    return select_features(items, LINE)


@query
def slice_shifted(spark, folder):
    large = table(spark, folder, "lineitem").where(F.col("l_quantity") >= 20)
    return large.select(
        "l_orderkey",
        "l_quantity",
        positive_label(F.col("l_returnflag"), "R").alias("label"),
        positive_label(F.col("l_linenumber")).alias("class_label"),
    )


# --- splits --------------------------------------------------------------------


@query
def hash_split(spark, folder):
    return split.hash_split(table(spark, folder, "orders"), "o_orderkey").select(
        "o_orderkey", "side"
    )


@query
def split_semi_join(spark, folder):
    orders = table(spark, folder, "orders")
    chosen = split.hash_split(orders, "o_orderkey").where(F.col("side") == "ref")
    return split.rows_of_split(orders, chosen.select("o_orderkey"), "o_orderkey").select(
        "o_orderkey", "o_totalprice", "o_orderstatus"
    )


@query
def stratified_split(spark, folder):
    return split.stratified_holdout(
        labeled_documents(spark, folder), "quality", "doc_id"
    ).select("doc_id", "quality", "is_holdout")


@query
def labeled_split(spark, folder):
    """Both sides of a random split with their labels, as one table."""
    pair = split.random_pair(labeled_documents(spark, folder), "doc_id")
    reference, current = split.labeled_sides(pair, "quality")
    columns = ["doc_id", "n_chars", "quality"]
    return reference.select(*columns, F.lit("ref").alias("side")).unionByName(
        current.select(*columns, F.lit("cur").alias("side"))
    )


@query
def incoming_batch(spark, folder):
    """Late orders arrive as CSV files and are compared with the reference slice."""
    orders = table(spark, folder, "orders")
    schema = "o_orderkey bigint, o_orderstatus string, o_orderpriority string"
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    arrival = new_folder(spark, "incoming")
    late = orders.where(F.col("o_orderdate") >= _day("1998-01-01")).select(*columns)
    late.write.option("header", True).csv(arrival)
    batch = read_csv(spark, arrival, schema, required=columns)
    pair = split.incoming_pair(orders, batch, "o_orderkey")
    return rounded(drift.categorical_psi(pair, ("o_orderstatus", "o_orderpriority")), "psi")


@query
def temporal_thirds(spark, folder):
    return split.temporal_windows(table(spark, folder, "events"), "ts", "event_id").select(
        "event_id", "window"
    )


@query
def temporal_thirds_tied(spark, folder):
    """Order dates tie heavily; the order key decides."""
    return split.temporal_windows(
        table(spark, folder, "orders"), "o_orderdate", "o_orderkey"
    ).select("o_orderkey", "window")


@query
def window_pair_psi(spark, folder):
    events = split.temporal_windows(table(spark, folder, "events"), "ts", "event_id")
    parts = []
    for ref, cur in (("D1", "D2"), ("D2", "D3"), ("D1", "D3")):
        pair = split.window_pair(events, ref, cur)
        parts.append(
            drift.categorical_psi(pair, ("event_type",)).withColumn("pair", F.lit(f"{ref}/{cur}"))
        )
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "psi")


@query
def window_profile(spark, folder):
    events = table(spark, folder, "events").withColumn(
        "is_error", (F.col("event_type") == "error").cast("int")
    )
    windows = split.temporal_windows(events, "ts", "event_id")
    text = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rounded(report.window_profile(windows, "window", "is_error", "ts"), "positive_rate").withColumns(
        {"time_min": F.date_format("time_min", text), "time_max": F.date_format("time_max", text)}
    )


# --- sketches kept per day ----------------------------------------------------------

EVENT = FeatureSpec(("value", "user_id"), ("event_type", "user_id"))


def _event_days(spark, folder, first=None, last=None):
    """Sketches of every day of events, those of two days written again, merged."""
    events = table(spark, folder, "events")
    path = new_folder(spark, "sketches")
    day = F.to_date("ts")
    store_parts(sketch_parts(events, EVENT, day), path)
    again = events.where((F.col("ts") >= _day("2024-01-10")) & (F.col("ts") < _day("2024-01-12")))
    store_parts(sketch_parts(again, EVENT, day), path)
    return merged(stored_parts(spark, path, first, last))


@query
def sketched_ranks(spark, folder):
    """Are the deciles merged from days of sketches within the error stated for their ranks?
    Counted over all events."""
    shares = [i / 10 for i in range(11)]
    found = sketched_quantiles(_event_days(spark, folder), shares).collect()
    tests = {}
    for k, r in enumerate(found):
        value = to_numeric(F.col(r["feature"]))
        below, upto = F.avg((value < r["value"]).cast("int")), F.avg((value <= r["value"]).cast("int"))
        within = (below - rank_error() <= r["share"]) & (upto + rank_error() >= r["share"])
        tests[k] = F.struct(
            F.lit(r["feature"]).alias("feature"),
            F.lit(round(10 * r["share"])).cast("bigint").alias("decile"),
            F.count(value).alias("n"),
            within.alias("within_error"),
        )
    counted = table(spark, folder, "events").agg(*[t.alias(f"t{k}") for k, t in tests.items()])
    rows = counted.select(F.explode(F.array(*[f"t{k}" for k in tests])).alias("t"))
    return rows.select("t.*")


@query
def sketched_numbers(spark, folder):
    """What merges exactly, over sixteen of the days."""
    days = _event_days(spark, folder, "2024-01-05", "2024-01-20")
    profile = sketched_numeric_profile(days).join(
        days.where(F.col("kind") == "numeric").select("feature", "n_parts", "n_rows", "n"), "feature"
    )
    kept = ["feature", "n_parts", "n_rows", "n", "mean", "std", "min", "max"]
    return rounded(profile.select(*kept), "mean", "std", "min", "max")


@query
def sketched_categories(spark, folder):
    """Most frequent values over sixteen of the days, and whether the numbers of distinct
    values are within the error stated for them."""
    days = _event_days(spark, folder, "2024-01-05", "2024-01-20")
    events = table(spark, folder, "events").where(
        (F.col("ts") >= _day("2024-01-05")) & (F.col("ts") < _day("2024-01-21"))
    )
    exact = summary.categorical_profile(events, list(EVENT.categorical), 1).select(
        "feature", F.col("n_unique").alias("exact")
    )
    off = F.abs(F.col("n_unique") - F.col("exact")) <= F.ceil(distinct_error() * F.col("exact"))
    return (
        sketched_categorical_profile(days)
        .join(F.broadcast(exact), "feature")
        .select("feature", "value", "n", "position", off.alias("unique_within_error"))
    )


# --- drift statistics ------------------------------------------------------------


@query
def quantile_edges_query(spark, folder):
    reference = line_pair(spark, folder).reference
    return rounded(edge_rows(spark, fit_baseline(reference, LINE_NUMERIC)), "edge")


@query
def fixed_edge_histogram(spark, folder):
    pair = shifted_pair(spark, folder)
    edges = quantile_edges(pair.reference, list(LINE_NUMERIC))
    return drift.bin_counts(pair, edges)


@query
def psi_numeric(spark, folder):
    pair = shifted_pair(spark, folder)
    edges = quantile_edges(pair.reference, list(LINE_NUMERIC))
    psi = drift.numeric_psi(pair, edges).withColumn("psi_band", psi_band(F.col("psi")))
    return rounded(psi, "psi")


@query
def psi_numeric_out_of_range(spark, folder):
    """All current prices lie above the reference range."""
    low = F.col("o_totalprice") < 250_000
    pair = Pair.of(table(spark, folder, "orders"), low, ~low)
    edges = quantile_edges(pair.reference, ["o_totalprice"])
    closed = drift.numeric_psi(pair, edges).withColumn("mode", F.lit("closed"))
    opened = drift.numeric_psi(pair, edges, open_ended=True).withColumn("mode", F.lit("open"))
    return rounded(closed.unionByName(opened), "psi")


@query
def psi_min_rows(spark, folder):
    constant = table(spark, folder, "lineitem").withColumn("constant", F.lit(1.0))
    before = F.col("l_shipdate") < _day("1998-01-01")
    large = report.experiment_psi(
        Pair.of(constant, before, ~before), ("l_quantity", "l_discount", "constant")
    )
    first = F.col("n_regionkey") == 0
    small = report.experiment_psi(
        Pair.of(table(spark, folder, "nation"), first, ~first), ("n_nationkey",)
    )
    return rounded(large.unionByName(small), "psi")


@query
def psi_categorical(spark, folder):
    orders = drift.categorical_psi(order_pair(spark, folder), ("o_orderstatus", "o_orderpriority"))
    events = drift.categorical_psi(event_pair(spark, folder), ("event_type",))
    lines = drift.categorical_psi(shifted_pair(spark, folder), ("l_linenumber", "l_returnflag"))
    return rounded(orders.unionByName(events).unionByName(lines), "psi")


@query
def ks_statistic(spark, folder):
    lines = drift.numeric_drift(shifted_pair(spark, folder), LINE_NUMERIC)
    events = drift.numeric_drift(event_pair(spark, folder), ("value",))
    return rounded(lines.unionByName(events), "ks_statistic")


@query
def ks_pvalue(spark, folder):
    tested = drift.ks_test(drift.numeric_drift(line_pair(spark, folder), LINE_NUMERIC))
    return rounded(
        tested.select(
            "feature",
            "ks_statistic",
            "ks_pvalue",
            "ks_pvalue_method",
            interpret_pvalue(F.col("ks_pvalue")).alias("ks_interpretation"),
        ),
        "ks_statistic",
        "ks_pvalue",
    )


@query
def contingency(spark, folder):
    return drift.category_counts(document_pair(spark, folder), ("source", "lang"))


@query
def rare_merge(spark, folder):
    """Pool sources and languages with fewer than 40 short documents."""
    counts = drift.category_counts(document_pair(spark, folder), ("source", "lang"))
    return drift.pool_rare(counts, 40)


@query
def chi2_homogeneity(spark, folder):
    counts = drift.category_counts(order_pair(spark, folder), ("o_orderstatus", "o_orderpriority"))
    return rounded(drift.chi_square(counts), "chi2_statistic", "chi2_pvalue")


@query
def chi2_yates(spark, folder):
    counts = drift.category_counts(line_pair(spark, folder), ("l_linestatus",))
    return rounded(drift.chi_square(counts).drop("chi2_pvalue"), "chi2_statistic")


def _line_report(spark: SparkSession, folder: str, pair: Pair) -> DataFrame:
    baseline = fit_baseline(pair.reference, LINE_NUMERIC, LINE_CATEGORICAL)
    return report.drift_report(pair, baseline)


def _rounded_report(df: DataFrame) -> DataFrame:
    return rounded(df, "psi", "ks_statistic", "ks_pvalue", "chi2_statistic", "chi2_pvalue")


@query
def drift_report(spark, folder):
    return _rounded_report(_line_report(spark, folder, shifted_pair(spark, folder)))


@query
def drift_summary(spark, folder):
    pair = shifted_pair(spark, folder)
    return rounded(report.report_summary(pair, _line_report(spark, folder, pair)), "mean_psi")


@query
def drift_policy(spark, folder):
    pair = line_pair(spark, folder)
    summary_row = report.report_summary(pair, _line_report(spark, folder, pair))
    strict = DriftPolicy(max_high_psi=0, max_ks=0, max_chi2=0)
    return apply_policy(summary_row, strict).select(
        "n_features_high_psi",
        "n_numeric_ks_significant",
        "n_categorical_chi2_significant",
        F.array_join("trigger_reasons", "; ").alias("reasons"),
        "policy_triggered",
    )


@query
def alert_payload(spark, folder):
    """Two monitors, of which the shifted one triggers."""
    checks = None
    for scenario, make in (("by_date", line_pair), ("shifted", shifted_pair)):
        pair = make(spark, folder)
        one = report.report_summary(pair, _line_report(spark, folder, pair))
        one = one.withColumn("scenario", F.lit(scenario))
        checks = one if checks is None else checks.unionByName(one)
    counts = ["n_reference_rows", "n_current_rows", "n_features_high_psi", "n_numeric_ks_significant"]
    alerts = alert_payloads(apply_policy(checks), "scenario", counts)
    return alerts.select("event", "scenario", "reasons", "summary")


@query
def drift_ranking(spark, folder):
    ranking = report.drift_ranking(shifted_pair(spark, folder), LINE_NUMERIC)
    return rounded(ranking, "psi", "ks_statistic", "ks_pvalue")


@query
def drift_ranking_summary(spark, folder):
    ranking = report.drift_ranking(shifted_pair(spark, folder), LINE_NUMERIC)
    return rounded(report.ranking_summary(ranking), "mean_psi")


# --- profiles ---------------------------------------------------------------------


@query
def profile_numeric(spark, folder):
    parts = [
        summary.numeric_profile(table(spark, folder, name), columns)
        for name, columns in (
            ("customer", ["c_acctbal"]),
            ("part", ["p_retailprice", "p_size"]),
            ("lineitem", ["l_extendedprice", "l_quantity"]),
        )
    ]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(df, "mean", "std", "min", "max", "q05", "q50", "q95")


@query
def profile_categorical(spark, folder):
    parts = [
        summary.categorical_profile(table(spark, folder, name), columns)
        for name, columns in (
            ("customer", ["c_mktsegment", "c_name"]),
            ("part", ["p_brand", "p_type"]),
            ("documents", ["source", "lang"]),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def table_snapshot(spark, folder):
    """The snapshot's JSON, read back into columns."""
    snapshot = summary.table_snapshot(table(spark, folder, "customer"))

    def field(path: str, kind: str):
        return F.get_json_object("profile", path).cast(kind)

    return rounded(
        snapshot.select(
            "feature",
            "kind",
            "n_rows",
            field("$.mean", "double").alias("mean"),
            field("$.q95", "double").alias("q95"),
            field("$.n_unique", "bigint").alias("n_unique"),
            field("$.top_values.BUILDING", "bigint").alias("n_building"),
        ),
        "mean",
        "q95",
    )


# --- training data and evaluation ------------------------------------------------


@query
def training_merge(spark, folder):
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    items = table(spark, folder, "lineitem")
    reference = items.where(F.col("l_shipdate") < _day("1998-01-01")).select(*columns, "l_tax")
    current = items.where(F.col("l_quantity") >= 20).select(*columns)
    return training.merge_training_data(reference, current, "l_returnflag")


@query
def balanced_weights(spark, folder):
    weighted = training.balanced_weights(labeled_documents(spark, folder), "quality")
    return rounded(weighted.select("doc_id", "quality", "weight"), "weight")


@query
def macro_metrics(spark, folder):
    docs = labeled_documents(spark, folder).withColumn(
        "prediction", (F.col("n_chars") >= 1000).cast("int")
    )
    return rounded(
        metrics.macro_metrics(docs, "quality", "prediction"),
        "accuracy",
        "f1_macro",
        "precision_macro",
        "recall_macro",
    )


@query
def binary_metrics(spark, folder):
    docs = labeled_documents(spark, folder)
    found = metrics.binary_metrics(docs, "quality", "n_chars", 1000, ["lang"])
    return rounded(found, "f1", "precision", "recall", "accuracy")


@query
def roc_auc(spark, folder):
    docs = metrics.ranking_metrics(labeled_documents(spark, folder), "quality", "n_chars", ["lang"])
    return rounded(docs.select("lang", "roc_auc"), "roc_auc")


@query
def average_precision(spark, folder):
    items = table(spark, folder, "lineitem").withColumn(
        "returned", positive_label(F.col("l_returnflag"), "R")
    )
    found = metrics.ranking_metrics(items, "returned", "l_extendedprice", ["l_linestatus"])
    return rounded(found, "roc_auc", "pr_auc")


@query
def auc_delta(spark, folder):
    docs = labeled_documents(spark, folder)
    scores = docs.select(
        F.lit("trained_D1").alias("model"), F.lit("D3").alias("eval_set"), "quality",
        F.col("n_chars").cast("double").alias("score"),
    ).unionByName(
        docs.select(
            F.lit("trained_D1+D2").alias("model"), F.lit("D3").alias("eval_set"), "quality",
            (-F.col("n_chars").cast("double")).alias("score"),
        )
    )
    results = metrics.ranking_metrics(scores, "quality", "score", ["model", "eval_set"])
    return rounded(models.metric_delta(results), "base", "adapted", "delta")


def _replay(spark, folder, margin):
    runs = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    replayed = replay_promotions(runs, "user_id", "ts", "event_id", "value", margin)
    return replayed.select("event_id", "champion_before", "promoted", "reason")


@query
def champion_replay(spark, folder):
    return _replay(spark, folder, 0.0)


@query
def champion_replay_margin(spark, folder):
    return _replay(spark, folder, 25.0)


@query
def shifted_split_pair(spark, folder):
    """Reference by hash, current a slice of the whole table."""
    orders = table(spark, folder, "orders")
    pair = split.shifted_pair(orders, "o_orderkey", F.col("o_totalprice") >= 200_000)
    ref, cur = F.col(Pair.IN_REF), F.col(Pair.IN_CUR)
    return pair.frame.agg(
        F.count_if(ref).alias("n_ref"), F.count_if(cur).alias("n_cur"), F.count_if(ref & cur).alias("n_both")
    )


# --- orders cut into many cells ----------------------------------------------------


def _many(df: DataFrame) -> dict:
    """Cells of about a fiftieth of the rows, so that results cross their borders."""
    return {"rows_per_range": max(1, df.count() // 50)}


@query
def numbers_against_the_clock(spark, folder):
    """Events numbered by time, with ids that don't follow it."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", F.md5(F.col("event_id").cast("string")).alias("tie")
    )
    rows = number_rows(events, "ts", "tie", "no", **_many(events))
    return rows.select("event_id", "no")


@query
def numbers_by_instant(spark, folder):
    """The same along instants, reversed."""
    events = table(spark, folder, "events").select(
        "event_id",
        F.timestamp_micros(-F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"),
    )
    return number_rows(events, "at", "event_id", "no", **_many(events)).select("event_id", "no")


@query
def neighbours_by_text(spark, folder):
    """Orders before and after along names with long common beginnings."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.format_string("model-%09d", F.col("o_orderkey") * 7919 % 100_003).alias("name"),
    )
    args = (["o_orderstatus"], "name", "o_orderkey", F.col("o_orderkey"))
    before = previous_row(orders, *args, "before", **_many(orders))
    both = previous_row(before, *args, "after", following=True, derived=True, **_many(orders))
    return both.select("o_orderkey", "before", "after")


@query
def running_max_with_nulls(spark, folder):
    """Highest price so far along an order that is NULL for a third of the orders and one of
    five texts for the others; one key is NULL."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("at"),
    )
    return running_max_before(
        orders, ["status"], "at", "o_orderkey", F.col("o_totalprice"), "best", **_many(orders)
    ).select("o_orderkey", "best")


@query
def windows_with_nulls(spark, folder):
    """Seven windows of orders, those without a time first."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("at")
    )
    return split.temporal_windows(orders, "at", "o_orderkey", 7, **_many(orders)).select(
        "o_orderkey", "window"
    )


@query
def stage_moves_by_text(spark, folder):
    """Illegal moves along ISO times kept as text."""
    events = _stage_events(spark, folder).withColumn("at", F.col("ts").cast("string"))
    moves = ledger.stage_moves(events, "user_id", "at", "event_id", **_many(events))
    return ledger.stage_violations(moves).select("event_id", "from_stage", "stage")


@query
def replay_in_cells(spark, folder):
    """Promotions with a margin over one hot key."""
    events = table(spark, folder, "events").withColumn("key", F.lit("all"))
    rows = replay_promotions(events, "key", "ts", "event_id", "value", 25.0, **_many(events))
    return rows.select("event_id", "champion_before", "promoted", "reason")


@query
def stratified_in_cells(spark, folder):
    """A tenth of each priority; one of them is NULL, another empty text."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").startswith("1"), "")
        .when(~F.col("o_orderpriority").startswith("2"), F.col("o_orderpriority"))
        .alias("label"),
    )
    return split.stratified_holdout(orders, "label", "o_orderkey", 0.1, **_many(orders)).select(
        "o_orderkey", "label", "is_holdout"
    )


# --- fingerprints -------------------------------------------------------------------


@query
def table_fingerprint_query(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"
    )
    return table_fingerprint(orders, ["o_orderstatus"])


@query
def file_fingerprint(spark, folder):
    files = file_fingerprints(spark, folder, "*.parquet")
    return files.withColumn("path", F.substring_index("path", "/", -1))


def _text_hashes(spark, folder, **options):
    """Priorities of 500 orders to a text file, and the hash of each file."""
    target = new_folder(spark, "texts")
    part = F.floor(F.col("o_orderkey") / 500).alias("part")
    lines = table(spark, folder, "orders").select(part, "o_orderkey", "o_orderpriority")
    rows = lines.repartition("part").sortWithinPartitions("part", "o_orderkey")
    rows.drop("o_orderkey").write.partitionBy("part").text(target)
    return file_fingerprints(spark, target, "*.txt", **options).select(
        F.regexp_extract("path", "part=(\\d+)", 1).cast("bigint").alias("part"), "length", "content_hash"
    )


@query
def text_file_fingerprint(spark, folder):
    """Files as rows of Spark's reader."""
    return _text_hashes(spark, folder)


@query
def streamed_file_fingerprint(spark, folder):
    """The same files in pieces, as files beyond the size of a row are read."""
    return _text_hashes(spark, folder, whole_below=1)


@query
def csv_malformed(spark, folder):
    """Orders as lines of text, some of them short, long or with a word for a price."""
    key = F.col("o_orderkey")
    fields = [key.cast("string"), F.col("o_orderpriority")]
    price = F.when(key % 13 == 0, "abc").otherwise(key.cast("string"))
    line = (
        F.when(key % 7 == 0, F.concat_ws(",", *fields))
        .when(key % 11 == 0, F.concat_ws(",", *fields, price, F.lit("more")))
        .otherwise(F.concat_ws(",", *fields, price))
    )
    target = new_folder(spark, "lines")
    table(spark, folder, "orders").select(line.alias("o_orderkey,priority,price")).write.option(
        "header", True
    ).option("quote", "").option("sep", "\x01").csv(target)
    good, malformed = read_csv_checked(
        spark, target, "o_orderkey bigint, priority string, price double"
    )
    return good.select(
        F.lit("good").alias("kind"), "o_orderkey", F.concat_ws("|", "priority", "price").alias("held")
    ).unionByName(
        malformed.select(
            F.lit("malformed").alias("kind"),
            F.split("line", ",")[0].cast("bigint").alias("o_orderkey"),
            F.col("line").alias("held"),
        )
    )


# --- ledgers -------------------------------------------------------------------------


def _texts(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("content_hash")
    )


@query
def register_datasets(spark, folder):
    """Texts of all roles arrive after those of the users were registered."""
    texts = _texts(spark, folder)
    known = ledger.register_new(
        texts.where(F.col("role") == "user"), "content_hash", "conv_id", "turn"
    )
    return ledger.register_new(texts, "content_hash", "conv_id", "turn", known)


@query
def register_baselines(spark, folder):
    """Baselines deduplicated by content and linked to the dataset of their source."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.sha2("source", 256).alias("dataset_hash"),
        F.sha2("text", 256).alias("content_hash"),
        "n_chars",
    )
    datasets = ledger.register_new(
        docs.select(F.col("dataset_hash").alias("content_hash"), "doc_id"),
        "content_hash", "doc_id", "doc_id",
    )
    snapshots = ledger.register_new(docs, "content_hash", "doc_id", "doc_id")
    linked = ledger.resolve_ids(
        snapshots.select(
            F.col("id").alias("snapshot_id"),
            F.col("content_hash").alias("snapshot_hash"),
            F.col("dataset_hash").alias("content_hash"),
            "doc_id",
        ),
        "content_hash",
        datasets,
    )
    return linked.select("snapshot_id", "snapshot_hash", "doc_id", F.col("id").alias("dataset_id"))


def _training_runs(spark, folder):
    return replay_promotions(
        table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value"),
        "user_id", "ts", "event_id", "value",
    )


def _experiments(runs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return ledger.experiment_rows(
        runs, "ts", "event_id",
        name=F.concat(F.lit("retrain_"), F.col("event_type")),
        params={"dataset": F.col("user_id"), "primary_metric": F.lit("f1_macro")},
        metrics={"f1_macro": F.col("value")},
        scenario=F.col("event_type"),
        notes=F.col("reason"),
        ledger=known,
    )


@query
def experiments(spark, folder):
    rows = _experiments(_training_runs(spark, folder))
    return rows.select(
        "id", "name", F.col("params")["dataset"].alias("dataset"),
        F.col("metrics")["f1_macro"].alias("f1_macro"), "scenario", "notes",
    )


@query
def model_versions(spark, folder):
    runs = _training_runs(spark, folder)
    rows = ledger.model_rows(
        _experiments(runs), runs, "event_id",
        F.concat(F.lit("models/"), F.col("run_key").cast("string")),
    )
    return rows.select("id", "version_num", "experiment_id", "artifact_path", "stage")


@query
def model_versions_appended(spark, folder):
    """Models of a second batch of runs, after those of the first are in the ledgers."""
    runs = _training_runs(spark, folder)
    first = runs.where(F.col("event_id") % 3 == 0)
    known = _experiments(first)
    # The ledger's ids begin at 101, so ids and versions differ.
    models = ledger.model_rows(
        known, first, "event_id", F.lit("models/first"), spark.range(100, 101).select(
            "id", F.lit(0).cast("bigint").alias("version_num")
        ),
    )
    later = runs.where(F.col("event_id") % 3 != 0)
    rows = ledger.model_rows(
        _experiments(later, known), later, "event_id",
        F.concat(F.lit("models/"), F.col("run_key").cast("string")), models,
    )
    return rows.select("id", "version_num", "experiment_id", "artifact_path", "stage")


@query
def refused_rows(spark, folder):
    """Orders that a ledger of finished orders and of customers in credit must refuse."""
    orders = table(spark, folder, "orders")
    finished = orders.where(F.col("o_orderstatus") == "F")
    customers = table(spark, folder, "customer").where(F.col("c_acctbal") > 0)
    return ledger.refusals(
        orders.where(F.col("o_orderpriority") != "1-URGENT"), finished,
        ("o_orderkey", "o_custkey"), {"o_custkey": (customers, "c_custkey")},
    )


@query
def duplicate_versions(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("user_id", "version_num")
    return ledger.duplicate_versions(events)


@query
def version_numbers(spark, folder):
    """Orders numbered by date after 1000 existing versions."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    numbered = ledger.assign_ids(
        orders, "o_orderdate", "o_orderkey",
        spark.range(1, 1001).withColumnRenamed("id", "version_num"), "version_num",
    )
    return numbered.select("o_orderkey", "version_num")


@query
def lineage(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = ledger.lineage(
        items, {"l_orderkey": (orders, "o_orderkey"), "o_custkey": (customers, "c_custkey")}
    )
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", "o_orderstatus", "c_mktsegment")


@query
def lineage_orphans(spark, folder):
    items = table(spark, folder, "lineitem")
    finished = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    suppliers = table(spark, folder, "supplier").where(F.col("s_acctbal") > 0)
    return ledger.orphans(
        items, {"l_orderkey": (finished, "o_orderkey"), "l_suppkey": (suppliers, "s_suppkey")}
    )


def _stage_events(spark, folder):
    """Event types as stages of the model a user stands for."""
    kind = F.col("event_type")
    stage = (
        F.when(kind.isin("click", "view"), ledger.STAGING)
        .when(kind == "purchase", ledger.PRODUCTION)
        .when(kind == "error", ledger.ARCHIVED)
        .otherwise(ledger.DEVELOPMENT)
    )
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", stage.alias("stage"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("dataset"),
    )


@query
def stage_violations(spark, folder):
    moves = ledger.stage_moves(_stage_events(spark, folder), "user_id", "ts", "event_id")
    return ledger.stage_violations(moves).select(
        "event_id", "user_id", "from_stage", "stage", "allowed"
    )


@query
def stage_current(spark, folder):
    return ledger.current_stages(
        _stage_events(spark, folder), "user_id", "ts", "event_id"
    ).select("user_id", "event_id", "stage")


@query
def models_by_stage(spark, folder):
    latest = ledger.current_stages(_stage_events(spark, folder), "user_id", "ts", "event_id")
    versioned = latest.withColumnRenamed("user_id", "version_num")
    return ledger.models_in_stage(versioned, ledger.PRODUCTION).select("version_num", "event_id")


@query
def model_lookup(spark, folder):
    """The model that the dearest line item names."""
    items = table(spark, folder, "lineitem")
    wanted = items.agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey"))).first()[0]
    rows = items.select(F.col("l_partkey").alias("id")).distinct()
    return ledger.model_by_id(
        rows.withColumn("artifact", F.concat(F.lit("v"), F.col("id").cast("string"))), wanted
    )


@query
def production_pointer(spark, folder):
    spans = ledger.production_history(
        _stage_events(spark, folder), "dataset", "user_id", "ts", "event_id"
    )
    text = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return spans.select(
        "dataset", "model", F.date_format("since", text).alias("since"),
        F.date_format("until", text).alias("until"), "is_current",
    )


@query
def recent_runs(spark, folder):
    runs = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    return ledger.newest(runs, 20, "event_id")


@query
def run_stats(spark, folder):
    return ledger.run_stats(table(spark, folder, "events"), F.col("event_type") == "error")


@query
def overview(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("policy_triggered")
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("version_num")
    )
    pointer = table(spark, folder, "lineitem").agg(
        F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("id")
    )
    return ledger.overview(
        events, parts,
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")),
        table(spark, folder, "documents").select(F.col("doc_id").alias("id")),
        table(spark, folder, "customer").select(F.col("c_custkey").alias("id")),
        pointer,
    )


# --- sources and workflows --------------------------------------------------------------


@query
def csv_scan_roundtrip(spark, folder):
    """Orders exported by window as CSV and read back with contract and cleanup."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    windows = split.temporal_windows(table(spark, folder, "orders"), "o_orderdate", "o_orderkey")
    target = new_folder(spark, "windows")
    write_windows(windows.select(*columns, "window"), target)
    schema = (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderpriority string, window string"
    )
    return read_csv(spark, target, schema, required=[*columns, "window"])


@query
def baseline_roundtrip(spark, folder):
    """PSI over a baseline that was stored and read back."""
    pair = shifted_pair(spark, folder)
    path = new_folder(spark, "baseline")
    fit_or_load_baseline(pair.reference, path, LINE)
    stored = fit_or_load_baseline(pair.current, path, LINE)
    return rounded(drift.numeric_psi(pair, stored.edges), "psi")


@query
def check_to_ledger(spark, folder):
    """One whole check, appended to a run table and read back."""
    runs = new_folder(spark, "runs")
    run_drift_check(
        spark, shifted_pair(spark, folder), LINE, "shifted", run_table=runs
    )
    return spark.read.parquet(runs).select(
        "scenario",
        "policy_triggered",
        F.array_join("trigger_reasons", "; ").alias("reasons"),
        F.col("summary")["n_reference_rows"].alias("n_reference_rows"),
        F.col("summary")["n_current_rows"].alias("n_current_rows"),
        F.col("summary")["n_features_high_psi"].alias("n_features_high_psi"),
    )


@query
def check_with_hook(spark, folder):
    """A whole check whose hook appends what it was told to a table."""
    told = new_folder(spark, "hook")

    def note(result) -> None:
        row = [(result.scenario, result.triggered, "; ".join(result.reasons), result.summary["n_reference_rows"])]
        schema = "scenario string, triggered boolean, reasons string, n_reference bigint"
        append_rows(spark.createDataFrame(row, schema), told)

    run_drift_check(spark, shifted_pair(spark, folder), LINE, "shifted", hooks=[note])
    return spark.read.parquet(told)


ITEM_MODEL = FeatureSpec(
    ("l_quantity", "l_extendedprice", "l_discount"), ("l_linestatus",), target="l_returnflag"
)
DOC_MODEL = FeatureSpec(("n_chars",), ("lang",), target="quality")


@query
def gbt_holdout(spark, folder):
    """Boosted trees on a stratified split of all line items; equal items share a side."""
    items = table(spark, folder, "lineitem")
    # Before the digests, which take longer than all else until the trees.
    items = spread_evenly(items, items.count())
    trained = models.train_and_evaluate(
        items.withColumn("item", row_digest(items)), ITEM_MODEL, "item", needle="R"
    )
    return spark.createDataFrame([trained.metrics], ", ".join(f"{m} double" for m in trained.metrics))


@query
def lr_forward_eval(spark, folder):
    """Is an event a purchase? Trained on early windows, tested on later ones."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", "value", F.hour("ts").alias("hour"),
        (F.col("event_type") == "purchase").cast("int").alias("bought"),
    )
    windows = split.temporal_windows(events, "ts", "event_id")
    spec = FeatureSpec(("value", "hour"), target="bought", time="ts")
    results = models.forward_evaluation(windows, spec)
    return rounded(results, *[c for c in results.columns if c not in ("model", "eval_set")])


@query
def lr_one_feature(spark, folder):
    """Coefficient and intercept of a balanced logistic model of early purchases."""
    events = table(spark, folder, "events").where(F.col("ts") < _day("2024-01-16")).select(
        "value", (F.col("event_type") == "purchase").cast("int").alias("bought")
    )
    spec = FeatureSpec(("value",), target="bought")
    fitted = models.fit_logistic(models.model_frame(events, spec), spec).stages[-1]
    return spark.createDataFrame(
        [(round(float(fitted.coefficients[0]), 4), round(fitted.intercept, 4))],
        "coefficient double, intercept double",
    )


@query
def holdout_counts(spark, folder):
    """Rows of each class on both sides of the split that training uses."""
    items = table(spark, folder, "lineitem")
    frame = models.model_frame(
        items.withColumn("item", row_digest(items)), ITEM_MODEL, "R", keep=("item",)
    )
    return (
        split.stratified_holdout(frame, models.LABEL, "item")
        .groupBy(F.col(models.LABEL).cast("int").alias("label"))
        .agg(
            F.count_if(~F.col("is_holdout")).alias("n_train"),
            F.count_if("is_holdout").alias("n_test"),
        )
    )


@query
def category_vocabulary(spark, folder):
    """Every customer, priority and status of the orders, by falling number of orders."""
    orders = table(spark, folder, "orders")
    features = ("o_custkey", "o_orderpriority", "o_orderstatus")
    return category_index(orders, features, **_many(orders))


@query
def category_positions(spark, folder):
    """Places of the categories of all orders in a vocabulary of the early ones."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    early = orders.where(F.col("o_orderdate") < _day("1995-01-01"))
    index = category_index(early, ("o_custkey", "o_orderpriority"))
    names = {"o_custkey": "customer_no", "o_orderpriority": "priority_no"}
    return add_positions(orders, index, names).select("o_orderkey", *names.values())


@query
def ks_exact_unequal(spark, folder):
    """Exact p-values of balances of a nation's customers against all others'."""
    customers = table(spark, folder, "customer")
    found = None
    for nation in range(3):
        here = F.col("c_nationkey") == nation
        pair = Pair.of(customers, here, ~here)
        row = drift.ks_test(drift.numeric_drift(pair, ("c_acctbal",)), "exact").select(
            F.lit(nation).alias("nation"), "n_ref", "n_cur", "ks_statistic", "ks_pvalue", "ks_pvalue_method"
        )
        found = row if found is None else found.unionByName(row)
    return rounded(found, "ks_statistic", "ks_pvalue")


@query
def batch_scoring(spark, folder):
    """Model fitted on the labeled documents, stored, read back and applied to all."""
    docs = labeled_documents(spark, folder)
    fitted = models.fit_logistic(models.model_frame(docs, DOC_MODEL), DOC_MODEL)
    path = new_folder(spark, "model")
    models.save_model(fitted, path)
    scores = models.batch_scores(
        table(spark, folder, "documents"), models.load_model(path), DOC_MODEL, ("bad", "good"),
        keep=("doc_id",),
    )
    return rounded(scores, "positive_probability")


@query
def scoring_consistency(spark, folder):
    """Every document has one score whose class and name follow its probability."""
    scores = batch_scoring(spark, folder)
    likely = F.col("positive_probability") >= 0.5
    named = F.when(F.col("prediction") == 1, "good").otherwise("bad")
    return scores.agg(
        F.count_distinct("doc_id").alias("n"),
        F.count_if((F.col("prediction") == 1) == likely).alias("n_following_probability"),
        F.count_if(F.col("predicted_class") == named).alias("n_named"),
        F.count_if(F.col("positive_probability").between(0.0, 1.0)).alias("n_in_range"),
    )


def _retrained(spark, folder, root):
    pair = split.random_pair(labeled_documents(spark, folder), "doc_id")
    return run_retrain(pair.reference, pair.current, DOC_MODEL, "doc_id", root, "documents")


@query
def production_scoring(spark, folder):
    """Retrain on the labeled documents, then score all with the model in production."""
    root = new_folder(spark, "production")
    _retrained(spark, folder, root)
    return rounded(
        score_with_production(
            table(spark, folder, "documents"), DOC_MODEL, root, "documents", ("bad", "good"),
            keep=("doc_id",),
        ),
        "positive_probability",
    )


@query
def retrain_flow(spark, folder):
    """Two runs over the same data: the second is as good, goes to production and archives
    the first. The ledgers are read back."""
    root = new_folder(spark, "retrain")
    _retrained(spark, folder, root)
    _retrained(spark, folder, root)
    books = Ledgers(spark, root)
    provenance = books.read("provenance").withColumnRenamed("id", "provenance_id")
    data = books.read("datasets").select(F.col("id").alias("dataset_version_id"), "row_count")
    return (
        books.models()
        .join(provenance, "experiment_id")
        .join(data, "dataset_version_id")
        .select(
            "version_num", "stage", "notes", "dataset_version_id", "baseline_snapshot_id",
            "provenance_id", "row_count",
        )
    )


@query
def stage_requests(spark, folder):
    """Moves asked for in the second half of the events, against the stages before it."""
    events = _stage_events(spark, folder)
    half = F.col("ts") < _day("2024-01-16")
    current = ledger.current_stages(events.where(half), "user_id", "ts", "event_id")
    return ledger.validated_moves(
        events.where(~half), current, "user_id", "ts", "event_id"
    ).select("user_id", "event_id", "from_stage", "stage", "is_legal", "allowed")


# --- streams -------------------------------------------------------------------------------

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def _event_stream(spark, folder):
    return file_stream(spark, folder, EVENT_SCHEMA, glob="events.parquet")


def _event_edges(spark, folder):
    return quantile_edges(event_pair(spark, folder).reference, ["value"])


def _slices(events: DataFrame, tests: list[Column], folder: str):
    """Appends one slice of the events after the other to a folder, as a source would."""
    for k, test in enumerate(tests):
        events.where(test).write.mode("append").parquet(folder)
        yield k


@query
def stream_drift(spark, folder):
    """Five slices of events, each a micro-batch that a restarted stream checks against
    the first half of the month."""
    pair = event_pair(spark, folder)
    baseline = fit_baseline(pair.reference, ("value",), ("event_type",))
    frozen = drift.freeze_reference(pair.reference, baseline)
    target = new_folder(spark, "stream")
    events = table(spark, folder, "events")
    tests = [F.col("event_id") % 5 == k for k in range(5)]
    for _ in _slices(events, tests, f"{target}/events"):
        monitor_stream(
            file_stream(spark, f"{target}/events", events.schema), pair.reference, baseline,
            f"{target}/runs", f"{target}/state", frozen=frozen,
        ).awaitTermination()
    return spark.read.parquet(f"{target}/runs").select(
        F.col("batch_id").cast("bigint").alias("batch_id"),
        "n_reference_rows", "n_current_rows", "n_features_high_psi",
        F.round("mean_psi", 6).alias("mean_psi"), "policy_triggered",
    )


@query
def stream_psi_on_close(spark, folder):
    """PSI of every day and event type as the day closes; the stream is stopped and
    started again from its checkpoint in the middle of the month."""
    pair = event_pair(spark, folder)
    edges = _event_edges(spark, folder)
    reference = {r["bin"]: r["n_ref"] for r in drift.bin_counts(pair, edges).collect()}
    events = table(spark, folder, "events")
    middle = _day("2024-01-16 12:00:00")
    target = new_folder(spark, "closing")
    for _ in _slices(events, [F.col("ts") < middle, F.col("ts") >= middle], f"{target}/events"):
        stream = file_stream(spark, f"{target}/events", events.schema)
        rows = closed_window_psi(stream, "ts", "value", edges["value"], reference, by=["event_type"])
        write_counts(rows, f"{target}/psi", f"{target}/state").awaitTermination()
    schema = "window_start timestamp, event_type string, n bigint, psi double, psi_band string"
    psi = spark.read.schema(schema).parquet(f"{target}/psi").drop("batch_id")
    return rounded(
        psi.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), "psi"
    )


def _streamed_counts(spark, folder, closed_only):
    edges = _event_edges(spark, folder)["value"]
    counts = windowed_bins(_event_stream(spark, folder), "ts", "value", edges, by=["event_type"])
    target = new_folder(spark, "windows")
    schema = "window_start timestamp, event_type string, bin int, n bigint"
    write_counts(
        counts, f"{target}/counts", f"{target}/state", closed_only=closed_only
    ).awaitTermination()
    counts = spark.read.schema(schema).parquet(f"{target}/counts")
    return counts.select("window_start", "event_type", "bin", "n")


@query
def stream_window_counts(spark, folder):
    """Newest counts of all days, the open ones included."""
    counts = _streamed_counts(spark, folder, closed_only=False)
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def stream_closed_windows(spark, folder):
    """Counts of the days the watermark has passed, each written once."""
    counts = _streamed_counts(spark, folder, closed_only=True)
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def stream_window_psi(spark, folder):
    """PSI of every day and event type against the reference's bins."""
    pair = event_pair(spark, folder)
    binned = drift.bin_counts(pair, _event_edges(spark, folder)).collect()
    reference = {r["bin"]: r["n_ref"] for r in binned}
    psi = windowed_psi(_streamed_counts(spark, folder, False), reference, by=["event_type"])
    return rounded(
        psi.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), "psi"
    )
