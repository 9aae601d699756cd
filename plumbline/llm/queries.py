"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import crf, html, quality, urls
from plumbline.llm.licenses import license_hits
from plumbline.llm.mixing import mixed
from plumbline.llm.names import unused
from plumbline.llm.neardup import near_duplicates
from plumbline.llm.packing import packed
from plumbline.llm.ranking import ranked
from plumbline.llm.ring import sharded
from plumbline.llm.runs import looped, periodic_runs
from plumbline.llm.vptree import nearest
from plumbline.llm.warc import archived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives without repeated payloads and read the records back."""
    return archived(table(spark, sf_dir, "pages"))


@query
def op2_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and blocks of all documents that are like a license notice."""
    return license_hits(table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document, over sets of 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight shards of near-equal size."""
    return sharded(table(spark, sf_dir, "documents"))


@query
def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a mix by target weights holds, how often and in what order."""
    docs = table(spark, sf_dir, "documents")
    rows = mixed(docs, details=True)
    return rows.select(
        "doc_id", "source", F.round("rate", 6).alias("rate"), "copy", "shuffle_key"
    )


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judged(table(spark, sf_dir, "pages"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens, near copies apart."""
    docs = table(spark, sf_dir, "documents")
    return packed(docs, near=near_duplicates(docs))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over every whole text, and the verdict of the line rules."""
    docs = table(spark, sf_dir, "documents")
    name = unused(docs, "quality")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judged(docs, name=name).select(
        "doc_id", *[F.col(name)[f].alias(f) for f in (*fields, "base_failed", "kept")]
    )


@query
def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a field over its lines fitted to labelled documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return crf.quality(docs, labels).select(
        "doc_id",
        crf.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document; a tenth of them are made to end in a loop."""
    rows = periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"),
                (-r["start"]).alias("start"),
                (-r["period"]).alias("period"),
            ),
        )
    )
    listed = F.array_join(
        F.transform(
            "runs",
            lambda r: F.concat(
                F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")
            ),
        ),
        "",
    )
    rows = rows.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
