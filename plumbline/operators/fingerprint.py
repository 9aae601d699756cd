"""Content fingerprints of files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.sources.files import LOCAL, PART_BYTES, chained_hashes, streamed_hashes
from plumbline.sources.tables import file_frame

# A file from here on is no row of Spark's binary reader, which ends below 2 GB.
ROW_BYTES = 1 << 30
# Hex digits per summand (52 bits) and summands per digest.
CHUNK = 13
CHUNKS = 5
NULL_MARK = "~"
VALUE_MARK = "="


def file_fingerprints(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = None,
    whole_below: int = ROW_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """SHA-256 of every file: path, length, content_hash.

    Files below ``whole_below`` bytes are rows of Spark's binary reader, on any file system
    it knows; local and shared folders, which Arrow opens as well, have such rows below
    ``part_bytes`` only. Others are read in pieces (see ``sources.files``), and from
    ``part_bytes`` on by one task after another, at the call.
    """
    files = file_frame(spark, path, glob)
    lengths, length = files.select("path", "length"), F.col("length")
    elsewhere = (length >= part_bytes) & ~F.col("path").startswith(LOCAL)
    beyond_rows = lengths.where(length >= min(whole_below, part_bytes))
    longest, stores = beyond_rows.agg(F.max(length), F.max(elsewhere)).first()
    if not stores:
        whole_below = min(whole_below, part_bytes)
    hashed = files.where(length < whole_below).select(
        "path", "length", F.sha2("content", 256).alias("content_hash")
    )
    if longest is None:
        return hashed
    parts_from = max(whole_below, part_bytes)
    if whole_below < parts_from:
        pieces = lengths.where((length >= whole_below) & (length < parts_from))
        hashed = hashed.unionByName(streamed_hashes(spark, pieces))
    if longest >= parts_from:
        large = lengths.where(length >= parts_from)
        hashed = hashed.unionByName(chained_hashes(spark, large, part_bytes))
    return hashed


def row_digest(df: DataFrame):
    """SHA-256 of one row over its columns in name order. Values carry their length,
    so no two different rows read alike, and NULL differs from empty text."""
    parts = []
    for name in sorted(df.columns):
        text = col(name).cast("string")
        marked = F.concat(F.lit(VALUE_MARK), F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(marked, F.lit(NULL_MARK)))
    return F.sha2(F.concat(*parts), 256)


def table_fingerprint(df: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Hash of a table's content, whatever its row and column order:
    ``row_count, content_hash``, per group if groups are given.

    The rows' digests are cut into 52-bit numbers and summed, so the whole is a
    map-side aggregate without a sort. A sum, unlike xor, keeps duplicates apart.
    """
    content = df.drop(*groups) if groups else df
    digest = row_digest(content)
    chunks = [
        F.conv(F.substring("_digest", i * CHUNK + 1, CHUNK), 16, 10).cast("bigint")
        for i in range(CHUNKS)
    ]
    sums = (
        df.select(*[col(g) for g in groups], digest.alias("_digest"))
        .groupBy(*[col(g).alias(g) for g in groups])
        .agg(
            F.count("*").alias("row_count"),
            *[F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(chunks)],
        )
    )
    header = ",".join(sorted(content.columns))
    whole = F.concat_ws(
        "|",
        F.lit(header),
        F.col("row_count").cast("string"),
        *[F.col(f"_s{i}").cast("decimal(38,0)").cast("string") for i in range(CHUNKS)],
    )
    return sums.select(*[col(g) for g in groups], "row_count", F.sha2(whole, 256).alias("content_hash"))
