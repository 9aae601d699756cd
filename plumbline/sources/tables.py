"""Sample tables: CSV and Parquet scans, cleanup, column contracts, exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, null_markers, quoted
from plumbline.sources.shared import written
from plumbline.spec import FeatureSpec

# Texts that mean "missing", exactly as written in the files.
MISSING_MARKERS = ("?", " ?")


def clean_markers(
    df: DataFrame, markers: Iterable[str] = MISSING_MARKERS, columns: Iterable[str] | None = None
) -> DataFrame:
    """Markers become NULL in the text columns."""
    markers = list(markers)
    wanted = set(df.columns if columns is None else columns)
    return df.select(
        *[
            null_markers(col(f.name), markers).alias(f.name)
            if isinstance(f.dataType, T.StringType) and f.name in wanted
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without a NULL in any column."""
    return df.dropna(how="any", subset=[quoted(c) for c in df.columns])


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Project to the required columns in their order; fail on missing ones.

    Looks at the schema only, so a broken contract costs no job.
    """
    required = list(required)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    return df.select(*[col(c) for c in required])


def select_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Features only, without target and order column."""
    return require_columns(df, spec.features)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    keep_incomplete: bool = False,
    required: Iterable[str] | None = None,
) -> DataFrame:
    """CSV with a header, missing markers as NULL, incomplete rows dropped.

    Give a schema for anything large: inference reads the files once more.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = clean_markers(reader.csv(path))
    if required is not None:
        missing = sorted(set(required) - set(df.columns))
        if missing:
            raise ValueError(f"Columns not found: {', '.join(missing)}")
    return df if keep_incomplete else drop_incomplete(df)


def read_csv_checked(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of CSV files with a header.

    ``malformed`` has the ``line`` of every record with too few or too many fields or with a
    value that is not of its column's type; ``rows`` has all others, with missing markers as
    NULL. Records that quotes carry over line feeds need the option ``multiLine``.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    line = "_line"
    while line in wanted.names:
        line = "_" + line
    reader = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", line)
        .options(**options)
        .schema(T.StructType([*wanted, T.StructField(line, T.StringType())]))
    )
    # Read once: a scan of the line alone would not parse the others.
    parsed = written(reader.csv(path), "csv")
    good = clean_markers(parsed.where(F.col(line).isNull()).drop(line))
    return good, parsed.where(F.col(line).isNotNull()).select(F.col(line).alias("line"))



def write_windows(df: DataFrame, path: str, window: str = "window", fmt: str = "csv") -> None:
    """Export the windows of a table, one folder each."""
    writer = df.write.mode("overwrite").partitionBy(window)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a ledger table."""
    df.write.mode("append").parquet(path)


def file_frame(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Files as rows: path, length, content."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)
