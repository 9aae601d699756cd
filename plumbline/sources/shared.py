"""Shared working folder of the cluster."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every node reaches: spark.checkpoint.dir as the session names it, else the
    checkpoint folder set on the context, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        if named.startswith(("file:", "/")) and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return named.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Working folder of this application; nothing outside it is ever removed."""
    return f"{shared_folder(spark)}/plumbline/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{session_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "stage", by: tuple[str, ...] = ()) -> DataFrame:
    """The frame as a table in the shared folder: computed once, read from there on. With
    ``by`` a folder for each value of those columns, which come last.

    Unlike cached blocks the table outlives the executors that wrote it. It stays until
    ``clear_session``, as later frames read from it lazily.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, purpose: str = "stage") -> tuple[DataFrame, int]:
    """``written``, and its number of rows, which the footers of its files tell. (An
    ``Observation`` would take no job, but with one on the session models of Spark ML can
    no longer be sent to tasks.)"""
    table = written(df, purpose)
    return table, table.count()


@contextmanager
def short_lived(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``written`` for as long as the block runs; the table is removed after it. It is
    packed closely, as it may hold digests."""
    path = new_folder(df.sparkSession, purpose)
    try:
        df.write.parquet(path, compression="zstd")
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        files.delete(path, True)


def is_missing(error: AnalysisException) -> bool:
    """Is it only that nothing has been written to the path yet?"""
    return error.getCondition() == "PATH_NOT_FOUND"


def clear_session(spark: SparkSession) -> None:
    """Remove the working tables of this application, once no frame needs them."""
    _remove(spark, session_folder(spark))
