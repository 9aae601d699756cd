"""Files of any size as rows, read piece by piece."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import new_folder

PIECE_BYTES = 1 << 22
# What one task reads of a large file.
PART_BYTES = 1 << 28
SCHEMA = "path string, length bigint, content_hash string"
STEP_SCHEMA = f"{SCHEMA}, done bigint, state binary"
STEP_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("length", pa.int64()),
        ("content_hash", pa.string()),
        ("done", pa.int64()),
        ("state", pa.binary()),
    ]
)
LOCAL = "file:/"
# Size of OpenSSL's SHA256_CTX, numbers only.
STATE_BYTES = 112


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """Spark writes file:/x and leaves blanks and % as they are, Arrow's URIs do not."""
    if path.startswith(LOCAL):
        return fs.LocalFileSystem(), "/" + path[len(LOCAL) :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name in batch.column(0).to_pylist():
            system, path = _located(name)
            digest, length = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
                    length += len(piece)
            rows.append((name, length, digest.hexdigest()))
        names, lengths, hashes = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string())],
            ["path", "length", "content_hash"],
        )


def streamed_hashes(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, length, content_hash) of the files named by the ``path`` column of a listing.

    For files beyond the 2 GB of a row. The tasks open them with Arrow's file systems, so
    the store must be one of those (local and shared folders, HDFS, S3), and hold a few
    megabytes of a file at a time. They are the listing's own tasks, which Spark packs by
    size: a large file has one to itself, small ones share it.
    """
    return files.select("path").mapInArrow(_hashed, SCHEMA)


def _library() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib itself is linked with, if its SHA-256 can be stopped."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        for function in (library.SHA256_Init, library.SHA256_Update, library.SHA256_Final):
            function.restype = ctypes.c_int
        library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        return library
    except (ImportError, OSError, AttributeError):
        return None


class _Resumed:
    """SHA-256 from a state on; hashlib keeps its state to itself."""

    def __init__(self, library: ctypes.CDLL, state: bytes | None):
        self._library = library
        self._held = ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            library.SHA256_Init(self._held)

    @property
    def state(self) -> bytes:
        return self._held.raw

    def update(self, piece: bytes) -> None:
        self._library.SHA256_Update(self._held, piece, len(piece))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._library.SHA256_Final(out, self._held)
        return out.raw.hex()


def _next_part(part_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(row: dict) -> dict:
        library, done, length = _library(), row["done"], row["length"]
        if library is None:
            digest, done, end = hashlib.sha256(), 0, length
        else:
            digest, end = _Resumed(library, row["state"]), min(done + part_bytes, length)
        system, path = _located(row["path"])
        with system.open_input_file(path) as file:
            if file.size() != length:
                raise OSError(f"{path} has {file.size()} bytes, {length} when it was listed")
            file.seek(done)
            while done < end and (piece := file.read(min(PIECE_BYTES, end - done))):
                digest.update(piece)
                done += len(piece)
        if done < end:
            raise OSError(f"{path} ended after {done} of {length} bytes")
        if done < length:
            return row | {"done": done, "state": digest.state}
        return row | {"done": done, "state": None, "content_hash": digest.hexdigest()}

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([step(row) for row in batch.to_pylist()], STEP_ARROW)

    return steps


def chained_hashes(spark: SparkSession, files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, length, content_hash) of the listed files (``path, length``), of each of which a
    task reads ``part_bytes`` at most.

    SHA-256 takes the bytes in order, so a file's parts come one after another: each step
    takes one part of every unfinished file, a file to a task, and leaves the state of its
    hash in the shared folder for the next. The steps run at once, as many as the longest
    file has parts. Where Python has no OpenSSL to stop at, the first step takes the file whole.
    """
    folder, k = new_folder(spark, "hashes"), 0
    none = F.lit(None)
    left = files.select(
        "path",
        "length",
        none.cast("string").alias("content_hash"),
        F.lit(0).cast("bigint").alias("done"),
        none.cast("binary").alias("state"),
    )
    steps = spark.read.schema(STEP_SCHEMA)
    while n := left.count():
        dealt = left.repartitionByRange(n, "path").mapInArrow(_next_part(part_bytes), STEP_SCHEMA)
        # A file of rows for each task would be many.
        dealt.hint("rebalance").write.parquet(f"{folder}/step={k}")
        left = steps.parquet(f"{folder}/step={k}").where(F.col("content_hash").isNull())
        k += 1
    if not k:
        return spark.createDataFrame([], SCHEMA)
    hashed = steps.parquet(*[f"{folder}/step={j}" for j in range(k)])
    return hashed.where(F.col("content_hash").isNotNull()).select("path", "length", "content_hash")
