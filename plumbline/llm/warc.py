"""WARC archives without repeated payloads.

Headers (record, digest, length) are shuffled by payload digest; of equal payloads one
record stays a response and the others become revisit records that refer to it. Archives
are plain WARC 1.1 text in the shared folder, written and listed by Spark: a record ends
with the blank lines that Spark's text writer puts behind every row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.sources.shared import new_folder, written

# Shorter payloads are cheaper to keep than to refer to.
MIN_PAYLOAD = 1000
RECORDS_PER_ARCHIVE = 4096
# Payload bytes of an archive; a longer record has one to itself.
ARCHIVE_BYTES = 1 << 27
CAPTURED = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = "\r\n\r\n"
_BLOCK = 1 << 20


def _record_id(page: Column, digest: Column) -> Column:
    """A URN that depends on the page and its payload only."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("none")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, nothing for NULL. Control characters can't start another line."""
    safe = F.regexp_replace(value.cast("string"), "[\\x00-\\x1f\\x7f]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def payload_headers(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(page_id, digest, bytes) of each row; only these are shuffled by digest."""
    payload = F.encode(F.coalesce(col(html_column).cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        col(id_column).cast("bigint").alias("page_id"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
    )


def revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, original): the records that repeat the payload of the original,
    the record with the largest page_id. Rows that share page_id and payload are alike."""
    long = headers.where((F.col("bytes") >= min_payload) & F.col("page_id").isNotNull())
    originals = (
        long.groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("original"), F.min("page_id").alias("first"))
        .where(F.col("first") < F.col("original"))
        .drop("first")
    )
    return (
        long.join(originals, ["digest", "bytes"])
        .where(F.col("page_id") < F.col("original"))
        .select("page_id", "digest", "original")
        .distinct()
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    min_payload: int = MIN_PAYLOAD,
    records_per_archive: int = RECORDS_PER_ARCHIVE,
    archive_bytes: int = ARCHIVE_BYTES,
    compression: str = "gzip",
) -> None:
    """One record per row, in archives of bounded numbers of records and bytes.

    The payload is the UTF-8 text, empty for NULL. Of rows with equal payloads of at least
    ``min_payload`` bytes the one with the largest id is a response, the others are
    revisits without payload. Rows without id are responses. Rows with equal id and
    payload become equal records. A NULL url gives a record without target. No rows give
    archives without records; other columns are not read. Records are written by classes of
    length, the longer the fewer to an archive, with a pass for each class there is; a
    record of any length that a row can hold has its place.
    """
    again = revisits(payload_headers(pages, id_column, html_column), min_payload)
    text = F.coalesce(col(html_column).cast("string"), F.lit(""))
    rows = pages.select(
        col(id_column).cast("bigint").alias("page_id"),
        col(url_column).cast("string").alias("url"),
        text.alias("html"),
        F.sha1(F.encode(text, "UTF-8")).alias("digest"),
    ).join(again, ["page_id", "digest"], "left")
    is_revisit = F.col("original").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(_END),
    )
    block = F.concat(head, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    referred = F.when(is_revisit, _record_id(F.col("original"), F.col("digest")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _field("WARC-Date", F.lit(CAPTURED)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode(F.col("block"), "UTF-8")))),
        _field("WARC-Profile", F.when(is_revisit, F.lit(IDENTICAL))),
        _field("WARC-Refers-To", referred),
        _field("X-Page-ID", F.col("page_id")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(
        F.octet_length("html").alias("size"), F.concat(header, F.col("block")).alias("value")
    )
    classes = _classes(records_per_archive, archive_bytes)
    size = F.coalesce(F.octet_length(col(html_column).cast("string")), F.lit(0))
    held = pages.agg(*[F.bool_or(size.between(low, high)) for low, high, _ in classes]).first()
    for k, (low, high, n) in enumerate(classes):
        if held[k] or not any(held) and k == 0:
            (
                records.where(F.col("size").between(low, high))
                .select("value")
                .write.mode("append")
                .option("lineSep", _END)
                .option("compression", compression)
                .option("maxRecordsPerFile", n)
                .text(path)
            )


def _classes(records: int, archive_bytes: int) -> list[tuple[int, int, int]]:
    """(shortest, longest, records to an archive) of classes of payload lengths."""
    classes, low = [], 0
    while records > 1:
        high = archive_bytes // records
        classes.append((low, high, records))
        low, records = high + 1, records // 16
    return [*classes, (low, (1 << 31) - 1, 1)]


class _Stream:
    """Bytes of an archive, unpacked as they are read."""

    def __init__(self, data: memoryview):
        self._data, self._at, self._held = data, 0, bytearray()
        self._unzip = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        piece = bytes(self._data[self._at : self._at + _BLOCK])
        if not piece:
            return False
        self._at += len(piece)
        if self._unzip is None:
            self._held += piece
            return True
        while piece:
            self._held += self._unzip.decompress(piece)
            piece = self._unzip.unused_data
            if self._unzip.eof:  # the next member of the file
                self._unzip = zlib.decompressobj(31)
            else:
                piece = b""
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to the mark, which is skipped; all that is left without one."""
        start = 0
        while (at := self._held.find(mark, start)) < 0:
            start = max(0, len(self._held) - len(mark) + 1)
            if not self._more():
                at = len(self._held)
                break
        out = bytes(self._held[:at])
        del self._held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self._held) < n and self._more():
            pass
        out = bytes(self._held[:n])
        del self._held[:n]
        return out


def parsed(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    stream = _Stream(data)
    while head := stream.until(_END.encode()):
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("the archive ends inside a record")
        stream.take(len(_END))
        yield fields, block


_RECORDS = (
    "page_id bigint, record_id string, record_type string, url string, refers_to_id string, "
    "named_digest string, payload_digest string, payload_bytes bigint"
)


def _read(with_payload: bool):
    names = [x.split()[0] for x in _RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64()] + [pa.binary()] * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archives in batches:
            for content in archives.column(0):
                rows, size = [], 0
                for fields, block in parsed(memoryview(content.as_buffer())):
                    payload = block.partition(_END.encode())[2]
                    page = fields.get("x-page-id")
                    full = fields.get("warc-type") == "response"
                    row = (
                        int(page) if page else None,
                        fields.get("warc-record-id"),
                        fields.get("warc-type"),
                        fields.get("warc-target-uri"),
                        fields.get("warc-refers-to"),
                        fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                        hashlib.sha1(payload).hexdigest() if full else None,
                        len(payload) if full else None,
                    )
                    rows.append(row + (payload,) * with_payload)
                    size += len(payload) * with_payload + 500
                    if size >= 16 * _BLOCK:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record: ids, type, the digest its header names, and digest, length and
    (on demand) bytes of the payload it holds, NULL for a revisit."""
    archives = (
        spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    )
    schema = _RECORDS + ", payload binary" * with_payload
    return archives.mapInArrow(_read(with_payload), schema)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each
    record, revisits with digest and length of the response they refer to."""
    originals = (
        records.where(F.col("record_type") == "response")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(
            F.max(F.struct("page_id", "payload_bytes", "payload_digest")).alias("original"),
        )
    )
    first = records.where(F.col("record_type") == "response").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
        "url",
    )
    again = (
        records.where(F.col("record_type") == "revisit")
        .select("page_id", "refers_to_id", "record_type", "url")
        .join(originals, "refers_to_id", "left")
        .select(
            "page_id",
            F.col("original.payload_bytes").alias("payload_bytes"),
            F.col("original.payload_digest").alias("payload_digest"),
            "record_type",
            F.col("original.page_id").alias("refers_to"),
            "url",
        )
    )
    return first.unionByName(again)


def archived(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages to archives and read the records back, revisits resolved."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder, **options)
    return resolved(written(read_archives(spark, folder), "records"))
