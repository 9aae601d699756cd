"""WARC archives: round trips and revisits."""

import hashlib

import pytest

from plumbline.llm import warc
from plumbline.sources.shared import new_folder

LONG = "<p>" + "text, " * 200 + "</p>"
TRICKY = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60 + "é日本\r\n\r\n\x00"
PAGES = [
    (1, "http://a.example/", LONG),
    (2, "http://b.example/", LONG),
    (3, "http://a.example/", LONG),
    (4, None, TRICKY),
    (5, "http://x.example/\r\nWARC-Type: revisit", TRICKY),
    (6, "http://short.example/", "short"),
    (7, "http://short.example/", "short"),
    (8, "http://null.example/", None),
    (9, "", ""),
    (None, "http://c.example/", LONG),
    (3, "http://again.example/", LONG),
    (2, "http://b.example/", LONG),
]
SCHEMA = "page_id bigint, url string, html string, digest string, original bigint, block string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "d", 1, "b") for p in PAGES], SCHEMA).repartition(3)


def sha1(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


def expected():
    out = []
    for page, _, html in PAGES:
        n = len((html or "").encode())
        same = [p for p, _, h in PAGES if h == html and p is not None]
        again = n >= 1000 and page is not None and page < max(same)
        out.append((page, n, sha1(html), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"records_per_archive": 2}, {"archive_bytes": 2000}])
def test_revisits(pages, options):
    found = warc.archived(pages, **options).drop("url")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == expected()


def test_payloads_come_back(spark, pages):
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(records) == len(PAGES)
    kept = sorted((r["page_id"] or 0, bytes(r["payload"])) for r in records if r["record_type"] == "response")
    wanted = sorted((p or 0, (h or "").encode()) for p, _, h in PAGES if not (h in (LONG, TRICKY) and p in (1, 2, 4)))
    assert kept == wanted
    for r in records:
        assert r["payload_digest"] in (None, r["named_digest"])
        assert r["record_type"] == "response" or r["payload"] == b""
        assert "\n" not in (r["url"] or "")


def test_records_are_standard(spark, pages):
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path, compression="none")
    for row in spark.read.format("binaryFile").load(path).collect():
        for fields, block in warc.parsed(memoryview(bytes(row["content"]))):
            assert fields["warc-record-id"].startswith("<urn:uuid:")
            assert int(fields["content-length"]) == len(block)
            assert fields["warc-block-digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
            assert ("warc-refers-to" in fields) == (fields["warc-type"] == "revisit")


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parsed(memoryview(b"HTTP/1.1 200 OK\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parsed(memoryview(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archived(df).collect() == []


def test_archives_are_bounded_by_bytes(spark):
    """Pages of 1 to 300 kB, and one of 20 MB, in archives of a quarter of a megabyte."""
    lengths = [1000, 20_000, 300_000, 100_000] * 30
    rows = [(k, "u", f"{k} " + "x" * n) for k, n in enumerate(lengths)] + [(999, "u", "y" * 20_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = new_folder(spark, "warc")
    warc.write_archives(df, path, compression="none", archive_bytes=1 << 18, records_per_archive=64)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    headers = 64 * 1000
    assert sum(n > (1 << 18) + headers for n in sizes) == 1
    # A page beyond the bound has an archive to itself.
    assert sum(n > 300_000 for n in sizes) == 31
    found = warc.read_archives(spark, path).select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, found)) == sorted((i, len(h)) for i, _, h in rows)
