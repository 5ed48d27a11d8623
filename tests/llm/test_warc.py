import base64
import hashlib

import duckdb
import pytest

from vigilframe.llm import queries, warc
from vigilframe.llm.common import table

PAGES = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://b c/\n", ""), (4, "http://a/2", "<p>one</p>"), (5, "u", "\r\n\r\n" * 40), (6, "u", "\r\r\n\r\n\r\n\r\r\n\r\n"),
    (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n"), (8, "u", "é" * 300 + "\r\n\r\n" + "y" * 300), (None, "u", "no id"), (9, "u", "no id"), (4, "http://a/2", "<p>one</p>"), (8, "u", "other payload"),
    (10, "u", "z" * 1000), (11, "u", "z" * 1000),
]


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_archives_come_back(spark, tmp_path, chunk):
    pages = spark.createDataFrame([(*row, "x") for row in ROWS], PAGES + ", record_type string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk_bytes=chunk)
    first = {}
    for page_id, _, html in ROWS:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    want = []
    for page_id, _, html in ROWS:
        smallest = first.get(html or "")
        revisit = smallest is not None and smallest != page_id
        want.append((str(page_id), len((html or "").encode()), sha(html), "revisit" if revisit else "response", smallest if revisit else None))
    found = [(str(row.page_id), row.payload_bytes, row.payload_digest, row.record_type, row.refers_to) for row in warc.archived_pages(spark, path).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    segments = warc.read_archives(spark, path, with_data=True).collect()
    payloads = {}
    for row in segments:
        if row.page_id == 10:
            payloads[row.segment] = bytes(row.data)
    assert b"".join(payloads[number] for number in sorted(payloads)) == b"z" * 1000 and len(payloads) == -(-1000 // chunk)
    assert all(len(row.data) <= chunk for row in segments)


def test_short_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=11)
    found = {row.page_id: row.record_type for row in warc.archived_pages(spark, str(tmp_path / "w")).collect()}
    assert found[4] == "response" and found[11] == "revisit" and found[3] == "response"


def test_chunks_carry_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefghij"), (2, "u", None)], PAGES)
    found = [(row.page_id, row.chunk, row.last, bytes(row.data), row.digest_so_far) for row in warc.chunk_table(pages, 4).orderBy("page_id", "chunk").collect()]
    assert found == [
        (1, 0, False, b"abcd", hashlib.sha1(b"abcd").hexdigest()), (1, 1, False, b"efgh", hashlib.sha1(b"abcdefgh").hexdigest()),
        (1, 2, True, b"ij", hashlib.sha1(b"abcdefghij").hexdigest()), (2, 0, True, b"", hashlib.sha1().hexdigest()),
    ]


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_payloads_that_end_in_one_line_end(spark, tmp_path, chunk):
    rows = [
        (1, "u", "X\r\n"), (2, "u", "\r\n"), (3, "u", "y" * 62 + "\r\n" + "z" * 62 + "\r\n"), (4, "u", "a\r\n" * 200), (5, "u", "\r\n" * 99),
        (6, "u", "b" * 63 + "\r\n" + "c"), (7, "u", "X\r\n\r"), (8, "u", "X\r\n\r\n\r\n"), (9, "u", "last\r\n"),
    ]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, chunk_bytes=chunk)
    found = {}
    for row in warc.read_archives(spark, path, with_data=True).orderBy("page_id", "segment").collect():
        found[row.page_id] = found.get(row.page_id, b"") + bytes(row.data)
    assert found == {page_id: html.encode() for page_id, _, html in rows}


def test_damage_is_seen():
    good = list(warc.page_records(1, "u", memoryview(b"payload"), None, False, 100))[0]
    assert list(warc.read_records(iter(good.split(b"\r\n\r\n"))))[0][1] == b"payload"
    with pytest.raises((ValueError, StopIteration, RuntimeError)):
        list(warc.read_records(iter([good.split(b"\r\n\r\n")[0], b"payload longer than said"])))


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.archived_pages(spark, str(tmp_path / "w")).count() == 0


def test_query_and_sql(spark, sf_dir):
    frame = queries.QUERIES["op9_warc"](spark, sf_dir)
    columns = sorted(frame.columns)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    result = db.execute(f"select {', '.join(columns)} from ({queries.ORACLE['op9_warc']})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(result, key=str)
    assert len(result) == table(spark, sf_dir, "pages").count()


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_every_record_has_an_id_of_its_own(spark, tmp_path, chunk):
    rows = [*ROWS, (4, "http://a/2", "<p>one</p>"), (None, "u", "no id"), (None, "u", "only here"), (None, "u", "only here"), (12, "u", "w" * 500), (12, "v", "w" * 500), (13, "u", "w" * 500)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path, chunk_bytes=chunk)
    headers = []
    for file in spark.read.option("lineSep", warc.RECORD_END).text(path).selectExpr("_metadata.file_path as name", "cast(value as binary) as value").groupBy("name").agg({"value": "count"}).collect():
        pieces = spark.read.option("lineSep", warc.RECORD_END).text(file["name"]).selectExpr("cast(value as binary) as value").collect()
        headers += [header for header, _ in warc.read_records(iter([bytes(piece.value) for piece in pieces]))]
    ids = [header["WARC-Record-ID"] for header in headers]
    assert len(set(ids)) == len(ids) > len(rows) - 1
    kinds = {header["WARC-Record-ID"]: header for header in headers}
    for header in headers:
        if header["WARC-Type"] == "revisit":
            other = kinds[header["WARC-Refers-To"]]
            assert other["WARC-Type"] == "response" and other["WARC-Payload-Digest"] == header["WARC-Payload-Digest"]
            assert other["WARC-Page-Id"] == header["WARC-Refers-To-Page-Id"]
        if header["WARC-Type"] == "continuation":
            assert kinds[header["WARC-Segment-Origin-ID"]]["WARC-Page-Id"] == header["WARC-Page-Id"]


def test_a_long_payload_is_written_chunk_by_chunk(spark, tmp_path, monkeypatch):
    """No piece that leaves the chunk table or enters a record is longer than a chunk, whatever the payload's length."""
    text = "0123456789abcdef" * (1 << 18)
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text), (3, "u", "short")], PAGES)
    assert warc.chunk_table(pages, 1 << 16).selectExpr("max(length(data)) as most", "count(*) as rows").first() == (1 << 16, 129)
    warc.write_archives(pages, str(tmp_path / "w"), chunk_bytes=1 << 16)
    rows = warc.read_archives(spark, str(tmp_path / "w"), with_data=True).selectExpr("page_id", "record_type", "segment", "length(data) as size").collect()
    assert sorted((row.page_id, row.record_type) for row in rows if row.segment == 1) == [(1, "response"), (2, "revisit"), (3, "response")]
    assert sum(row.size for row in rows if row.page_id == 1) == len(text) and max(row.size for row in rows) == 1 << 16
