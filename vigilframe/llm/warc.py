"""WARC archives through a table of chunks: (record id, chunk number, bytes, digests so far).

A payload is handled as chunks of CHUNK_BYTES, cut once. The chunk table carries, with every chunk, the SHA-1 of the payload
up to its end, so the last chunk of a record has the record's digest. What a header needs to know of the whole record (digest,
size, whether it revisits another) is one small row per record; it is sorted before the record's chunks, and a task writes
record by record from these rows, holding a batch of chunks. An archive stores a longer payload as the standard's segments:
the first in a record of its own type, the others in `continuation` records that name the first; each holds one chunk.

Archives are written by Spark's text sink with the record end of the standard (two line ends) as its line end, and
compressed as a whole, so a reader streams each file from its start in pieces of at most about a chunk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilframe.session import checkpoint_dir, stage

CHUNK_BYTES = 1 << 18
RECORD_END = "\r\n\r\n"
#: Bytes of chunks in an Arrow batch that leaves a task.
BATCH_BYTES = 4 << 20
#: Every record is dated alike: a table has no time of capture, and reruns should give equal archives.
DATE = "2024-01-01T00:00:00Z"

CHUNK_SCHEMA = "page_id long, url string, chunk int, last boolean, total long, data binary, digest_so_far string, record long"
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("total", pa.int64()), ("data", pa.binary()), ("digest_so_far", pa.string()), ("record", pa.int64()),
])


def _digest(state) -> str:
    return base64.b32encode(state.digest()).decode("ascii")


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_column: str = "page_id", url_column: str = "url", text_column: str = "html") -> DataFrame:
    """One row per chunk of every payload (UTF-8 of the text; null: empty, one empty chunk), in order within a record.

    ``digest_so_far`` is the SHA-1, in hex digits, of the payload up to the chunk's end. ``record`` numbers the rows of
    ``pages``: by task and place, so no two rows share a number whatever their ids.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, record = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for page_id, url, payload in zip(*batch.columns, strict=True):
                view = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                state, place, number, total = hashlib.sha1(usedforsecurity=False), 0, 0, len(view)
                while number == 0 or place < total:
                    data = view[place : place + chunk_bytes]
                    state.update(data)
                    place += len(data)
                    rows.append((page_id.as_py(), url.as_py(), number, place >= total, total, bytes(data), state.hexdigest(), record))
                    held, number = held + len(data) + 200, number + 1
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                record += 1
        if rows:
            yield _batch(rows)

    read = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(text_column).cast("binary").alias("payload"))
    return read.mapInArrow(cut, CHUNK_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def first_of_payload(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(payload_digest, total, first_id, first_record) per payload of at least ``least_bytes``: the smallest id with it, null ids last."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("without"), "page_id", "record")).alias("first")
    found = digests.where(F.col("total") >= least_bytes).groupBy("payload_digest", "total").agg(first)
    return found.select("payload_digest", "total", F.col("first.page_id").alias("first_id"), F.col("first.record").alias("first_record"))


def record_id(name: str) -> str:
    """A record's URN, from the page's id, so that a revisit can name a record written by another task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n").encode()


def _one_line(url: str | None) -> str:
    return "".join(f"%{ord(one):02X}" if ord(one) < 33 or ord(one) == 127 else one for one in url or "")


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
    id_column: str = "page_id", url_column: str = "url", text_column: str = "html",
) -> None:
    """Write one record per row of ``pages`` (and a continuation per further chunk) to archives under ``path``.

    Of rows with equal payloads of at least ``least_bytes``, the one with the smallest id is a response; the others
    are revisits without a body that name it. Shorter payloads are responses. Rows that repeat the smallest id with the same payload
    are all responses. A null id (never smallest unless all are null) is written as an empty ``WARC-Page-Id``; null URLs are empty, null
    texts empty payloads; an empty table gives archives without records; other columns of ``pages`` are not read.
    Every record has an id of its own, also where rows repeat an id or have none.
    """
    # the one table with the payloads themselves, written more densely than others
    cut = f"{checkpoint_dir(pages.sparkSession)}/chunks-{uuid.uuid4().hex}"
    chunk_table(pages, chunk_bytes, id_column, url_column, text_column).write.option("compression", "zstd").parquet(cut)
    chunks = pages.sparkSession.read.schema(CHUNK_SCHEMA).parquet(cut)
    digests = stage(chunks.where("last").select("record", "page_id", "total", F.col("digest_so_far").alias("payload_digest")))
    firsts = stage(first_of_payload(digests, least_bytes))
    revisits = F.col("first_record").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    known = digests.join(firsts, ["payload_digest", "total"], "left").select(
        "record", F.lit(-1).alias("chunk"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("data"), "total",
        "payload_digest", "first_id", "first_record", revisits.alias("revisits"),
    )
    # what is known of a record comes before its chunks
    ordered = known.unionByName(chunks.select("record", "chunk", "page_id", "url", "data"), allowMissingColumns=True)
    ordered = ordered.repartition("record").sortWithinPartitions("record", "chunk")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.binary())])
        out, held, head = [], 0, None
        for batch in batches:
            for record, chunk, page_id, url, data, total, digest, first_id, first_record, revisits in zip(*batch.columns, strict=True):
                if chunk.as_py() < 0:
                    named = record_name(page_id.as_py(), record.as_py())
                    other = (first_id.as_py(), record_name(first_id.as_py(), first_record.as_py())) if revisits.as_py() else None
                    head = RecordHead(named, page_id.as_py(), total.as_py(), digest.as_py(), other)
                    continue
                if head.revisited and chunk.as_py():
                    continue
                out.append((segment_record(head, url.as_py(), chunk.as_py(), memoryview(data.as_buffer()), chunk_bytes),))
                held += len(out[-1][0])
                if held >= BATCH_BYTES:
                    yield _batch(out, schema)
                    out, held = [], 0
        if out:
            yield _batch(out, schema)

    written = ordered.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


class RecordHead(NamedTuple):
    """What the headers of a record's segments say of the whole: ``digest`` in hex digits, ``revisited`` (id, name) of the response."""

    name: str
    page_id: int | None
    total: int
    digest: str
    revisited: tuple[int | None, str] | None


def record_name(page_id: int | None, record: int) -> str:
    return f"page:{page_id}:{record}"


def segment_record(head: RecordHead, url: str | None, number: int, data: memoryview, chunk_bytes: int) -> bytes:
    """A record without its end: header, empty line, and one chunk of the payload, or none for a revisit."""
    own, segments = record_id(head.name), max(1, -(-head.total // chunk_bytes))
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Page-Id", "" if head.page_id is None else head.page_id)]
    digest = base64.b32encode(bytes.fromhex(head.digest)).decode("ascii")
    described = [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Bytes", head.total)]
    if head.revisited:
        first_id, first_name = head.revisited
        return _header([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *described,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first_name)), ("WARC-Refers-To-Page-Id", first_id), ("Content-Length", 0),
        ])
    if number == 0:
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *described]
        fields += [("WARC-Segment-Number", 1)] if segments > 1 else []
    else:
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{head.name}:{number}")), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number + 1)]
        fields += [("WARC-Segment-Total-Length", head.total)] if number + 1 == segments else []
    return _header([*fields, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(data))]) + bytes(data)


def page_records(page_id: int | None, url: str | None, payload: memoryview, first_id: int | None, revisits: bool, chunk_bytes: int) -> Iterator[bytes]:
    """All records of one small page that stands alone."""
    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    head = RecordHead(record_name(page_id, 0), page_id, len(payload), digest, (first_id, record_name(first_id, 0)) if revisits else None)
    for number in range(1 if revisits else max(1, -(-len(payload) // chunk_bytes))):
        yield segment_record(head, url, number, payload[number * chunk_bytes : (number + 1) * chunk_bytes], chunk_bytes)


READ_SCHEMA = (
    "page_id long, url string, record_type string, segment int, segments_end boolean, total long, payload_digest string, refers_to long, "
    "data binary, chunk_digest_so_far string"
)
_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("segment", pa.int32()), ("segments_end", pa.bool_()), ("total", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("data", pa.binary()), ("chunk_digest_so_far", pa.string()),
])


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, body) of each record in one archive, given what stands between its double line ends, in order.

    The pieces are put together again with the line ends between them, and Content-Length says where a body ends: a
    body may hold double line ends itself, and one that ends in a line end is cut before it, not before the record's end.
    """
    end, ahead = RECORD_END.encode(), bytearray()

    def reaches(length: int) -> bool:
        while len(ahead) < length:
            piece = next(pieces, None)
            if piece is None:
                return False
            ahead.extend(piece)
            ahead.extend(end)
        return True

    while reaches(len(end) + 1):
        while (place := ahead.find(end)) < 0:
            if not reaches(len(ahead) + 1):
                raise ValueError("an archive ends within a header")
        lines = ahead[:place].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        header = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        del ahead[: place + len(end)]
        length = int(header["Content-Length"])
        if not reaches(length + len(end)) or ahead[length : length + len(end)] != end:
            raise ValueError(f"a record of {length} bytes does not end there")
        body = bytes(ahead[:length])
        del ahead[: length + len(end)]
        yield header, body
    # a last body that ends in a line end leaves a piece which no line ends follow
    if ahead not in (b"", end):
        raise ValueError(f"no record begins with {bytes(ahead[:40])!r}")


def read_archives(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """One row per record segment of the archives under ``path``, with the digest of the payload up to its end.

    A compressed file is one task's, read as a stream. ``segments_end`` marks a record's last segment; the digest of
    what was read must then equal the one in the header, or the read fails.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((name.as_py(), piece.as_py()) for batch in batches for name, piece in zip(*batch.columns, strict=True))
        out, held = [], 0
        for records in _by_file(pieces):
            state, origin, seen = None, {}, 0
            for header, body in read_records(records):
                kind = header["WARC-Type"]
                if kind != "continuation":
                    origin, seen, state = header, 0, hashlib.sha1(usedforsecurity=False)
                state.update(body)
                seen += len(body)
                total, digest = int(origin["WARC-Payload-Bytes"]), origin["WARC-Payload-Digest"].removeprefix("sha1:")
                ended = origin["WARC-Type"] == "revisit" or seen >= total
                if ended and origin["WARC-Type"] == "response" and (_digest(state) != digest or seen != total):
                    raise ValueError(f"the payload of page {origin['WARC-Page-Id']} does not have the digest {digest}")
                number, other = (header.get(name, "") for name in ("WARC-Page-Id", "WARC-Refers-To-Page-Id"))
                out.append((
                    int(number) if number else None, header["WARC-Target-URI"], kind, int(header.get("WARC-Segment-Number", 1)), ended, total, digest,
                    int(other) if other else None, body if with_data else None, _digest(state),
                ))
                held += 300 + len(body) * with_data
                if held >= BATCH_BYTES:
                    yield _batch(out, _READ)
                    out, held = [], 0
        if out:
            yield _batch(out, _READ)

    lines = spark.read.option("lineSep", RECORD_END).text(path)
    return lines.select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary")).mapInArrow(parse, READ_SCHEMA)


def _by_file(pieces: Iterator[tuple[str, bytes]]) -> Iterator[Iterator[bytes]]:
    """The pieces of each file, one file after the other."""
    for _, some in groupby(pieces, itemgetter(0)):
        yield map(itemgetter(1), some)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page in the archives."""
    records = read_archives(spark, path)
    return records.where("record_type <> 'continuation'").select(
        "page_id", F.col("total").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
