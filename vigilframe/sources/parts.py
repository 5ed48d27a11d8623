"""Records of large CSV and JSON files, cut out by many tasks at once.

A byte range alone doesn't tell whether it begins inside a quoted field, a string or a nested object. Each range is
therefore read twice. First it is summed up as what it makes of either state it may begin in (outside or inside
quotes: the state it ends in, and by how much nesting grows); composing these sums in order, one row per range, gives
every range its true first state. Then each range is cut into records; what a range ends with open is put together
with the beginning of the next ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilframe import session

#: Bytes, or records, that a task hands on at a time.
BATCH_BYTES, BATCH_ROWS = 1 << 23, 1 << 14

SUMS = "path string, start long, bytes long, size long, outside_ends boolean, outside_depth long, inside_ends boolean, inside_depth long"
RECORDS = "path string, start long, place int, role string, is_first boolean, value binary, fields int"

State = tuple[bool, int]


class NotClosed(ValueError):
    """A file ends inside a quoted field, a string, an array or an object."""


class CsvCutter:
    """Lines put together to records of comma-separated fields; a field that begins with a quote may hold line breaks."""

    separator, glue = "\n", b"\n"

    def after(self, piece: bytes, state: State, ended: bool = True) -> State:
        inside, place = state[0], 0
        if not inside and b'"' not in piece:
            return False, 0
        while True:
            if inside:
                while (place := piece.find(b'"', place)) >= 0 and piece[place + 1 : place + 2] == b'"':
                    place += 2
                if place < 0:
                    return True, 0
                place = piece.find(b",", place + 1)  # whatever follows a closing quote belongs to the field
                if place < 0:
                    return False, 0
                place += 1
            if piece[place : place + 1] == b'"':
                inside, place = True, place + 1
                continue
            place = piece.find(b',"', place)
            if place < 0:
                return False, 0
            inside, place = True, place + 2

    def text(self, piece: bytes, ended: bool) -> bytes:
        return piece

    def closes(self, state: State) -> bool:
        return not state[0]

    def record(self, value: bytes) -> tuple[bytes, int] | None:
        """The record without its line's carriage return, and its number of fields; nothing for an empty line."""
        value = value.removesuffix(b"\r")
        return (value, self.fields(value)) if value else None

    def fields(self, value: bytes) -> int:
        if b'"' not in value:
            return value.count(b",") + 1
        number, place = 1, 0
        while True:
            if value[place : place + 1] == b'"':
                place += 1
                while (place := value.find(b'"', place)) >= 0 and value[place + 1 : place + 2] == b'"':
                    place += 2
                if place < 0:
                    return number
            place = value.find(b",", place)
            if place < 0:
                return number
            number, place = number + 1, place + 1

    def leftover(self, value: bytes) -> bool:
        return not value


@dataclass(frozen=True)
class JsonCutter:
    """Text up to each closing brace put together to the records of an array (``level`` 1) or of a row of objects (0)."""

    level: int
    separator, glue = "}", b""

    STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
    STRING_END = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)

    def after(self, piece: bytes, state: State, ended: bool = True) -> State:
        inside, depth = state
        if inside:
            end = self.STRING_END.match(piece)
            if not end:
                return True, depth
            piece = piece[end.end() :]
        if b'"' in piece:
            piece = self.STRING.sub(b"", piece)
        opened = piece.find(b'"')
        outside = piece if opened < 0 else piece[:opened]
        depth += outside.count(b"{") + outside.count(b"[") - outside.count(b"]") - outside.count(b"}")
        return opened >= 0, depth - (opened < 0 and ended)

    def text(self, piece: bytes, ended: bool) -> bytes:
        return piece + b"}" if ended else piece

    def closes(self, state: State) -> bool:
        return not state[0] and state[1] == self.level

    def record(self, value: bytes) -> tuple[bytes, int] | None:
        """The object on one line; anything else between objects is an error."""
        bare = value.lstrip(b" \t\r\n")
        if not bare.startswith(b"{"):
            if bare[:1] not in (b",", b"["):
                raise ValueError("JSON holds something else than an array of records")
            bare = bare[1:].lstrip(b" \t\r\n")
        if not bare.startswith(b"{"):
            raise ValueError("JSON holds something else than an array of records")
        return bare.replace(b"\r", b" ").replace(b"\n", b" "), 1

    def leftover(self, value: bytes) -> bool:
        return value.translate(None, b" \t\r\n") in ((b"]", b"[]") if self.level else (b"",))


Cutter = CsvCutter | JsonCutter


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(path, start of its range, size of the file, bytes) of each piece of text, in order within a range."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"),
    )


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(path, start, size, piece, whether it is its range's first) of every row."""
    last = None
    for batch in batches:
        starts, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        names = batch.column(0).dictionary_encode()
        codes = names.indices.to_numpy()
        borders = np.flatnonzero((np.diff(starts, prepend=-1) != 0) | (np.diff(codes, prepend=-1) != 0)).tolist()
        for low, high in zip(borders, [*borders[1:], batch.num_rows], strict=True):
            where = names.dictionary[int(codes[low])].as_py(), int(starts[low])
            for piece in batch.column(3).slice(low, high - low):
                yield *where, int(sizes[low]), piece.as_py(), where != last
                last = where


def sums(cutter: Cutter):
    """One row per range: its bytes, and what becomes of both states it may begin in."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for path, start, size, piece, is_new in ranges(batches):
            if is_new:
                rows.append([path, start, 0, size, (False, 0), (True, 0)])
            row = rows[-1]
            row[2] += len(piece) + len(cutter.separator)
            same = row[4][0] == row[5][0]
            outside = cutter.after(piece, row[4])
            row[5] = (outside[0], row[5][1] + outside[1] - row[4][1]) if same else cutter.after(piece, row[5])
            row[4] = outside
        columns = list(zip(*[(*row[:4], *row[4], *row[5]) for row in rows], strict=True)) or [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        names = [part.split()[0] for part in SUMS.split(", ")]
        yield pa.record_batch([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=names)

    return total


@dataclass(frozen=True)
class FirstStates:
    """The state each range begins in and whether its last piece lacks its separator, by hash of path and start.

    Thirteen bytes a range of input, so about a ten-millionth of the data, go to every task.
    """

    keys: np.ndarray
    inside: np.ndarray
    depth: np.ndarray
    is_open: np.ndarray

    def of(self, key: int) -> tuple[State, bool]:
        place = int(np.searchsorted(self.keys, key))
        return (bool(self.inside[place]), int(self.depth[place])), bool(self.is_open[place])


def first_states(summed: DataFrame, separator: str) -> FirstStates:
    """States composed in the order of ranges; fails for a file that ends inside something."""
    rows = summed.select(F.xxhash64("path", "start").alias("key"), *[part.split()[0] for part in SUMS.split(", ")]).collect()
    rows.sort(key=lambda row: (row["path"], row["start"]))
    held: list[tuple[int, bool, int, bool]] = []
    state: State = (False, 0)
    read = 0
    for place, row in enumerate(rows):
        if place == 0 or rows[place - 1]["path"] != row["path"]:
            state, read = (False, 0), 0
        begun = state
        state = (row["inside_ends"], state[1] + row["inside_depth"]) if state[0] else (row["outside_ends"], state[1] + row["outside_depth"])
        read += row["bytes"]
        is_last = place + 1 == len(rows) or rows[place + 1]["path"] != row["path"]
        # a byte order mark is read over; so much more than the file's size means that the last separator isn't there
        is_open = is_last and read - row["size"] in (len(separator), len(separator) - 3)
        if is_last and (state[0] or (separator == "}" and state[1] + is_open != 0)):
            raise NotClosed(f"{row['path'].rsplit('/', 1)[-1]} ends before its last {'string or record' if separator == '}' else 'quoted field'} is closed")
        held.append((row["key"], *begun, is_open))
    held.sort()
    keys, inside, depth, is_open = zip(*held, strict=True) if held else ((),) * 4
    return FirstStates(np.array(keys, dtype=np.int64), np.array(inside, dtype=bool), np.array(depth, dtype=np.int32), np.array(is_open, dtype=bool))


def cut(cutter: Cutter, states: FirstStates):
    """Whole records of each range; what it begins with belongs to the range before (head), what it ends with to the next (tail)."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in cut_ranges(ranges(batches), cutter, states):
            rows.append(row)
            held += len(row[5])
            if held > BATCH_BYTES or len(rows) > BATCH_ROWS:
                yield record_batch(rows)
                rows, held = [], 0
        yield record_batch(rows)

    return records




def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    names = [part.split()[0] for part in RECORDS.split(", ")]
    return pa.record_batch([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=names)


def cut_ranges(rows: Iterator[tuple[str, int, int, bytes, bool]], cutter: Cutter, states: FirstStates) -> Iterator[tuple]:
    """Rows of RECORDS from pieces in order; each piece waits for the next one to tell whether it is its range's last."""
    waiting: tuple | None = None
    for row in rows:
        if waiting is not None:
            yield from waiting[0].add(waiting[1], ended=True if not row[4] else not waiting[0].is_open)
            if row[4]:
                yield from waiting[0].close()
        part = RangeCut(row[0], row[1], cutter, *states.of(row[2])) if row[4] else waiting[0]
        waiting = (part, row[3])
    if waiting is not None:
        yield from waiting[0].add(waiting[1], ended=not waiting[0].is_open)
        yield from waiting[0].close()


class RangeCut:
    """One range while it is cut."""

    def __init__(self, path: str, start: int, cutter: Cutter, state: State, is_open: bool) -> None:
        self.path, self.start, self.cutter, self.state, self.is_open = path, start, cutter, state, is_open
        self.open: list[bytes] = []
        # a range of an array begins within the text between two records, if not in a record
        self.is_head = start > 0 and (isinstance(cutter, JsonCutter) or state[0])
        self.seen = 0

    def add(self, piece: bytes, ended: bool) -> Iterator[tuple]:
        self.state = self.cutter.after(piece, self.state, ended)
        self.open.append(self.cutter.text(piece, ended))
        if self.cutter.closes(self.state) and (ended or isinstance(self.cutter, CsvCutter)):
            value, self.open = self.cutter.glue.join(self.open), []
            if self.is_head:
                self.is_head = False
                yield self.path, self.start, 0, "head", False, value, 0
            else:
                found = self.cutter.record(value)
                if found:
                    yield self.path, self.start, 1, "record", self.start == 0 and self.seen == 0, *found
                    self.seen += 1

    def close(self) -> Iterator[tuple]:
        if self.open:
            value = self.cutter.glue.join(self.open)
            yield self.path, self.start, 2, "middle" if self.is_head else "tail", self.start == 0 and self.seen == 0, value, 0


def join_cut(cutter: Cutter):
    """Records that reach over ranges, from their tails, middles and heads in order."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, parts, is_first = None, [], False
        rows: list[tuple] = []
        held = 0

        def check() -> None:
            if not cutter.leftover(cutter.glue.join(parts)):
                raise ValueError(f"{path.rsplit('/', 1)[-1]}: text after the last record")

        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if path is not None:
                        check()
                    path, parts = row["path"], []
                if row["role"] == "tail":
                    parts, is_first = [row["value"]], row["is_first"]
                    continue
                parts.append(row["value"])
                if row["role"] == "head":
                    found = cutter.record(cutter.glue.join(parts))
                    parts = []
                    if found:
                        rows.append((path, row["start"], 1, "record", is_first, *found))
                        held += len(found[0])
            if held > BATCH_BYTES:
                yield record_batch(rows)
                rows, held = [], 0
        if path is not None:
            check()
        yield record_batch(rows)

    return joined


def file_records(spark: SparkSession, path: str, cutter: Cutter) -> DataFrame:
    """(path, is_first, value, fields) of all records of a file or a directory of files, staged."""
    read = pieces(spark, path, cutter.separator)
    states = first_states(read.mapInArrow(sums(cutter), SUMS), cutter.separator)
    keyed = read.withColumn("size", F.xxhash64("path", "start"))
    made = session.stage(keyed.mapInArrow(cut(cutter, states), RECORDS))
    broken = made.where("role <> 'record'").repartition("path").sortWithinPartitions("path", "start", "place")
    whole = made.where("role = 'record'").unionByName(broken.mapInArrow(join_cut(cutter), RECORDS))
    return whole.select("path", "is_first", "value", "fields")
