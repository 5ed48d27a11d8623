"""Token-id files: Simple-8b frames with per-block offsets, in ascending order of document id.

A file is a sequence of frames, a frame holds whole documents and ends with END. Numbers are little-endian:

    b"S8B1" | u32 version | u64 documents, ids, blocks, words, escapes
    i64 doc_id[documents] | u8 has_id[documents] | u64 n_tokens[documents]
    u32 first_word[blocks + 1] | u64 word[words] | u64 escape[escapes] | u32 crc32 of all before

Files are written by Spark's own commit protocol (a frame is a record of the text sink whose line end is END), so a
lost executor's half-written files never count, and any file system that Spark reaches will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigilframe import session
from vigilframe.llm import simple8b
from vigilframe.llm.common import arrow_rows, running_offsets
from vigilframe.llm.encoding import BATCH_BYTES, PieceEncoder, id_bytes, parts_signs, row_slices

MAGIC, VERSION, END = b"S8B1", 1, "\x00S8B-END\n"
#: A frame is closed when it holds this many ids; a longer document has a frame to itself.
FRAME_IDS = 1 << 18
#: Frames in a file, so that a reader may hold a file.
FILE_FRAMES = 64
#: Rows that a task gets from Arrow at once.
BATCH_ROWS = 512
#: Bytes of text that are numbered together, and units whose ids a worker keeps.
RUN_BYTES, KEPT_NUMBERS = 1 << 20, 200_000
#: Words that go to the library as one text.
WORDS_AT_ONCE = 1 << 15
#: ASCII signs without the apostrophe, with which contractions begin.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = simple8b.pack(ids.astype(np.uint64))
    body = b"".join((
        MAGIC, np.array([VERSION], "<u4").tobytes(),
        np.array([len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes)], "<u8").tobytes(),
        np.array([0 if one is None else one for one in doc_ids], "<i8").tobytes(),
        np.array([one is not None for one in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ))
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def parse_frames(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ids) of each frame of a file; raises if a frame's checksum differs."""
    view, at = memoryview(data), 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(view, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    while at < len(view):
        start = at
        if bytes(view[at : at + 4]) != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += 8
        documents, total, blocks, n_words, n_escapes = map(int, take("<u8", 5))
        doc_ids, present, lengths = take("<i8", documents), take("u1", documents), take("<u8", documents)
        offsets, words, escapes = take("<u4", blocks + 1), take("<u8", n_words), take("<u8", n_escapes)
        if zlib.crc32(view[start:at]) != int(take("<u4", 1)[0]):
            raise ValueError(f"the frame at byte {start} is damaged")
        at += len(END)
        ids = simple8b.unpack(words.astype(np.uint64), offsets, escapes.astype(np.uint64), total)
        yield [int(one) if there else None for one, there in zip(doc_ids, present, strict=True)], lengths.astype(np.int64), ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text of ``docs`` and write the files under ``path``.

    Rows are range-partitioned and sorted by id (nulls first; equal ids by a hash of the text, so a repeated id
    doesn't stay in one task), each text is encoded whole without special tokens and closed by ``end_id``. Null
    texts count as empty and give the end id alone; repeated rows are written as often as they come; an empty table
    gives files without frames; other columns are not read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TABLES:
            _TABLES[tokenizer] = IdTable(tokenizer)
        table, end = _TABLES[tokenizer], np.array([end_id], "<u4")
        doc_ids, lengths, coded, held = [], [], [], 0
        for batch in row_slices(batches, BATCH_ROWS):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            open_row, parts = 0, []
            for run in chain(byte_runs(texts, table.encoder), [None]):
                found = run_ids(table, [part for _, part in run]) if run else [None]
                for (row, _), part_ids in zip(run or [(len(texts), None)], found, strict=True):
                    while open_row < row:  # rows before this one are complete
                        doc_ids.append(ids[open_row])
                        lengths.append(sum(map(len, parts)) + 1)
                        coded += [*parts, end]
                        held += lengths[-1]
                        parts, open_row = [], open_row + 1
                        if held >= FRAME_IDS:
                            yield _one_frame(doc_ids, lengths, coded)
                            doc_ids, lengths, coded, held = [], [], [], 0
                    parts.append(part_ids)
        if doc_ids:
            yield _one_frame(doc_ids, lengths, coded)
        pa.default_memory_pool().release_unused()  # the worker stays for tasks of other stages

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    order = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    frames = order.select("doc_id", "text").mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        frames.write.option("lineSep", END).option("maxRecordsPerFile", FILE_FRAMES).option("compression", "none").text(path)


def byte_runs(texts: list[bytes | None], encoder: PieceEncoder) -> Iterator[list[tuple[int, bytes]]]:
    """(row, text) in runs of about RUN_BYTES: several short texts, or a slice of a long one."""
    run, held = [], 0
    for row, text in enumerate(texts):
        for part in encoder.slices(text or b""):
            if run and held + len(part) > RUN_BYTES:
                yield run
                run, held = [], 0
            run.append((row, part))
            held += len(part)
    if run:
        yield run


class IdTable:
    """Units met before by number, with their ids one after the other; where they get too many, the half met least goes.

    A unit is a piece, or, where the tokenizer parts them, the letters a piece begins with (ASCII ones in lower case) or
    the signs behind them. Nothing else of a text is kept.
    """

    def __init__(self, path: str):
        self.encoder = PieceEncoder(path, id_bytes)
        self.parts = self.encoder.ends_word is not None and parts_signs(path)
        self.number: dict[bytes, int] = {}
        #: Of each unit: the place of its first id in the pool, its number of ids, and in how many runs it came
        self.first, self.size, self.met = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.pool, self.held = np.zeros(0, dtype="<u4"), 0

    def _forget(self, keep: int) -> None:
        kept = np.sort(np.argsort(-self.met[: len(self.number)], kind="stable")[:keep])
        units, (ids, sizes), met = list(self.number), gathered(self.pool, self.first[kept], self.size[kept]), self.met[kept] // 2
        self.number, self.held = {}, 0
        self._add(list(map(units.__getitem__, kept.tolist())), sizes, ids)
        self.met[: len(kept)] = met

    def ids(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of some pieces, one after the other, and how many each has."""
        units = self._units(pieces) if self.parts else pieces
        numbered = units.dictionary_encode()
        different = numbered.dictionary
        if self.encoder.by_piece:  # no unit holds white space: joining and splitting is the short way to Python's bytes
            there = pc.greater(pc.binary_length(different), 0).to_numpy(zero_copy_only=False)
            listed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different), b" ")[0].as_py().split()
            # the number of no signs is that of an empty unit
            number = np.full(len(different), -1, dtype=np.int64)
            number[there] = self.numbers(listed)
        else:
            number = self.numbers(different.to_pylist())
        number = number[numbered.indices.to_numpy()]
        ids, taken = gathered(self.pool, self.first[number], np.where(number < 0, 0, self.size[number]))
        return ids, taken[0::2] + taken[1::2] if self.parts else taken

    def _units(self, pieces: pa.BinaryArray) -> pa.BinaryArray:
        """Two units of each piece: its letters and the signs behind them, or the whole piece and nothing."""
        try:
            text = pieces.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8 all over: the library decides
            text = None
        whole = pc.binary_length(pieces).to_numpy()
        offsets = np.concatenate(([0], np.cumsum(whole)))
        letters, plain = whole, np.zeros(len(pieces), dtype=bool)
        if text is not None:
            stems = pc.ascii_rtrim(text, characters=SIGNS)
            plain = only_letters(stems)
            letters = np.where(plain, pc.binary_length(stems).to_numpy(), whole)
        bounds = np.empty(2 * len(pieces) + 1, dtype=np.int32)
        bounds[0::2], bounds[1::2] = offsets, offsets[:-1] + letters
        # a dictionary's bytes stand one after the other from place 0 on
        units = pa.Array.from_buffers(pa.binary(), 2 * len(pieces), [None, pa.py_buffer(bounds), pieces.buffers()[2]])
        if text is None:
            return units
        lower = pc.ascii_lower(units.cast(pa.string())).cast(pa.binary())
        return pc.if_else(pa.array(np.repeat(plain, 2)), lower, units)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """The number of each of some different units."""
        if len(self.number) > KEPT_NUMBERS or not self.encoder.by_piece:
            self._forget(KEPT_NUMBERS // 2 if self.encoder.by_piece else 0)
        found = np.fromiter(map(self.number.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        fresh = np.flatnonzero(found < 0)
        if fresh.size:
            start, asked = len(self.number), list(map(units.__getitem__, fresh.tolist()))
            ascii_words = words = np.zeros(fresh.size, dtype=bool)
            if self.parts:
                with suppress(pa.ArrowInvalid):  # where a unit is not UTF-8, all go one by one
                    texts = pa.array(asked, pa.binary()).cast(pa.string())
                    words = only_letters(texts)
                    ascii_words = words & pc.equal(pc.ascii_lower(texts), texts).to_numpy(zero_copy_only=False) & pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
            for learn, chosen in ((self._learn_ascii, ascii_words), (self._learn_words, words & ~ascii_words), (self._learn, ~words)):
                learn(list(compress(asked, chosen)))
            order = np.argsort(np.where(ascii_words, 0, np.where(words, 1, 2)), kind="stable")
            found[fresh[order]] = np.arange(start, len(self.number))
        self.met[found] += 1
        return found

    def _learn_ascii(self, words: list[bytes]) -> None:
        """Small ASCII letters, which normal form and pre-tokenizer leave as they are, go to the library's model at once."""
        tokenize = self.encoder.library.model.tokenize
        coded = [[token.id for token in tokenize(word)] for word in b" ".join(words).decode().split()]
        self._add(words, np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)), np.fromiter(chain.from_iterable(coded), dtype="<u4"))

    def _learn_words(self, words: list[bytes]) -> None:
        """Other words go to the library as one text, in which the ids that end a word are counted."""
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            ids = np.array(self.encoder.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.encoder.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._add(some, np.diff(ends, prepend=0), ids)
            else:
                self._learn(some)

    def _learn(self, units: list[bytes]) -> None:
        """Other units go to the library one by one, some thousand in a batch."""
        bounds = np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units))) // BATCH_BYTES
        for some in np.split(np.arange(len(units)), np.flatnonzero(np.diff(bounds)) + 1):
            batch = units[some[0] : some[-1] + 1] if len(some) else []
            coded = self.encoder.one_by_one(batch)
            self._add(batch, np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4, np.frombuffer(b"".join(coded), "<u4"))

    def _add(self, units: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        start, end = len(self.number), len(self.number) + len(units)
        self.first, self.size, self.met = _grown(self.first, end), _grown(self.size, end), _grown(self.met, end)
        self.met[start:end] = 0
        self.pool = _grown(self.pool, self.held + len(ids))
        self.first[start:end], self.size[start:end] = self.held + np.cumsum(sizes) - sizes, sizes
        self.pool[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        self.number.update(zip(units, range(start, end), strict=True))


def only_letters(texts: pa.StringArray) -> np.ndarray:
    """True for texts of Latin letters below U+0240 alone, which stay single letters in lower case and in normal form."""
    return pc.and_not(pc.utf8_is_alpha(texts), pc.match_substring_regex(texts, "[^\\x00-\u023f]|\u0130")).to_numpy(zero_copy_only=False)


def gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``size`` values of ``pool`` from each place ``first`` on, one after the other, and ``size``."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], size


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    return values if size <= len(values) else np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), dtype=values.dtype)))


def run_ids(table: IdTable, texts: list[bytes]) -> list[np.ndarray]:
    """The ids of each text of a run.

    The run's pieces are numbered, only different ones are looked up, and their ids are gathered by number at once.
    """
    pieces = pa.array(texts, pa.binary())
    counts = np.ones(len(texts), dtype=np.int64)
    if table.encoder.by_piece:
        split = pc.ascii_split_whitespace(pieces.cast(pa.string(), safe=False))
        pieces, counts = split.flatten(), split.value_lengths().to_numpy()
        filled = pc.greater(pc.binary_length(pieces), 0)
        kept = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
        counts, pieces = np.diff(kept[np.concatenate(([0], np.cumsum(counts)))]), pieces.filter(filled).cast(pa.binary())
    numbered = pieces.dictionary_encode()
    known, sizes = table.ids(numbered.dictionary)
    number = numbered.indices.to_numpy()
    ids, taken = gathered(known, (np.cumsum(sizes) - sizes)[number], sizes[number])
    return np.split(ids, np.concatenate(([0], np.cumsum(taken)))[np.cumsum(counts)[:-1]])


_TABLES: dict[str, IdTable] = {}


def _one_frame(doc_ids: list[int | None], lengths: list[int], coded: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([frame(doc_ids, lengths, np.concatenate(coded))], pa.binary())], names=["frame"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(file, place, doc_id, n_tokens, ids_crc32 and, if asked for, ids) of every document, decoded from the files.

    ``file`` is (part, piece) of the file's name, ``place`` the document's place in its file.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                place = 0
                for doc_ids, lengths, ids in parse_frames(content.as_buffer()):
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                    starts = ends - lengths
                    columns = [
                        pa.array([name.as_py()] * len(doc_ids)), pa.array(np.arange(place, place + len(doc_ids))), pa.array(doc_ids, pa.int64()),
                        pa.array(lengths), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ]
                    names = ["name", "place", "doc_id", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    place += len(doc_ids)
                    yield pa.record_batch(columns, names=names)

    schema = "name string, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    decoded = files.mapInArrow(decode, schema)
    return decoded.withColumns({
        "part": F.regexp_extract("name", r"^part-(\d+)", 1).cast("long"), "piece": F.regexp_extract("name", r"-c(\d+)\.txt$", 1).cast("long"),
    }).drop("name")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): where each document's ids begin in the sequence of all ids, from the files.

    Counts within a file follow its order; what the files before hold is a sum over one row per file.
    """
    rows = session.stage(read_token_files(spark, path))
    within = Window.partitionBy("part", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    files = session.stage(running_offsets(rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("held")), ["part", "piece"], "held", "before"))
    placed = rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(files.drop("held"), ["part", "piece"]).select(
        "doc_id", (F.col("before") + F.col("ahead")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write ``docs`` as token files (to ``path``, or a new folder in the shared checkpoint folder) and index them."""
    spark = docs.sparkSession
    folder = path or f"{session.checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer, end_id, id_column, text_column)
    return token_index(spark, folder)
