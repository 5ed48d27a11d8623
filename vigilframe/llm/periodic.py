"""Periodic runs of words: recursive frequency splitting, then a lag scan of what is left.

A run of period q that is at least four periods long holds each of its words four times or more. A word that occurs
less often in a segment of text can therefore be in none of the segment's runs and splits it; in the shorter segments
further words are too rare, and so on until nothing splits. Most text is gone by then. In the segments that are left
lags are scanned in octaves: a run whose period lies in [P, 2P) holds a multiple of 2P among its first 2P words, so the
word there and its own repetition within [P, 2P) give every lag that need be tried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilframe.llm.encoding import row_slices

#: A run is at least this many periods, and this many words, long.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Words of documents that are looked at together; a longer document is looked at alone.
BATCH_WORDS = 1 << 19

RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def surviving_words(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Words that may be in a run, as numbers that are equal only for equal words of one segment; others are negative and all different.

    ``docs`` (ascending) says which document each word is of; segments begin as whole documents. Only segments that
    were split in the last round are counted again.
    """
    left = -1 - np.arange(codes.size, dtype=np.int64)
    place, segment = np.arange(codes.size), docs
    width, given = int(codes.max(initial=0)) + 1, 0
    while place.size:
        _, word, times = np.unique(segment * width + codes[place], return_inverse=True, return_counts=True)
        rare = times[word] < LEAST_PERIODS
        first = np.flatnonzero(np.diff(segment, prepend=segment[0] - 1))
        lengths = np.diff(first, append=place.size)
        split = np.logical_or.reduceat(rare, first)
        settled = np.repeat(~split & (lengths >= LEAST_WORDS), lengths)
        left[place[settled]] = given + word[settled]
        given += times.size
        again = np.repeat(split, lengths) & ~rare
        before = np.repeat(np.arange(first.size), lengths)[again]
        place = place[again]
        if place.size:
            segment = np.cumsum((np.diff(place, prepend=place[0]) != 1) | (np.diff(before, prepend=before[0]) != 0))
    return left


def _agreement_end(x: np.ndarray, place: int, lag: int) -> int:
    """First place from ``place`` on whose word is not the one ``lag`` further."""
    step = 64
    while place + lag < x.size:
        size = min(step, x.size - lag - place)
        other = np.flatnonzero(x[place : place + size] != x[place + lag : place + lag + size])
        if other.size:
            return place + int(other[0])
        place, step = place + size, min(2 * step, 1 << 16)
    return place


def _agreement_start(x: np.ndarray, place: int, lag: int) -> int:
    """Least place from which on all words up to ``place`` are those ``lag`` further."""
    step = 64
    while place > 0:
        size = min(step, place)
        other = np.flatnonzero(x[place - size : place] != x[place - size + lag : place + lag])
        if other.size:
            return place - size + int(other[-1]) + 1
        place, step = place - size, min(2 * step, 1 << 16)
    return place


def _is_smallest(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """True if no divisor of ``period`` is a period of the stretch; over four periods no other number can be one."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if np.array_equal(x[start : end - part], x[start + part : end]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of ``x``, whose negative numbers are in none."""
    runs: set[tuple[int, int, int]] = set()
    there = np.flatnonzero(x >= 0)
    if not there.size:
        return []
    n = x.size
    order = np.sort(x[there] * n + there)
    breaks = np.flatnonzero(np.diff(there) != 1)
    longest = int(np.diff(np.concatenate(([-1], breaks, [there.size - 1]))).max())
    covered_to, covered_by = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    octave = 1
    while LEAST_PERIODS * octave <= longest:
        anchors = there[there % (2 * octave) == 0]
        low = np.searchsorted(order, x[anchors] * n + np.minimum(anchors + octave, n))
        high = np.searchsorted(order, x[anchors] * n + np.minimum(anchors + 2 * octave, n))
        number = high - low
        anchor = np.repeat(anchors, number)
        within = np.arange(anchor.size) - np.repeat(np.cumsum(number) - number, number)
        lag = order[np.repeat(low, number) + within] % n - anchor
        inside = anchor + 2 * lag <= n
        inside &= ~((anchor + 2 * lag <= covered_to[anchor]) & (lag % covered_by[anchor] == 0))
        anchor, lag = anchor[inside], lag[inside]
        for part in (1.0, 0.5, 0.0):  # a few words of the period first, all of them where these agree
            step = np.maximum(np.minimum(1, lag - 1), ((lag - 1) * part).astype(np.int64))
            same = x[anchor + step] == x[anchor + lag + step]
            anchor, lag = anchor[same], lag[same]
        for place, period in zip(anchor.tolist(), lag.tolist(), strict=True):
            if place + 2 * period <= covered_to[place] and period % int(covered_by[place]) == 0:
                continue
            end = _agreement_end(x, place, period) + period
            if end < place + 2 * period:
                continue
            start = _agreement_start(x, place, period)
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period) and _is_smallest(x, start, end, period):
                runs.add((start, end, period))
                covered_to[start:end], covered_by[start:end] = end, period
        octave *= 2
    return sorted(runs, key=lambda run: (run[0], run[2]))


def repeated_from(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document of the test series: from a place on, those of ids whose checksum ends in 0 repeat a period."""
    if doc_id is None or not words:
        return words
    drawn = zlib.crc32(str(doc_id).encode())
    if drawn % 10:
        return words
    g = drawn // 10
    first = g % len(words)
    period = 1 + (len(words) - first) // (3 + g % 8)
    cycle = words[first : first + period]
    whole, part = divmod(len(words) - first, period)
    return words[:first] + cycle * whole + cycle[:part]


def document_runs(rows: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], str, str]]:
    """Per document its runs as (start, length, period), and the digests of the runs and of the collapsed text."""
    sizes = np.fromiter((len(words) for words in rows), dtype=np.int64, count=len(rows))
    ends = np.cumsum(sizes)
    codes = pa.array([word for words in rows for word in words], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    found = lag_scan(surviving_words(codes, np.repeat(np.arange(len(rows)), sizes)))
    of_doc: dict[int, list[tuple[int, int, int]]] = {}
    for run, doc in zip(found, np.searchsorted(ends, [run[0] for run in found], side="right").tolist(), strict=True):
        of_doc.setdefault(doc, []).append(run)
    for doc, words in enumerate(rows):
        first, kept = int(ends[doc] - sizes[doc]), words
        runs = [(start - first, end - start, period) for start, end, period in of_doc.get(doc, ())]
        if runs:
            keep = np.ones(len(words), dtype=bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            kept = compress(words, keep.tolist())
        listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        yield runs, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, change=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: how many periodic runs its words have, the one of most periods, and two digests.

    A run is a stretch of at least LEAST_WORDS words and LEAST_PERIODS of its smallest period that no neighbouring word
    extends. ``runs_sha256`` is over all runs as ``start,length,period`` lines by start and period, ``collapsed_sha256``
    over the text without what runs repeat after their first period. Runs of equally many periods: the first, then
    the shortest period, is reported. ``change(words, doc_id)`` may alter a document's words first.

    Null and empty texts have no words, no run and the digests of nothing; null ids are no reason to leave a row out;
    repeated rows each have a row; an empty table gives an empty result; other columns are not read. A text is one row
    and is worked on whole; the rest of a task's memory is bounded by BATCH_WORDS.
    """
    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        rows: list[list[bytes]] = []
        held = 0
        for batch in row_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                ids.append(doc_id)
                rows.append(change(words, doc_id) if change else words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield described(ids, rows)
                    ids, rows, held = [], [], 0
        if ids:
            yield described(ids, rows)

    def described(ids: list[int | None], rows: list[list[bytes]]) -> pa.RecordBatch:
        table = []
        for doc_id, words, (runs, runs_digest, text_digest) in zip(ids, rows, document_runs(rows), strict=True):
            best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2])) if runs else (None, None, None)
            exponent = 1000 * best[1] // best[2] if runs else None
            table.append((doc_id, len(words), len(runs), *best, exponent, runs_digest, text_digest))
        columns = list(zip(*table, strict=True))
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [part.split()[0] for part in RESULT.split(", ")]
        return pa.record_batch([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=names)

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return read.mapInArrow(run_rows, RESULT)
