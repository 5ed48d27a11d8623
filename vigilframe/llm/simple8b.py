"""Simple-8b words in numpy: a selector in the top four bits, then as many ids as its lanes hold.

Ids are packed in blocks of BLOCK, each starting on a word of its own, so any block can be decoded alone and all
blocks of a frame can be coded and decoded side by side. Lanes that a block's last word leaves free are zero. An id of
more than 60 bits is an escape: its word has selector 0 and the place of the id in a list beside the words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Selector s (from 1) packs LANES[s - 1] = (ids, bits) ids in a word.
LANES = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([1] + [count for count, _ in LANES], dtype=np.int64)
LOW = np.uint64((1 << 60) - 1)


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes, 0 for 0; exact for all 64-bit values."""
    high = (ids >> np.uint64(32)).astype(np.uint32)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    width = np.frexp(low.astype(np.float64))[1]
    if high.any():
        width = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, width)
    return width.astype(np.uint8)


def densest(width: np.ndarray, places: int) -> np.ndarray:
    """The selector with most ids that fits from each of the first ``places`` columns; 0 where an escape is needed."""
    chosen, widest, span = np.zeros((len(width), places), dtype=np.uint8), width.copy(), 1
    for selector in range(len(LANES), 0, -1):
        count, bits = LANES[selector - 1]
        while span < count:
            step = min(span, count - span)
            widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            span += step
        fits = widest[:, :places] <= bits
        if not fits.any():  # denser selectors ask for more ids of fewer bits
            break
        chosen[fits] = selector
    return chosen


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, escapes): offsets has the first word of each block, and the number of words at its end."""
    total = len(ids)
    blocks = -(-total // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    padded = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    whole = np.zeros(blocks * BLOCK, dtype=np.uint64)
    whole[:total] = ids
    padded[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    width = bit_widths(padded.ravel()).reshape(blocks, BLOCK + 60)
    chosen = np.concatenate((densest(width, BLOCK - 60), densest(width[:, BLOCK - 60 :], 60)), axis=1)
    lengths = np.full(blocks, BLOCK, dtype=np.int64)
    lengths[-1] = total - (blocks - 1) * BLOCK
    place, rows = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    taken_rows, taken_places, taken_selectors = [], [], []
    while len(rows):
        selectors = chosen[rows, place]
        taken_rows.append(rows)
        taken_places.append(place)
        taken_selectors.append(selectors)
        place = place + COUNTS[selectors]
        going = place < lengths[rows]
        rows, place = rows[going], place[going]
    rows, places, selectors = map(np.concatenate, (taken_rows, taken_places, taken_selectors))
    order = np.argsort(rows * np.int64(BLOCK) + places)
    rows, places, selectors = rows[order], places[order], selectors[order]
    words = selectors.astype(np.uint64) << np.uint64(60)
    flat, starts = padded.ravel(), rows * (BLOCK + 60) + places
    for selector in np.unique(selectors[selectors > 0]):
        count, bits = LANES[selector - 1]
        here = np.flatnonzero(selectors == selector)
        packed, first = words[here], starts[here]
        for lane in range(count):
            packed |= flat[first + lane] << np.uint64(lane * bits)
        words[here] = packed
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=blocks)))).astype(np.uint32)
    return words, offsets, flat[starts[escaped]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, total: int) -> np.ndarray:
    """The ids of all blocks; a slice of ``words`` and ``offsets`` from a block's start decodes those blocks only."""
    out = np.zeros(total, dtype=np.uint64)
    if not total:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    per_block = np.diff(offsets.astype(np.int64))
    first_word = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(per_block)), per_block)
    starts = ends - counts
    starts = starts - starts[first_word][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, total)
    for selector in np.unique(selectors):
        here = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[starts[here]] = escapes[(words[here] & LOW).astype(np.int64)]
            continue
        count, bits = LANES[selector - 1]
        mask, body, first, last = np.uint64((1 << bits) - 1), words[here], starts[here], limit[here]
        for lane in range(count):
            inside = first + lane < last
            if inside.all():
                out[first + lane] = (body >> np.uint64(lane * bits)) & mask
            else:
                out[first[inside] + lane] = (body[inside] >> np.uint64(lane * bits)) & mask
    return out
