"""Token ids of long and repetitive texts: the library sees each distinct piece of a run once.

A tokenizer that drops white space gives a text the ids of its white-space separated pieces, one after the other:
its normaliser, its special strings and its merges never reach across white space. Texts are therefore cut there,
runs of pieces of bounded bytes are gathered, and the pieces not seen before go to the library as one batch. Seen
pieces are kept in two generations of bounded size, so memory does not depend on the input.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text whose pieces are looked up together.
RUN_BYTES = 1 << 20
#: Bytes of pieces that go to the library in one batch.
BATCH_BYTES = 1 << 18
#: Pieces in a generation of those kept.
KEPT_PIECES = 250_000


def drops_white_space(path: str) -> bool:
    """True if the tokenizer's file says that it keeps matches of a pattern without white space and nothing else."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    first = config.get("pre_tokenizer") or {}
    if first.get("type") == "Sequence":
        first = (first.get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept_only = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return kept_only and not any(part in pattern.replace("[^\\s", "") for part in (" ", "\\s", "."))


def parts_signs(path: str) -> bool:
    """True if the tokenizer's file says that runs of letters and of signs are tokenized each for itself, in lower case.

    Then a word and the signs behind it have the word's ids and the signs', and small ASCII letters meet the model as they are.
    """
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    steps = (config.get("normalizer") or {}).get("normalizers") or []
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = ((splits[0].get("pattern") or {}).get("Regex") or "").split("|")
    return (
        [(step.get("type"), step.get("pattern"), step.get("content")) for step in steps]
        == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and pattern[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] and all(one.startswith("'") for one in pattern[:-3])
        and [(step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) for step in splits[1:]] == [("ByteLevel", False, False)]
        and not any(token["content"].isalpha() or not any(map(str.isalpha, token["content"])) for token in config.get("added_tokens") or [])
    )


def cut_at_space(text: bytes, limit: int) -> Iterator[bytes]:
    """``text`` in slices of about ``limit`` bytes that end before ASCII white space, whatever the words' length."""
    start = 0
    while len(text) - start > limit:
        end = max(text.rfind(space, start + 1, start + limit) for space in (b" ", b"\n", b"\t", b"\r"))
        if end < 0:
            found = [place for place in (text.find(space, start + limit) for space in (b" ", b"\n", b"\t", b"\r")) if place >= 0]
            if not found:
                break
            end = min(found)
        yield text[start:end]
        start = end
    yield text[start:]


def lengths(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """How many ids each piece has; ``ends`` says where each piece's ids end."""
    return np.diff(ends, prepend=0).tolist()


def id_bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of each piece as little-endian 32-bit numbers."""
    raw, stops = ids.astype("<u4").tobytes(), (4 * ends).tolist()
    return [raw[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]


def _one_word(piece: bytes) -> bool:
    """True for Latin letters alone, which stay single letters in lower case and in normal form."""
    if piece.isalpha():
        return True
    text = piece.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class PieceEncoder:
    """Looks up ``value`` of pieces: ``lengths`` or ``id_bytes`` of the ids that the library returns for them."""

    def __init__(self, path: str, value: Callable[[np.ndarray, np.ndarray], list]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it may use
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = drops_white_space(path)
        self.value, self.young, self.old = value, {}, {}
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        #: True for ids that end a word of the tokenizer, if it marks words' ends
        self.ends_word, self.stops = None, {}
        if suffix and self.by_piece:
            self.ends_word = np.zeros(self.library.get_vocab_size(), dtype=bool)
            for token, number in self.library.get_vocab().items():
                self.ends_word[number] = token.endswith(suffix)
            self.stops = dict(zip((b".", b","), self.one_by_one([b".", b","]), strict=True))

    def split(self, text: bytes) -> list[bytes]:
        return text.split() if self.by_piece else [text]

    def slices(self, text: bytes) -> Iterable[bytes]:
        return cut_at_space(text, RUN_BYTES) if self.by_piece and len(text) > RUN_BYTES else (text,)

    def values(self, pieces: Iterable[list[bytes]]) -> dict[bytes, object]:
        """A table with the value of every piece of this run."""
        if len(self.young) > KEPT_PIECES:
            self.old, self.young = self.young, {}
        young, old, asked, stopped = self.young, self.old, set(), []
        for piece in set(chain.from_iterable(pieces)).difference(young):
            if piece in old:
                young[piece] = old[piece]
                continue
            if piece[-1:] in self.stops and _one_word(piece[:-1]):  # a word and a stop: the word's ids, then the stop's
                stopped.append(piece)
                piece = piece[:-1]
                if piece in young:
                    continue
                if piece in old:
                    young[piece] = old[piece]
                    continue
            asked.add(piece)
        batch, held = [], 0
        for piece in asked:
            batch.append(piece)
            held += len(piece)
            if held >= BATCH_BYTES:
                self.encode(batch)
                batch, held = [], 0
        if batch:
            self.encode(batch)
        for piece in stopped:
            young[piece] = young[piece[:-1]] + self.stops[piece[-1:]]
        return young

    def encode(self, batch: list[bytes]) -> None:
        """Single words go as one text, in which the ids that end a word are counted; other pieces go one by one."""
        words, single = [], batch
        if self.ends_word is not None:
            words, single = [], []
            for piece in batch:
                (words if _one_word(piece) else single).append(piece)
        if words:
            ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                self.young.update(zip(words, self.value(ids, ends), strict=True))
            else:
                single = batch
        if single:
            self.young.update(zip(single, self.one_by_one(single), strict=True))

    def one_by_one(self, batch: list[bytes]) -> list:
        found = self.library.encode_batch_fast([piece.decode("utf-8", "replace") for piece in batch], add_special_tokens=False)
        parts = [one.ids for one in found]
        return self.value(np.array(list(chain.from_iterable(parts)), dtype=np.int64), np.cumsum([len(one) for one in parts]))


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in slices of few rows, so that only those stand twice in memory, in Arrow and in Python."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs(texts: list[bytes | None], encoder: PieceEncoder) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Runs of (row, pieces): several short texts, or one slice of a long one, of about RUN_BYTES each."""
    run, held = [], 0
    for row, text in enumerate(texts):
        for part in encoder.slices(text or b""):
            if run and held + len(part) > RUN_BYTES:
                yield run
                run, held = [], 0
                if not encoder.by_piece:
                    encoder.young = {}
            run.append((row, encoder.split(part)))
            held += len(part)
    if run:
        yield run
        if not encoder.by_piece:
            encoder.young = {}
