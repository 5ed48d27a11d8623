"""Language identification in two steps: the family first, then the languages within it.

Both steps use one-versus-one linear support vector machines on letter n-grams of the whole text. Machines of the second
step only ever see languages of one family, so their weight goes to what tells close relatives apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import pack_counts, unpack_counts

#: ISO 639-1 codes by family; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "dravidian": "kn ml ta te",
    "malayo-polynesian": "id jv mg mi ms su tl",
}
#: Hashed n-grams, orders 1 to 3.
FEATURES = 2048
#: Labelled rows learned from: about this many, divided among the languages, chosen by a hash of the id.
SAMPLE = 4000
#: Words of the piece of each sampled text that is learned beside the whole, so that short texts are known too.
PIECE = (2, 25)
UNKNOWN = "und"
#: Characters looked at together, and documents whose features are held together.
SLICE, BLOCK = 1 << 20, 256

_LETTERS: list[np.ndarray] = []


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((family for family, codes in FAMILIES.items() if code in codes.split()), f"only {language}")


def letter_table() -> np.ndarray:
    """Lower case of every letter's code point, a space for all else; built once per process."""
    if not _LETTERS:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for code in range(0x110000):
            sign = chr(code)
            if sign.isalpha():
                low = sign.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_counts(text: str) -> np.ndarray:
    """Hashed counts of letter n-grams; runs of other signs count as one space; all zeros without a letter."""
    counts, table = np.zeros(FEATURES, dtype=np.int64), letter_table()
    carried = np.array([32], dtype=np.uint32)
    letters = False
    for start in range(0, len(text), SLICE):
        signs = np.concatenate((carried, table[np.frombuffer(text[start : start + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]))
        if start + SLICE >= len(text):
            signs = np.append(signs, np.uint32(32))
        blank = signs == 32
        kept = np.empty(len(signs), dtype=bool)
        kept[0] = True
        np.logical_not(blank[1:] & blank[:-1], out=kept[1:])
        signs, fresh = signs[kept], len(carried)
        letters = letters or bool((signs != 32).any())
        code = np.zeros(len(signs), dtype=np.uint32)
        for order in range(1, 4):
            code = (code[: len(signs) - order + 1] if order == 1 else code[:-1]) * np.uint32(0x01000193) + signs[order - 1 :]
            mixed = (code * np.uint32(0x9E3779B1)) ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount((mixed >> np.uint32(21))[max(0, fresh - order + 1) :].astype(np.int64), minlength=FEATURES)
            if len(signs) <= order:
                break
        carried = signs[-2:]
    return counts if letters else np.zeros(FEATURES, dtype=np.int64)


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Root of each count's share, so rows have length 1, and a constant for the machines' thresholds."""
    rows = np.sqrt(counts.astype(np.float32) / np.maximum(counts.sum(axis=1, keepdims=True), 1).astype(np.float32))
    return np.concatenate((rows, np.full((len(rows), 1), 0.3, dtype=np.float32)), axis=1)


def support_vector_machine(rows: np.ndarray, signs: np.ndarray, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by descent on one dual coordinate at a time."""
    weights, alpha = np.zeros(rows.shape[1], dtype=np.float32), np.zeros(len(rows))
    slack = 1.0 / (2 * cost)
    scale = (rows * rows).sum(axis=1) + slack
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for place in order.permutation(len(rows)):
            gradient = signs[place] * float(rows[place] @ weights) - 1 + slack * alpha[place]
            after = max(0.0, alpha[place] - gradient / scale[place])
            if after != alpha[place]:
                weights += np.float32((after - alpha[place]) * signs[place]) * rows[place]
                alpha[place] = after
    return weights


@dataclass(frozen=True)
class Duel:
    """One-versus-one machines over the classes; a single class wins unopposed."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, names: np.ndarray) -> Duel:
        classes = tuple(sorted(set(names.tolist())))
        pairs, weights = tuple(combinations(range(len(classes)), 2)), []
        for one, other in pairs:
            here = np.flatnonzero((names == classes[one]) | (names == classes[other]))
            weights.append(support_vector_machine(rows[here], np.where(names[here] == classes[one], 1.0, -1.0)))
        return Duel(classes, pairs, np.array(weights, dtype=np.float32).reshape(len(pairs), rows.shape[1]))

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, confidence) of each row: the class with most votes, votes being margins squeezed into 0 to 1."""
        if not self.pairs:
            return np.zeros(len(rows), dtype=np.int64), np.ones(len(rows))
        won = 1.0 / (1.0 + np.exp(-4.0 * np.clip(rows @ self.weights.T, -20, 20)))
        votes = np.zeros((len(rows), len(self.classes)))
        for place, (one, other) in enumerate(self.pairs):
            votes[:, one] += won[:, place]
            votes[:, other] += 1 - won[:, place]
        best = votes.argmax(axis=1)
        return best, votes[np.arange(len(rows)), best] / (len(self.classes) - 1)


@dataclass(frozen=True)
class Model:
    families: Duel
    within: tuple[Duel, ...]

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(counts), UNKNOWN, dtype=object), np.zeros(len(counts))
        known = np.flatnonzero(counts.any(axis=1))
        if len(known) and self.families.classes:
            rows = unit_rows(counts[known])
            family, sure = self.families.decide(rows)
            for number in np.unique(family):
                some = np.flatnonzero(family == number)
                best, inner = self.within[number].decide(rows[some])
                names[known[some]] = np.array(self.within[number].classes, dtype=object)[best]
                scores[known[some]] = sure[some] * inner
        return names.tolist(), np.clip(scores, 0.0, 1.0)


def sampled_texts(docs: DataFrame, learns: Column, rows: int, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> list[tuple[str, int, bytes]]:
    """About ``rows`` labelled texts as (language, part, counts): part 0 is the whole text, part 1 a piece of it.

    Every language gets an equal share; ids are chosen by a hash, so each run learns from the same rows. Rows that do
    not learn, and null languages, ids or texts, are not looked at. Only counts of a fixed length reach the driver.
    """
    complete = F.col(language_column).isNotNull() & F.col(id_column).isNotNull() & F.col(text_column).isNotNull()
    known = docs.where(F.coalesce(learns, F.lit(False)) & complete).select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(language_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    totals = {row[0]: row[1] for row in known.groupBy("lang").count().collect()}
    if not totals:
        return []
    each = max(2, rows // len(totals))
    # one row per language, which the driver has made itself: broadcast, so that no text is shuffled
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, each / number)) for name, number in totals.items()], "of string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    # the hash keeps about as many as asked for; the limit bounds what one id on very many rows could add
    chosen = known.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(drawn < F.col("share")).select("doc_id", "lang", "text").limit(2 * rows + 100)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                names, parts, ids, packed = [], [], [], []
                for doc_id, name, text in zip(*batch.slice(start, BLOCK).to_pydict().values(), strict=True):
                    words, seed = (text or "").split(), zlib.crc32(str(doc_id).encode())
                    length = PIECE[0] + seed % (PIECE[1] - PIECE[0])
                    first = (seed >> 8) % max(1, len(words) - length + 1)
                    for part, some in enumerate((text or "", " ".join(words[first : first + length]))):
                        names.append(name)
                        parts.append(part)
                        ids.append(doc_id)
                        packed.append(pack_counts(letter_counts(some)))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "lang", "part", "counts"])

    found = chosen.mapInArrow(vectors, "doc_id long, lang string, part int, counts binary").collect()
    return [(row[1], row[2], row[3]) for row in sorted((row.doc_id, row.lang, row.part, bytes(row.counts)) for row in found)]


def fit(sample: list[tuple[str, int, bytes]]) -> Model:
    if not sample:
        return Model(Duel((), (), np.zeros((0, FEATURES + 1), np.float32)), ())
    counts = unpack_counts([row[2] for row in sample], FEATURES)
    there = counts.any(axis=1)
    if not there.any():
        return fit([])
    rows, names = unit_rows(counts[there]), np.array([row[0] for row in sample], dtype=object)[there]
    family = np.array([family_of(name) for name in names], dtype=object)
    families = Duel.fit(rows, family)
    return Model(families, tuple(Duel.fit(rows[family == one], names[family == one]) for one in families.classes))


def train(docs: DataFrame, learns: Column, rows: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Model:
    return fit(sampled_texts(docs, learns, rows, id_column, text_column, language_column))


def languages(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    Null texts, texts without a letter, and all texts if nothing was learned, are ``und`` with score 0; otherwise the
    score is the family's confidence times the language's. Repeated rows are predicted alike; an empty table gives an
    empty result; other columns of ``docs`` are not read. The model, of a fixed size per pair of languages, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                names, scores = shared.value.predict(np.stack([letter_counts(text.as_py() or "") for text in part.column(1)]))
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return read.mapInArrow(predict, "doc_id long, lang_pred string, score double")
