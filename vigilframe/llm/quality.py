"""Quality by nearest labelled neighbours in a latent-semantic space.

Terms are taken from a text's form, so that one model serves every language: pairs and triples of character classes
(runs of a class count once) and how often a word repeats the one before, or any. Term weights use document
frequencies over all documents; a truncated singular value decomposition of a bounded labelled sample gives the space;
every document is compared with every labelled vector, block by block, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilframe.llm.common import arrow_rows, pack_counts, unpack_counts
from vigilframe.session import stage

#: Labelled rows of each class that the space and the neighbours are taken from, about this many by a hash of the id.
SAMPLE_PER_CLASS = 2048
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 8
#: Documents whose vectors are made and compared at once.
BLOCK = 256
#: Characters looked at together.
SLICE = 1 << 20

#: Classes of ASCII signs; letters are 1 (upper case 2), digits 3, all else 15.
SIGNS = (" \t\x0b\x0c\r", "\n", ".", ",", "!?;:", "'\"()[]{}-_", "*", "#", "$%", "&@", "|", "/\\<>=+")
TRIPLES, PAIRS = 16**3, 16**2
REPEATED, SEEN, WORDS = TRIPLES + PAIRS, TRIPLES + PAIRS + 1, TRIPLES + PAIRS + 2
TERMS = TRIPLES + PAIRS + 3

_CLASSES: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point, built once per process."""
    if not _CLASSES:
        table = np.full(0x110000, 15, dtype=np.uint8)
        for code in range(0x110000):
            sign = chr(code)
            if sign.isalpha():
                table[code] = 2 if sign.isupper() else 1
            elif sign.isdigit():
                table[code] = 3
        for number, signs in enumerate(SIGNS):
            for sign in signs:
                table[ord(sign)] = 4 + number if number < 11 else 15
        _CLASSES.append(table)
    return _CLASSES[0]


def term_counts(text: str) -> np.ndarray:
    """How often each term comes in the whole text."""
    counts, table = np.zeros(TERMS, dtype=np.int64), character_classes()
    carried = np.zeros(0, dtype=np.uint16)
    for start in range(0, len(text), SLICE):
        codes = np.frombuffer(text[start : start + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = np.concatenate((carried, table[codes].astype(np.uint16)))
        kept = np.empty(len(classes), dtype=bool)
        kept[0] = True
        np.not_equal(classes[1:], classes[:-1], out=kept[1:])
        runs = classes[kept]
        fresh = len(carried)  # pairs and triples that end in what was carried are counted already
        counts[:TRIPLES] += np.bincount(((runs[:-2] << 8) | (runs[1:-1] << 4) | runs[2:])[max(0, fresh - 2) :], minlength=TRIPLES)
        counts[TRIPLES:REPEATED] += np.bincount(((runs[:-1] << 4) | runs[1:])[max(0, fresh - 1) :], minlength=PAIRS)
        carried = runs[-2:]
    words = text.split()
    counts[REPEATED] = sum(map(operator.eq, words, words[1:]))
    counts[SEEN] = len(words) - len(set(words))
    counts[WORDS] = len(words)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: root of a term's share of the text's terms, times its rarity; no terms give zeros."""
    shares = counts.astype(np.float32)
    shares /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
    np.sqrt(shares, out=shares)
    shares *= idf
    shares /= np.maximum(np.linalg.norm(shares, axis=1, keepdims=True), 1e-9)
    return shares


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    positive: np.ndarray
    prior: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' votes; the prior where there is no similar neighbour."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        placed = weighted(counts, self.idf) @ self.space
        placed /= np.maximum(np.linalg.norm(placed, axis=1, keepdims=True), 1e-9)
        near = placed @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        chosen = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, chosen, axis=1), 0).astype(np.float64) ** SHARPNESS * self.votes[chosen]
        total = votes.sum(axis=1)
        share = (votes * self.positive[chosen]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.clip(np.where(total > 0, share, self.prior), 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of BLOCK rows with the term counts of their last column."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            texts = part.column(part.num_columns - 1)
            yield part, np.stack([term_counts(text.as_py() or "") for text in texts])
    pa.default_memory_pool().release_unused()  # the worker stays for tasks of other stages


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and documents with each term, over all rows; a task sends one sum per term."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(TERMS, dtype=np.int64)
        for part, counts in _counted(batches):
            total += part.num_rows
            found += (counts > 0).sum(axis=0)
        values = np.append(found, total)
        there = np.flatnonzero(values)
        yield pa.record_batch([pa.array(there, pa.int32()), pa.array(values[there])], names=["term", "documents"])

    rows = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(partial, "term int, documents long")
    with arrow_rows(docs.sparkSession, BLOCK):
        sums = {row[0]: row[1] for row in rows.groupBy("term").agg(F.sum("documents")).collect()}
    frequency = np.zeros(TERMS + 1, dtype=np.int64)
    for term, number in sums.items():
        frequency[term] = number
    return int(frequency[TERMS]), frequency[:TERMS]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[list[tuple[int, int, bytes]], dict[int, int]]:
    """About ``per_class`` labelled rows of each class with their term counts, and how many labels each class has.

    ``labels`` has (doc_id, label); rows with nulls are no labels, repeated ones count once. Ids are chosen by a hash,
    so the sample is the same in every run. Only term counts of a fixed length reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("label").cast("int").alias("label")).dropna().where("label IN (0, 1)").distinct()
    totals = {row[0]: row[1] for row in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, number in totals.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_class / number))).otherwise(share)
    drawn = F.pmod(F.xxhash64("labelled", F.lit(3)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    # the hash keeps about as many as asked for: a written table of that size is broadcast, and no text is shuffled
    chosen = stage(known.where(drawn < share))
    joined = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("labelled"))
    # one id may stand on very many rows, which the limit bounds
    bounded = joined.select("doc_id", "label", "text").limit(8 * per_class)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _counted(batches):
            packed = pa.array([pack_counts(row) for row in counts], pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), packed], names=["doc_id", "label", "counts"])

    with arrow_rows(docs.sparkSession, BLOCK):
        found = bounded.mapInArrow(vectors, "doc_id long, label int, counts binary").collect()
    return sorted((row.doc_id, row.label, bytes(row.counts)) for row in found), totals


def fit(sample: list[tuple[int, int, bytes]], totals: dict[int, int], documents: int, frequency: np.ndarray) -> Model:
    """The space and the voters. Votes weigh a class by its share of all labels, whatever share the sample has."""
    idf = (np.log((1 + documents) / (1 + frequency)) + 0.1).astype(np.float32)
    labels = np.array([row[1] for row in sample], dtype=np.int64)
    everything = sum(totals.values())
    prior = totals.get(1, 0) / everything if everything else 0.5
    if not len(sample):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    rows = weighted(unpack_counts([row[2] for row in sample], TERMS), idf)
    width = min(DIMENSIONS, len(sample))
    sketch = rows @ np.random.default_rng(0).standard_normal((TERMS, min(width + 16, len(sample)))).astype(np.float32)
    for _ in range(3):  # power steps bring the sketch close to the leading singular vectors
        sketch = rows @ (rows.T @ np.linalg.qr(sketch)[0])
    basis = np.linalg.qr(sketch)[0]
    space = np.linalg.svd(basis.T @ rows, full_matrices=False)[2][:width].T.astype(np.float32)
    vectors = rows @ space
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    sampled = np.bincount(labels, minlength=2)
    weight = np.array([totals.get(label, 0) / max(sampled[label], 1) for label in (0, 1)])
    return Model(idf, np.ascontiguousarray(space), np.ascontiguousarray(vectors), weight[labels], (labels == 1).astype(np.float64), prior)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    documents, frequency = document_frequencies(docs, text_column)
    sample, totals = labelled_sample(docs, labels, per_class, id_column, text_column)
    return fit(sample, totals, documents, frequency)


def quality_scores(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``name``.

    The model, of a fixed size, is broadcast. Null texts score like empty ones: no terms, no similar neighbour, so the
    share of label 1 among all labels (0.5 without labels). Repeated rows score alike; an empty table stays empty;
    columns of ``docs`` pass unread.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = [f"c{place}" for place in range(len(docs.columns))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _counted(batches):
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(shared.value.scores(counts))], names=[*columns, name])

    source = docs.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(docs.columns, columns, strict=True)], F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField(new, field.dataType) for new, field in zip(columns, docs.schema, strict=True)] + [T.StructField(name, T.DoubleType())])
    scored = source.mapInArrow(score, schema)
    return scored.toDF(*docs.columns, name)


def learning_labels(labels: DataFrame, learns: Column) -> DataFrame:
    """(doc_id, label) of the rows of table ``labels`` that may be learned from."""
    return labels.where(F.coalesce(learns, F.lit(False))).select("doc_id", F.col("quality").alias("label"))
