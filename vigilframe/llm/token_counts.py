"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilframe.llm.encoding import PieceEncoder, lengths, row_slices, runs

_ENCODERS: dict[str, PieceEncoder] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is the path of a file for the tokenizers library, readable on every executor. Null texts count as
    empty (0 bytes, 0 tokens); repeated rows and null ids are counted like any other; an empty table gives an empty
    result; other columns of ``docs`` are not read. Texts of any length are cut at safe boundaries, so a task holds
    a bounded run of pieces besides the rows that Arrow hands it.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = PieceEncoder(tokenizer, lengths)
        encoder = _ENCODERS[tokenizer]
        for batch in row_slices(batches):
            texts = batch.column(1).to_pylist()
            tokens = np.zeros(len(texts), dtype=np.int64)
            for run in runs(texts, encoder):
                known = encoder.values(pieces for _, pieces in run)
                for row, pieces in run:
                    tokens[row] += sum(map(known.__getitem__, pieces))
            sizes = np.fromiter((len(text or b"") for text in texts), dtype=np.int64, count=len(texts))
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    counted = read.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
