"""A corpus pipeline of five stages, each over all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilframe.llm import decontaminate, mixing, quality, simhash
from vigilframe.llm.common import free_names, id_fold, table
from vigilframe.llm.queries import END_ID, QUALITY_FOLDS, QUALITY_LEAST, TOKENIZER
from vigilframe.llm.token_output import token_output
from vigilframe.session import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote for; without a similar one, those of the usual class stay."""
    labels = quality.learning_labels(table(spark, sf_dir, "labels"), id_fold(F.col("doc_id"), QUALITY_FOLDS) != 0)
    [score] = free_names(docs.columns, "quality_score")
    scored = quality.quality_scores(docs, quality.train(docs, labels), name=score)
    return scored.where(F.col(score) >= QUALITY_LEAST).drop(score)


#: Bits in which fingerprints of near copies may differ, and blocks of which they then share four: a similarity of
#: 0.92 by bits. Copies with a few words changed in some hundred often differ in four or five bits.
NEAR_BITS, NEAR_BLOCKS = 5, 9


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints that differ in at most NEAR_BITS bits, the one with the smallest id."""
    return simhash.without_duplicates(docs, shingle=3, distance=NEAR_BITS, blocks=NEAR_BLOCKS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither as it stands nor with other numbers and names."""
    [of] = free_names(docs.columns, "leaked")
    leaked = stage(decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(of)).distinct())
    return docs.join(leaked, F.col("doc_id").cast("long").eqNullSafe(F.col(of)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for."""
    return mixing.emit(docs, mixing.source_rates(mixing.measured(docs)))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and where each row's ids stand in them."""
    return token_output(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Neither SimHash nor the tokenizer can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
