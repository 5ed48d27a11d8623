"""Helpers that several operators share: tables, row order, id folds, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilframe.session import stage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened where ``columns`` or an earlier name have them already; case doesn't tell names apart."""
    taken, found = {name.lower() for name in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def running_offsets(counts: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``counts`` (one row per file or partition) with the sum of ``value`` over all rows before, as ``name``."""
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long"))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a job runs, Arrow hands tasks batches of this many rows: with long texts the usual number takes much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pack_counts(counts: np.ndarray) -> bytes:
    """The places of counts over zero (16 bits each), then those counts (32 bits each): a few kilobytes for a text."""
    there = np.flatnonzero(counts)
    return there.astype("<u2").tobytes() + counts[there].astype("<u4").tobytes()


def unpack_counts(packed: list[bytes], size: int) -> np.ndarray:
    """Rows of ``size`` counts."""
    rows = np.zeros((len(packed), size), dtype=np.float32)
    for row, data in zip(rows, packed, strict=True):
        number = len(data) // 6
        row[np.frombuffer(data, "<u2", number)] = np.frombuffer(data, "<u4", number, 2 * number)
    return rows


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps: a round is a few joins and partial aggregations on edges, whose
    number never grows, and rounds grow with the logarithm of the longest chain. Every round is a written table, so
    neither lineage nor an executor's loss matters. A node with very many links is met by partial minima and by
    joins that adaptive execution can split.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    nodes = stage(current.select(F.explode(F.array("hi", "lo")).alias("node")).distinct())
    for _ in range(rounds):
        # large star: every neighbour above a node is tied to the smallest node around it
        both = current.union(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage(
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        # small star: every lower neighbour, and the node, is tied to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct()
        )
        after = stage(small)
        same = after.count() == current.count() and after.join(current, ["hi", "lo"], "left_anti").isEmpty()
        current = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(current.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
