"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

A fingerprint is cut into BLOCKS blocks. Two fingerprints with at most ``distance`` differing bits agree in at least
BLOCKS - distance of them, so they share the key of some choice of that many blocks; only fingerprints that share a key
are compared, and each comparison is verified bit by bit. Equal fingerprints are one from the start, so copies
never meet each other. What a key's fingerprints give is a spanning set of links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import connected_components, free_names
from vigilframe.session import stage

#: Blocks of a fingerprint: with distance 3, keys are 4 of 7 blocks, 36 or 37 bits, and there are 35 of them.
BLOCKS = 7
#: Fingerprints of one key that are compared in one place; a key with more is dealt out as pairs of parts.
PART = 2048
#: Up to so many keys that three fingerprints or more meet at (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 15

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: bytes, shingle: int) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' XXH64 values (seed 42)."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest, size = xxhash.xxh64_intdigest, len(words)
    ones, total = np.zeros(64, dtype=np.int64), max(1, size - shingle + 1)
    for start in range(0, total, SHINGLES):
        part = words[start : min(start + SHINGLES, total) + shingle - 1]
        parts = zip(*(part[place:] for place in range(shingle)), strict=False) if size >= shingle else (tuple(words),)
        hashes = np.fromiter((digest(b" ".join(one), 42) for one in parts), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every whole text as a signed 64-bit integer, and a hash of the text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they come. A text of
    fewer words than a shingle is one shingle of all of them; null, empty and blank texts have fingerprint 0.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((text_fingerprint(text.as_py() or b"", shingle) for text in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), batch.column(1)], names=["doc_id", "fp", "text_hash"])

    text = F.col(text_column).cast("binary")
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return read.mapInArrow(compute, "doc_id long, fp long, text_hash long")


def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * place / blocks) for place in range(blocks + 1)]
    return [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Array of keys, one per choice of blocks, from the choice and its bits: fingerprints within ``distance`` share one.

    A key is a hash, so a row to shuffle is two longs; keys that fall together by chance only cost a comparison.
    """
    masks = block_masks(blocks)
    chosen = [sum(some) for some in combinations(masks, blocks - distance)]
    return F.array(*[F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(mask)).cast("long"))) for number, mask in enumerate(chosen)])


def spanning_links(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``distance`` bits between the two lists connect."""
    values = np.unique(np.concatenate((left, right)))
    root = np.arange(len(values))
    links = []
    places = [np.searchsorted(values, np.unique(one)) for one in (left, right)]
    for here in places[0]:
        near = places[1][np.bitwise_count(values[places[1]] ^ values[here]) <= distance]
        for other in near[root[near] != root[here]]:
            if root[other] != root[here]:
                links.append((int(values[here]), int(values[other])))
                low, high = sorted((root[here], root[other]))
                root[root == high] = low
    return links


def fingerprint_links(distinct: DataFrame, distance: int = 3, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(a, b): links among the distinct values of column fp that connect all that lie within ``distance`` bits.

    A key met by one fingerprint ends in the first aggregation. A key with more than ``part`` fingerprints is split
    by a hash into parts, and each pair of parts is a group of its own, so a group never holds more than about twice
    ``part`` values and none is left out.
    """
    # a small table makes many keys: a stated number of partitions, because its size doesn't show the work
    dealt_out = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = dealt_out.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))
    counted = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("one"), F.max("fp").alias("two")).where("n > 1"))
    # two fingerprints are a pair as they stand
    pairs = counted.where("n = 2").select(F.col("one").alias("a"), F.col("two").alias("b"))
    close = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    more = counted.where("n > 2").select("key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    if more.count() <= BROADCAST_KEYS:
        more = F.broadcast(more)
    member = keyed.join(more, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    dealt = member.select(
        "key", "fp", "own",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
            F.least("own", other).alias("low"), F.greatest("own", other).alias("high")))).alias("at"),
    )
    groups = dealt.select("key", "fp", "own", "at.low", "at.high").groupBy("key", "low", "high").agg(
        F.collect_list(F.when(F.col("own") == F.col("low"), F.col("fp"))).alias("lefts"),
        F.collect_list(F.when(F.col("own") == F.col("high"), F.col("fp"))).alias("rights"),
    ).select("lefts", "rights")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                found.update(spanning_links(left.values.to_numpy(), right.values.to_numpy(), distance))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return close.union(groups.mapInArrow(verify, "a long, b long")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = BLOCKS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): component_id is the smallest id that links of at most ``distance`` bits reach.

    ``root``, the least fingerprint of a component, tells components apart where ids are null.

    Every row of ``docs`` has a row here, repeated rows too; null ids are no candidates for component_id unless the
    component has no other; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    marked = stage(fingerprints(docs, shingle, id_column, text_column))
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stage(connected_components(stage(fingerprint_links(distinct, distance, blocks))))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(placed.join(least, "root").select("fp", "root", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def without_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = BLOCKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id's (null ids last), of that the least text hash.

    Rows that repeat id and text are one document and leave one row. Other columns pass unread.
    """
    found = near_duplicates(docs, shingle, distance, blocks, id_column, text_column)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("kept")
    keys = free_names(docs.columns, "kept_id", "kept_null", "kept_hash")
    kept = stage(found.groupBy("root").agg(first).select(
        F.coalesce("kept.doc_id", F.lit(0)).alias(keys[0]), F.col("kept.without").alias(keys[1]), F.col("kept.text_hash").alias(keys[2])))
    doc_id = F.col(id_column).cast("long")
    named = docs.withColumns({
        keys[0]: F.coalesce(doc_id, F.lit(0)), keys[1]: doc_id.isNull(), keys[2]: F.xxhash64(F.col(text_column).cast("binary")),
    })
    return named.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{name}`") for name in docs.columns])


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
