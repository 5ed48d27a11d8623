"""Sharding through fixed virtual slots: records hash into slots, a versioned map gives each slot a shard.

The hash never changes; balancing edits the map. Only sums per slot, whose number is fixed, reach the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilframe.llm.common import free_names

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096

MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_rows long, slot_bytes long, first_place long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard[slot]``, with the rows and bytes counted for each slot."""

    version: int
    shards: int
    shard: tuple[int, ...]
    rows: tuple[int, ...]
    bytes: tuple[int, ...]

    def first_places(self) -> list[int]:
        """Rows of the shard's earlier slots: where the slot's rows begin in their shard."""
        held, places = [0] * self.shards, []
        for shard, rows in zip(self.shard, self.rows, strict=True):
            places.append(held[shard])
            held[shard] += rows
        return places

    def loads(self) -> list[int]:
        found = [0] * self.shards
        for shard, size in zip(self.shard, self.bytes, strict=True):
            found[shard] += size
        return found


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(11)), F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; size is the text's UTF-8 bytes plus 1, null counts none."""
    doc_id, text = F.col(id_column).cast("long"), F.col(text_column)
    return docs.select(
        doc_id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), virtual_slot(doc_id).alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame) -> tuple[list[int], list[int]]:
    """Rows and bytes per slot: partial sums in the tasks, at most SLOTS rows to the driver."""
    counts, sizes = [0] * SLOTS, [0] * SLOTS
    for slot, number, size in rows.groupBy("virtual_slot").agg(F.count(F.lit(1)), F.sum("size")).collect():
        counts[slot], sizes[slot] = number, size
    return counts, sizes


def balanced_map(counts: list[int], sizes: list[int], shards: int) -> SlotMap:
    """Version 0: slots from the largest to the smallest, each to the shard with the fewest bytes so far."""
    heap, shard = [(0, number) for number in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda slot: (-sizes[slot], slot)):
        held, number = heapq.heappop(heap)
        shard[slot] = number
        heapq.heappush(heap, (held + sizes[slot], number))
    return SlotMap(0, shards, tuple(shard), tuple(counts), tuple(sizes))


def rebalanced_map(current: SlotMap, counts: list[int], sizes: list[int]) -> SlotMap:
    """The next version for new sums: slots leave shards above the mean for the lightest shard while that lowers the peak."""
    shard = list(current.shard)
    loads = SlotMap(0, current.shards, current.shard, tuple(counts), tuple(sizes)).loads()
    for slot in sorted(range(len(sizes)), key=lambda slot: (-sizes[slot], slot)):
        home, lightest = shard[slot], min(range(current.shards), key=lambda number: (loads[number], number))
        if sizes[slot] and loads[home] == max(loads) and loads[lightest] + sizes[slot] < loads[home]:
            loads[home] -= sizes[slot]
            loads[lightest] += sizes[slot]
            shard[slot] = lightest
    return SlotMap(current.version + 1, current.shards, tuple(shard), tuple(counts), tuple(sizes))


def grown_map(current: SlotMap) -> SlotMap:
    """The next version with one more shard: slots of the heaviest shards move into it, and no other slot moves."""
    shard, loads, target = list(current.shard), [*current.loads(), 0], sum(current.bytes) / (current.shards + 1)
    by_shard: dict[int, list[int]] = {}
    for slot in sorted(range(len(shard)), key=lambda slot: (current.bytes[slot], -slot)):
        by_shard.setdefault(shard[slot], []).append(slot)
    while True:
        heaviest = max(range(current.shards), key=lambda number: (loads[number], -number))
        fitting = [slot for slot in by_shard.get(heaviest, ()) if 0 < current.bytes[slot] <= target - loads[-1]]
        if not fitting or loads[heaviest] <= loads[-1]:
            break
        slot = fitting[-1]
        by_shard[heaviest].remove(slot)
        shard[slot] = current.shards
        loads[heaviest] -= current.bytes[slot]
        loads[-1] += current.bytes[slot]
    return SlotMap(current.version + 1, current.shards + 1, tuple(shard), current.rows, current.bytes)


def store_map(spark: SparkSession, path: str, chosen: SlotMap) -> None:
    """Write the version as a folder of its own; a version that exists is an error, so no two edits share a number."""
    rows = list(zip(
        [chosen.version] * len(chosen.shard), range(len(chosen.shard)), chosen.shard, chosen.rows, chosen.bytes, chosen.first_places(), strict=True,
    ))
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={chosen.version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(virtual_slot, shard, first_place) of one version: SLOTS rows, whatever the data's size."""
    return spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard", "first_place")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's place in its shard, counted from 0 without gaps.

    A row's place is the number of rows in the shard's earlier virtual slots plus its rank in its own (by id, then
    by text checksum), so no task orders more than one virtual slot.
    """
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(F.broadcast(slot_map), "virtual_slot").withColumn("slot", (F.col("first_place") + F.col("rank") - 1).cast("long")).drop("rank", "first_place")


def shard_table(docs: DataFrame, shards: int, map_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) with shards of nearly equal bytes.

    The map is stored as version 0 under ``map_path`` and read back. A record's slot depends on its id alone, so rows
    that repeat an id stay together, null ids too; null texts have size 1; an empty table gives an empty result and a
    map of empty slots; other columns of ``docs`` are not read.
    """
    from vigilframe.session import stage

    spark = docs.sparkSession
    rows = stage(measured(docs, id_column, text_column))
    store_map(spark, map_path, balanced_map(*slot_sums(rows), shards))
    return assign(rows, load_map(spark, map_path, 0))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write every row of ``docs`` under ``path``/_shard=N; a shard is written by as many tasks as hold its rows.

    If ``docs`` has a column ``_shard``, the folders' name is lengthened by underscores until it is free.
    """
    slot, shard = free_names(docs.columns, "virtual_slot", "_shard")
    named = docs.withColumn(slot, virtual_slot(F.col(id_column)))
    placed = named.join(F.broadcast(slot_map.select(F.col("virtual_slot").alias(slot), F.col("shard").alias(shard))), slot)
    placed.drop(slot).write.partitionBy(shard).parquet(path)
