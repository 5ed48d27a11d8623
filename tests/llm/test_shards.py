import zlib

import pytest

from vigilframe.llm import queries, shards
from vigilframe.llm.common import table


def check(found, rows, count):
    by_shard = {}
    for row in found:
        by_shard.setdefault(row.shard, []).append(row)
    assert set(by_shard) <= set(range(count)) and len(found) == len(rows)
    for some in by_shard.values():
        assert sorted(row.slot for row in some) == list(range(len(some)))
    sizes = [sum(row.size for row in by_shard.get(number, ())) for number in range(count)]
    assert sorted((str(row.doc_id), row.size, row.text_crc32) for row in found) == sorted(
        (str(doc_id), len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for doc_id, text in rows)
    return sizes


def test_shards_of_awkward_rows(spark, documents, tmp_path):
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (4, "x" * 50_000), *((100 + number, f"text {number}") for number in range(500))]
    found = shards.shard_table(documents(*rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "size"), 4, str(tmp_path / "map")).collect()
    check(found, rows, 4)
    assert len({row.virtual_slot for row in found if row.doc_id == 3}) == 1
    again = shards.load_map(spark, str(tmp_path / "map"), 0)
    assert again.count() == shards.SLOTS
    empty = shards.shard_table(documents((1, "x")).where("false"), 4, str(tmp_path / "none"))
    assert empty.count() == 0


def test_maps_are_edited_by_version(spark, tmp_path):
    sizes = [(slot * 7919) % 1000 + 1 for slot in range(shards.SLOTS)]
    first = shards.balanced_map([1] * shards.SLOTS, sizes, 16)
    assert max(first.loads()) - min(first.loads()) <= 1000
    grown = shards.grown_map(first)
    assert all(after in (before, 16) for before, after in zip(first.shard, grown.shard, strict=True))
    assert grown.version == 1 and abs(grown.loads()[16] - sum(sizes) / 17) < 1000
    shifted = [size * (5 if first.shard[slot] == 3 else 1) for slot, size in enumerate(sizes)]
    moved = shards.rebalanced_map(first, [1] * shards.SLOTS, shifted)
    assert max(moved.loads()) < max(shards.SlotMap(0, 16, first.shard, first.rows, tuple(shifted)).loads())
    assert sum(a != b for a, b in zip(first.shard, moved.shard, strict=True)) < shards.SLOTS // 4
    path = str(tmp_path / "maps")
    shards.store_map(spark, path, first)
    shards.store_map(spark, path, grown)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        shards.store_map(spark, path, grown)
    assert {row.virtual_slot: row.shard for row in shards.load_map(spark, path, 1).collect()} == dict(enumerate(grown.shard))


def test_written_shards_hold_every_row(spark, documents, tmp_path):
    frame = documents(*((number, f"text {number}") for number in range(200)))
    placed = shards.shard_table(frame, 4, str(tmp_path / "map"))
    shards.write_shards(frame, shards.load_map(spark, str(tmp_path / "map"), 0), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((row.doc_id, row._shard) for row in written.collect()) == sorted((row.doc_id, row.shard) for row in placed.collect())


def test_written_shards_of_a_table_with_such_columns(spark, documents, tmp_path):
    frame = documents(*((number, f"text {number}") for number in range(40))).withColumnRenamed("lang", "_shard").withColumnRenamed("source", "virtual_slot")
    placed = shards.shard_table(frame, 4, str(tmp_path / "map"))
    shards.write_shards(frame, shards.load_map(spark, str(tmp_path / "map"), 0), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((row.doc_id, row._shard_) for row in written.collect()) == sorted((row.doc_id, row.shard) for row in placed.collect())
    assert set(frame.columns) < set(written.columns)


def test_query(spark, sf_dir):
    rows = [(row.doc_id, row.text) for row in table(spark, sf_dir, "documents").collect()]
    found = queries.QUERIES["op3_sharding"](spark, sf_dir).collect()
    sizes = check(found, rows, 16)
    assert max(sizes) <= max(sum(sizes) / 16 * 1.02, max(row.size for row in found) + 1)
    assert {(row.law, row.grown_shard) for row in found} == {("bytes", None)}
