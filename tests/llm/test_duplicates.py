from itertools import combinations

import numpy as np
import pytest
from brute import brute_components, brute_fingerprint

from vigilframe.llm import common, queries, simhash
from vigilframe.session import stage


def unsigned(value):
    return value & (1 << 64) - 1


@pytest.mark.parametrize("size", [1, 3, 5])
def test_fingerprint(size, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    for text in ["", " \n ", "one", "one Two", "A b C d É Z!", "x y " * 30 + "end", "\xa0non-breaking\x85 stays\x1cone word"]:
        assert simhash.text_fingerprint(text.encode(), size) == brute_fingerprint(text, size), text


def test_close_fingerprints_share_a_key():
    masks = simhash.block_masks(7)
    assert sum(masks) == (1 << 64) - 1
    generator = np.random.default_rng(1)
    for _ in range(200):
        one = int(generator.integers(0, 1 << 63))
        other = one
        for bit in generator.choice(64, 3, replace=False).tolist():
            other ^= 1 << bit
        assert any((one & sum(some)) == (other & sum(some)) for some in combinations(masks, 4))


@pytest.mark.parametrize("part,broadcast", [(2048, 500_000), (8, 0)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, part, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    generator = np.random.default_rng(2)
    centres = generator.integers(0, 1 << 63, 12).tolist()
    values = set(centres)
    for centre in centres[:4]:
        for _ in range(60):
            near = centre
            for bit in generator.choice(16, int(generator.integers(1, 4)), replace=False).tolist():
                near ^= 1 << bit * 4
            values.add(near)
    prints = sorted(values)
    frame = spark.createDataFrame([(value,) for value in prints], "fp long")
    links = simhash.fingerprint_links(frame, part=part)
    for a, b in links.collect():
        assert (unsigned(a) ^ unsigned(b)).bit_count() <= 3
    assert links.count() < 35 * len(prints)
    found = {row.node: row.root for row in common.connected_components(stage(links)).collect()}
    wanted = brute_components(prints, 3)
    for place, value in enumerate(prints):
        assert found.get(value, value) == prints[wanted[place]]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(place, place + 1) for place in range(200)] + [(1000, 1000 + place) for place in range(1, 300)] + [(5000, 5001), (5001, 5002), (5002, 5000), (-7, 9000), (3, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {row.node: row.root for row in common.connected_components(frame).collect()}
    assert all(found[place] == 0 for place in range(201)) and all(found[1000 + place] == 1000 for place in range(300))
    assert found[5002] == 5000 and found[9000] == -7 and len(found) == 201 + 300 + 3 + 2
    assert common.connected_components(frame.where("false")).count() == 0


LONG = " ".join(f"word{number}" for number in range(4000))


def test_near_duplicates_and_what_is_kept(spark, documents):
    rows = [
        (5, "same text here in both"), (3, "same text here in both"), (8, None), (9, ""), (7, " \n"), (None, "same text here in both"), (None, "alone with no id"),
        (20, LONG), (21, LONG + " more"), (3, "same text here in both"), (4, "different words altogether stand here"), (4, "same text here in both"),
    ]
    frame = documents(*rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    found = simhash.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    prints = [brute_fingerprint(text, 3) for _, text in rows]
    groups = brute_components(prints, 3)
    want = []
    for place, (doc_id, _) in enumerate(rows):
        members = [rows[other][0] for other in range(len(rows)) if groups[other] == groups[place] and rows[other][0] is not None]
        want.append((doc_id, prints[place], min(members, default=None)))
    assert sorted(map(str, want)) == sorted(str((row.doc_id, unsigned(row.fp), row.component_id)) for row in found)
    kept = simhash.without_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((row.doc_id or -1, row.text) for row in kept.collect() if (row.text or "").strip()) == [
        (-1, "alone with no id"), (3, "same text here in both"), (4, "different words altogether stand here"), (20, LONG)]
    assert [row.doc_id for row in kept.collect() if not (row.text or "").strip()] == [7]
    assert simhash.near_duplicates(frame.where("false")).count() == 0 and simhash.without_duplicates(frame.where("false")).count() == 0


def test_query(spark, sf_dir):
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[doc_id], 3) for doc_id in ids]
    groups = brute_components(prints, 3)
    found = {row.doc_id: (row.fingerprint, row.component_id) for row in queries.QUERIES["op2_simhash"](spark, sf_dir).collect()}
    assert found == {doc_id: (f"{prints[place]:016x}", ids[groups[place]]) for place, doc_id in enumerate(ids)}
