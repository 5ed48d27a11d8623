import hashlib
import random
import zlib

import duckdb
import pytest

from vigilframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string, depth string, key int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """A dictionary of prefixes."""
    said = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            said.setdefault(conv_id, []).append((turn is not None, turn or 0, role, digest, text))
    own = {conv_id: [(turn[2], turn[4]) for turn in sorted(turns)] for conv_id, turns in said.items()}
    members, ends = {}, {}
    for conv_id in sorted(own):
        h = zlib.crc32(str(conv_id).encode()) % 6
        giver = conv_id - (abs(conv_id) % 100) * (1 if conv_id >= 0 else -1)
        sequence = own.get(giver, [])[:h] + own[conv_id][h:]
        for depth in range(len(sequence) + 1):
            members.setdefault(tuple(sequence[:depth]), []).append(conv_id)
        ends.setdefault(tuple(sequence), []).append(conv_id)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for prefix in sorted(members, key=len, reverse=True):
        saved[prefix] += (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        leaves[prefix] = leaves[prefix] or 1
        if prefix:
            children[prefix[:-1]] += 1
            leaves[prefix[:-1]] += leaves[prefix]
            saved[prefix[:-1]] += saved[prefix]
    return sorted((
        (found[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(found), children[prefix], leaves[prefix], saved[prefix],
         hashlib.sha256(",".join(map(str, ends.get(prefix, []))).encode()).hexdigest())
        for prefix, found in members.items()
    ), key=repr)


def found_rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=repr)


def talks(seed, number=300):
    """Few different turns, so that prefixes branch; groups of copies; turnless ones after rebuilding; long ones."""
    draw, rows = random.Random(seed), []
    for conv_id in range(number):
        conv_id = conv_id - 40 if conv_id % 3 else conv_id * 7
        if draw.random() < 0.25:
            sequence = [("user", "same"), ("assistant", "copied é"), ("user", "text")]
        elif draw.random() < 0.05:
            sequence = [("user", "long")] * draw.randint(20, 60)
        else:
            sequence = [(draw.choice(["user", None, ""]), draw.choice(["a", "b", "cc", None, ""])) for _ in range(draw.randint(1, 7))]
        turns = list(range(len(sequence)))
        if draw.random() < 0.2:
            turns[0] = None
        rows += [(conv_id, turn, *one, "x", 1) for turn, one in zip(turns, sequence, strict=True)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1 << 17, 40, 1])
def test_trie_is_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    rows = talks(1)
    if shard == 40:
        monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found_rows(prefix_trie.conversation_trie(frame)) == brute(rows)


def test_a_tree_is_balanced():
    tree = prefix_trie.TernaryTree()
    for place in prefix_trie.medians_first(1000):
        tree.insert([place], [1], 1, place)
    height = [0] * 1001
    for node in range(1, 1001):
        for below in (tree.low[node], tree.high[node]):
            if below:
                height[below] = height[node] + 1
    assert max(height) <= 10
    assert sorted(prefix_trie.medians_first(7)) == list(range(7))


def test_ties_repeats_and_nulls(spark):
    rows = [
        (None, 0, "user", "nobody", "x", 1), (7, 1, "b", "later role", "x", 1), (7, 1, "a", "earlier role", "x", 1), (7, 1, "a", "earlier role", "x", 1),
        (8, None, None, None, "x", 1), (8, 0, "", "", "x", 1), (9, 0, None, None, "x", 1), (107, 0, "u", "\U0001f600", "x", 1), (100, 0, "u", "\U0001f600", "x", 1),
    ]
    assert found_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_rows(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_is_its_sql(spark, sf_copy):
    folder = sf_copy(conversations=spark.createDataFrame(talks(2), SCHEMA))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op11_prefix_trie"]).fetchall()
    assert found_rows(queries.QUERIES["op11_prefix_trie"](spark, folder)) == sorted(want, key=repr)
