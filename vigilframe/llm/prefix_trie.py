"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one per range shard, merged at their borders.

Conversations are sequences of turn keys. They are dealt out in ranges of their order and sorted; a task cuts its range
into shards of bounded size, encodes a shard's turns by a dictionary and inserts its sequences medians first, so that
the tree is balanced. Nodes that only one shard can hold are finished there. Shards share nothing but prefixes of their
first and last sequences; for these, sums over shards are put right by what neighbours have in common, which is linear
in the length of the common prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vigilframe.session import stage

#: Turns of a shard; a longer conversation is a shard of its own.
SHARD_TURNS = 1 << 17
#: Nodes of several shards up to which they are broadcast to find their children's parents.
BROADCAST_NODES = 200_000
#: Turns that a conversation may take over from another at most.
MOST_TAKEN = 5

EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
#: Key of the root; any other node's key is the digest of its parent's key and its last turn.
ROOT_KEY = bytes(16)

NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ends string"
)
OUTPUT = "part int, shard int, kind string, " + NODE + ", first_keys array<binary>, last_keys array<binary>, last_sums array<long>"
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


class TernaryTree:
    """A ternary search tree of turn numbers; node 0 is the root of the trie, ``down`` leads to its first turns."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.down, self.parent = [-1], [0], [0], [0], [0]
        self.chars, self.members, self.first = [0], [0], [None]

    def insert(self, turns: list[int], chars: list[int], members: int, first: int) -> int:
        """The node of a sequence; all nodes on the way count its members."""
        turn, low, high, down = self.turn, self.low, self.high, self.down
        self._count(0, members, first)
        above = 0
        for one, length in zip(turns, chars, strict=True):
            node, links, at = down[above], down, above
            while node and turn[node] != one:
                links, at = (low, node) if one < turn[node] else (high, node)
                node = links[at]
            if not node:
                node = links[at] = len(turn)
                for values, value in zip(
                    (turn, low, high, down, self.parent, self.chars, self.members, self.first), (one, 0, 0, 0, above, length, 0, None), strict=True
                ):
                    values.append(value)
            self._count(node, members, first)
            above = node
        return above

    def _count(self, node: int, members: int, first: int) -> None:
        self.members[node] += members
        if self.first[node] is None or first < self.first[node]:
            self.first[node] = first

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        nodes = [node]
        while node:
            node = self.parent[node]
            nodes.append(node)
        return nodes[::-1]

    def totals(self) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and savings of every node; a node's parent was made before it, so one pass from the last node is enough."""
        size = len(self.turn)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for node in range(size - 1, -1, -1):
            saved[node] += (self.members[node] - 1) * self.chars[node]
            leaves[node] = leaves[node] or 1
            if node:
                above = self.parent[node]
                children[above] += 1
                leaves[above] += leaves[node]
                saved[above] += saved[node]
        return children, leaves, saved


def medians_first(number: int) -> Iterator[int]:
    """0 to number - 1, the middle before the middles of both halves."""
    spans = [(0, number)]
    while spans:
        low, high = spans.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(middle + 1, high), (low, middle)]


def rebuilt_conversations(conversations: DataFrame, hundred: int = 100, kinds: int = MOST_TAKEN + 1) -> DataFrame:
    """(conv_id, keys, chars): each conversation's turns as 16-byte keys and code points of their texts.

    Turns are ordered by ``turn`` (null first), then role, then the text's key. Each conversation c begins with the
    first h turns of conversation c - c % hundred, h being the checksum of its id modulo ``kinds``, in place of its own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.char_length(text).alias("chars")).alias("said"),
    )
    own = stage(
        turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
        .select("conv_id", F.transform("said", lambda one: F.struct(one["key"].alias("key"), one["chars"].alias("chars"))).alias("said"))
    )
    givers = own.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("giver"), F.slice("said", 1, kinds - 1).alias("given"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(kinds)).cast("int")
    given = F.coalesce(F.slice("given", F.lit(1), taken), F.slice("said", 1, 0))
    rest = F.slice("said", taken + 1, F.greatest(F.size("said"), F.lit(1)))
    joined = own.withColumn("giver", F.col("conv_id") - F.col("conv_id") % hundred).join(givers, "giver", "left")
    return joined.select("conv_id", F.concat(given, rest).alias("said")).select(
        "conv_id", F.col("said.key").alias("keys"), F.col("said.chars").alias("chars")
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, keys, chars): see ``conversation_trie``."""
    ordered = sequences.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    made = stage(ordered.mapInArrow(shard_tries, OUTPUT))
    nodes = made.where("kind = 'node'")
    parts = made.where("kind = 'shared'").select("key", "parent_key", "conv_id", "depth", *COUNTS)
    shared = stage(
        parts.unionByName(border_corrections(made.where("kind = 'edge'")), allowMissingColumns=True)
        .groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                            *[F.sum(name).alias(name) for name in COUNTS])
    )
    pieces = made.where("ends IS NOT NULL").select("key", "part", "shard", "ends")
    digests = stage(pieces.repartition("key").sortWithinPartitions("key", "part", "shard").mapInArrow(joined_digests, "key binary, ends_sha256 string"))
    shared = shared.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)))
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found_id"))
    if parents.count() <= BROADCAST_NODES:
        parents = F.broadcast(parents)
    named = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
    below = nodes.where("parent_key IS NOT NULL").select("parent_key", *shared.columns[2:]).unionByName(shared.drop("key"))
    found = below.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("found_id"))
    return nodes.where("parent_key IS NULL").select(*named).unionByName(found.select(*named))


def border_corrections(edges: DataFrame) -> DataFrame:
    """What sums over shards count too often or too seldom for nodes that neighbouring shards have in common.

    Where a shard ends and the next begins, all nodes of the common prefix are one: each but the last has a child that
    both count, each node's own saving is short by its text once, and if the shard's last sequence is wholly
    in the next one, a leaf was counted that is none or is counted again. Only shard numbers pass one window.
    """
    order = Window.orderBy("part", "shard").rowsBetween(1, 1)
    following = stage(edges.select("part", "shard").select(
        "part", "shard", F.max("part").over(order).alias("next_part"), F.max("shard").over(order).alias("next_shard")))
    after = edges.select(F.col("part").alias("next_part"), F.col("shard").alias("next_shard"), F.col("first_keys").alias("next_keys"))
    pairs = edges.select("part", "shard", "last_keys", "last_sums").join(following, ["part", "shard"]).join(after, ["next_part", "next_shard"])
    common = F.aggregate(F.zip_with("last_keys", "next_keys", lambda one, other: F.coalesce(one == other, F.lit(False)).cast("int")), F.lit(0), lambda sum, one: sum + one)
    paired = pairs.withColumn("common", common)
    places = paired.select(
        "last_sums", "common", (F.size("last_keys") == F.col("common")).alias("whole"), F.posexplode(F.slice("last_keys", F.lit(1), F.col("common"))).alias("place", "key"),
    )
    before = F.when(F.col("place") > 0, F.try_element_at("last_sums", F.col("place"))).otherwise(F.lit(0))
    return places.select(
        "key", F.when(F.col("place") < F.col("common") - 1, -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("whole"), -1).otherwise(0).cast("long").alias("n_leaves"),
        (F.element_at("last_sums", F.col("common")) - before).alias("saved_tokens"), F.lit(0).cast("long").alias("n_convs"),
    )


def shard_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations of a range, a shard at a time."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[int, list[bytes], list[int]]] = []
    turns = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            some = batch.slice(start, 1024)
            for row in zip(*(some.column(name).to_pylist() for name in ("conv_id", "keys", "chars")), strict=True):
                if held and turns + len(row[1]) + 1 > SHARD_TURNS:
                    yield from shard_rows(held, part, number)
                    held, turns, number = [], 0, number + 1
                held.append(row)
                turns += len(row[1]) + 1
    if held:
        yield from shard_rows(held, part, number)


def shard_rows(rows: list[tuple[int, list[bytes], list[int]]], part: int, number: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: finished ones, those that other shards may share, and the two edges."""
    words = sorted({key for _, keys, _ in rows for key in keys})
    code = {key: place for place, key in enumerate(words)}
    sequences: list[tuple[list[bytes], list[int], list[int]]] = []
    for conv_id, keys, chars in rows:
        if not sequences or sequences[-1][0] != keys:
            sequences.append((keys, chars, []))
        sequences[-1][2].append(conv_id)
    tree, ends = TernaryTree(), {}
    for place in medians_first(len(sequences)):
        keys, chars, members = sequences[place]
        node = tree.insert([code[key] for key in keys], chars, len(members), members[0])
        ends[node] = members
        if place == 0:
            first = node
        if place == len(sequences) - 1:
            last = node
    children, leaves, saved = tree.totals()
    depth = [0] * len(tree.turn)
    for node in range(1, len(depth)):
        depth[node] = depth[tree.parent[node]] + 1

    edge_keys: dict[int, bytes] = {0: ROOT_KEY}
    paths = [tree.path(first), tree.path(last)]
    for path in paths:
        for above, node in zip(path, path[1:], strict=False):
            edge_keys[node] = hashlib.sha256(edge_keys[above] + words[tree.turn[node]]).digest()[:16]
    table: list[tuple] = []
    for node, members in enumerate(tree.members):
        above = tree.parent[node]
        ended = ",".join(map(str, ends[node])) if node in ends else None
        counts = members, children[node], leaves[node], saved[node]
        above_key = edge_keys.get(above) if node else None
        if node in edge_keys:
            table.append(("shared", edge_keys[node], above_key, tree.first[node], depth[node], None, *counts, None, ended))
        else:
            digest = EMPTY_DIGEST if ended is None else hashlib.sha256(ended.encode()).hexdigest()
            known = tree.first[above] if above_key is None else None
            table.append(("node", None, above_key, tree.first[node], depth[node], known, *counts, digest, None))
    sums = np.cumsum([tree.chars[node] for node in paths[1]]).tolist()
    edges = [[[edge_keys[node] for node in path]] for path in paths]
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary())]
        + [(name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", *COUNTS)]
        + [("ends_sha256", pa.string()), ("ends", pa.string()), ("first_keys", pa.list_(pa.binary())), ("last_keys", pa.list_(pa.binary())),
           ("last_sums", pa.list_(pa.int64()))]
    )
    for start in range(0, len(table), 1 << 14):
        some = table[start : start + (1 << 14)]
        columns = [[part] * len(some), [number] * len(some), *zip(*some, strict=True), *[[None] * len(some)] * 3]
        yield pa.record_batch([pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)], schema=schema)
    edge = [[part], [number], ["edge"], *[[None]] * 11, *edges, [sums]]
    yield pa.record_batch([pa.array(values, field.type) for values, field in zip(edge, schema, strict=True)], schema=schema)


def joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, joined by commas in their order; a piece at a time is held."""
    key, digest = None, hashlib.sha256()
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for one, piece in zip(batch.column(0), batch.column(3), strict=True):
            one, piece = one.as_py(), piece.as_py().encode()
            if one != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = one, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece)
    if key is not None:
        done.append((key, digest.hexdigest()))
    yield pa.record_batch([pa.array([one for one, _ in done], pa.binary()), pa.array([text for _, text in done], pa.string())], names=["key", "ends_sha256"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, named by its smallest member's conv_id and its depth.

    Columns: conv_id, depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty, so they equal empty ones; turns that tie are ordered by role, then by text key;
    rows that repeat a turn are further turns. Rows without a conv_id belong to no conversation. A conversation left without turns is a
    member of the root alone; an empty table has no node. Turns are told apart by 128 bits of a SHA-256. Other columns
    are not read. Texts stay where they are read: what is dealt out is a key and a length per turn, so a task holds a
    conversation whole as some 30 bytes a turn.
    """
    return prefix_trie(rebuilt_conversations(conversations))
