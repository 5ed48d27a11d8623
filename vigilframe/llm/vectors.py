"""Near copies among embeddings by product quantisation: coarse lists, residual codes, table look-ups, exact cosines.

Every different vector stands once, whole, in the list of its nearest centre (its home) and as a code of a few bytes in
every list whose vectors may be close to it. In a list each whole vector meets all codes by sums of looked-up products;
a code's own rounding error is added to the reach, so no close pair is lost there. Only vectors with a candidate are
brought together a second time, whole, and compared exactly. No pair ever leaves the group it is found in: a group
returns how many links each vector has in it and what it hangs together with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilframe.llm.common import connected_components
from vigilframe.session import stage

#: Parts of a residual that are coded apart, and code words of each part.
SUBSPACES, WORDS = 8, 256
#: Vectors that centres and code words are fitted on, the first by key; every vector is indexed.
SAMPLE = 1 << 14
#: Vectors per coarse list that are aimed at, and the least and greatest number of lists.
LIST_SIZE, FEWEST_LISTS, MOST_LISTS = 2048, 16, 4096
#: Whole vectors and codes (or vectors to compare with) that meet in one group; longer lists become several groups.
QUERIES, MEMBERS = 2048, 4096
#: Whole vectors that are looked up together in a group.
BLOCK = 256
#: Share of the radius that a neighbour may lie beyond the border of a list. At 1 no close pair can be missed; a
#: displacement of which over half points straight across a border is improbable in many dimensions.
REACH = 0.5
#: Look-ups are in single precision.
SLACK = 1e-4


@dataclass(frozen=True)
class Index:
    """Centres of the coarse lists and code words of the residuals, over vectors filled up with zeros to ``width``."""

    centres: np.ndarray
    words: np.ndarray
    radius: float
    reach: float

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def margins(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's home, and how far it is from the border between its home and each other list (home: 0)."""
        far = (self.centres**2).sum(1) - 2 * units @ self.centres.T
        home = far.argmin(1)
        apart = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(2), 1e-18)) if len(self.centres) <= 64 else None
        between = apart[home] if apart is not None else np.sqrt(np.maximum(self._apart(home), 1e-18))
        return home, (far - far[np.arange(len(units)), home][:, None]) / (2 * between)

    def _apart(self, home: np.ndarray) -> np.ndarray:
        norms = (self.centres**2).sum(1)
        return norms[home][:, None] + norms[None] - 2 * self.centres[home] @ self.centres.T

    def within(self, margins: np.ndarray) -> np.ndarray:
        return margins <= self.reach * self.radius

    def codes(self, units: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code words of each vector's residual, and the least looked-up product that a close vector has with it."""
        parts = (units - self.centres[home]).reshape(len(units), SUBSPACES, -1)
        coded = np.empty((len(units), SUBSPACES), dtype=np.uint8)
        known = self.centres[home].reshape(parts.shape).copy()
        for part in range(SUBSPACES):
            words = self.words[part]
            coded[:, part] = ((words**2).sum(1) - 2 * parts[:, part] @ words.T).argmin(1)
            known[:, part] += words[coded[:, part]]
        known = known.reshape(len(units), -1)
        error = np.sqrt(((units - known) ** 2).sum(1))
        return coded, (1 + (known**2).sum(1) - (self.radius + error) ** 2) / 2 - SLACK

    def products(self, units: np.ndarray, home: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """Product of each whole vector with each coded one: its centre's, plus one looked-up number per part."""
        total = (units @ self.centres.T).astype(np.float32)[:, home]
        parts = units.reshape(len(units), SUBSPACES, -1)
        for part in range(SUBSPACES):
            total += (parts[:, part] @ self.words[part].T).astype(np.float32)[:, coded[:, part]]
        return total


def lloyd(points: np.ndarray, number: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of ``points`` after a few rounds; where there are fewer points than centres, centres repeat."""
    generator = np.random.default_rng(seed)
    centres = points[generator.permutation(max(len(points), number))[:number] % len(points)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([
            ((centres**2).sum(1) - 2 * points[start : start + 4096] @ centres.T).argmin(1) for start in range(0, len(points), 4096)
        ])
        order = np.argsort(nearest, kind="stable")
        found, first = np.unique(nearest[order], return_index=True)
        centres[found] = np.add.reduceat(points[order], first, axis=0) / np.diff(first, append=len(points))[:, None]
    return centres


def fit(units: np.ndarray, lists: int, least: float, reach: float = REACH) -> Index:
    """An index fitted on unit vectors."""
    centres = lloyd(units, lists)
    far = (centres**2).sum(1) - 2 * units @ centres.T
    parts = (units - centres[far.argmin(1)]).reshape(len(units), SUBSPACES, -1)
    words = np.stack([lloyd(parts[:, part], WORDS) for part in range(SUBSPACES)])
    return Index(centres, words, math.sqrt(max(0.0, 2 - 2 * least)), reach)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(sizes), width))
    within = np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[np.repeat(np.arange(len(sizes)), sizes), within] = flat
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows by their norms; dividing by the greatest component first keeps squares from overflowing or vanishing."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-320)[:, None]
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def comparable(vector: Column, label: Column) -> Column:
    """True for rows that can have links: a label, and a vector of finite components that are not all zero."""
    whole = F.forall(vector, lambda one: one.isNotNull() & ~F.isnan(one) & (F.abs(one) != F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & whole & F.exists(vector, lambda one: one != 0), F.lit(False))


def vector_key(vector: Column, label: Column) -> Column:
    """16 bytes that tell vectors of a label apart: two 64-bit hashes."""
    halves = [F.xxhash64(label, vector), F.xxhash64(vector, label, F.lit(1))]
    return F.unhex(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in halves]))


PLACED = "label {0}, size int, list int, key binary, vector array<{1}>, home int, coded binary, bar float"
GROUP = ["label", "size", "list"]


def dealt_out(placed: DataFrame, whole: Column) -> DataFrame:
    """``placed`` with the group that a row is compared in: lists of many rows are dealt into a grid by key.

    The rows per list are counted first; whole vectors and others repeat along the grid's other side.
    """
    counts = stage(placed.groupBy(*GROUP).agg(F.count_if(whole).alias("queries"), F.count_if(~whole).alias("members")))
    across, down = F.ceil(F.col("queries") / QUERIES), F.ceil(F.col("members") / MEMBERS)
    drawn = F.xxhash64("key")
    joined = placed.join(counts.where((F.col("queries") > 0) & (F.col("members") > 0)), GROUP)
    grid = F.when(
        whole, F.transform(F.sequence(F.lit(0).cast("long"), down - 1), lambda one: F.struct(F.pmod(drawn, across).alias("across"), one.alias("down")))
    ).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), across - 1), lambda one: F.struct(one.alias("across"), F.pmod(drawn, down).alias("down")))
    )
    dealt = joined.withColumn("cell", F.explode(grid)).drop("queries", "members").select("*", "cell.across", "cell.down").drop("cell")
    # the join deals rows by list alone, which would be good enough for grouping by list and cell: a long list in one task
    return dealt.repartition(*GROUP, "across", "down")


def components(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a table of links; every row and column is looked at once."""
    rows, columns = np.full(hit.shape[0], -1), np.full(hit.shape[1], -1)
    for start in np.flatnonzero(hit.any(1)).tolist():
        if rows[start] >= 0:
            continue
        front = np.array([start])
        while front.size:
            rows[front] = start
            reached = np.flatnonzero(hit[front].any(0) & (columns < 0))
            columns[reached] = start
            front = np.flatnonzero(hit[:, reached].any(1) & (rows < 0))
    return rows, columns


def near_copies(
    vectors: DataFrame, least: float = 0.98, reach: float = REACH,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``; links have equal labels and a cosine of ``least`` or more.

    Null labels, and vectors that are null, empty, zero or hold a null or a number that is not finite, link with nothing.
    Vectors of different length never link. Rows with equal vectors and labels are indexed once and count as linked
    with each other. A component's id is the smallest id that links reach; null ids are no candidates unless there is
    no other. Repeated ids are different rows; other columns are not read; an empty table gives an empty result.

    Centres and code words are fitted on at most SAMPLE vectors; with ``reach`` 1 every link is found, with less nearly
    every (the query's recall is measured against brute force in the tests).
    """
    spark = vectors.sparkSession
    label, vector = F.col(label_column), F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))
    kinds = {field.name: field.dataType for field in rows.schema}
    sound = comparable(F.col("vector"), F.col("label"))
    key = vector_key(F.col("vector"), F.col("label"))
    classes = stage(
        rows.where(sound).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"key": key, "size": F.size("vector")})
    )
    keyed = rows.select("vec_id", F.when(sound, key).alias("key"))
    held = classes.agg(F.count(F.lit(1)).alias("number"), F.max("size").alias("size")).first()
    if held["number"]:
        linked = stage(_linked(spark, classes, held["number"], held["size"], least, reach, kinds))
        informed = stage(classes.select("key", "first", "copies").join(linked, "key", "left").select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "first").alias("component")))
        keyed = keyed.join(informed, "key", "left")
    else:
        keyed = keyed.withColumns({"links": F.lit(0), "component": F.lit(None).cast("long")})
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return keyed.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _linked(spark: SparkSession, classes: DataFrame, number: int, size: int, least: float, reach: float, kinds: dict) -> DataFrame:
    """(key, links, component) of the classes that have a link to another class."""
    width = -(-size // SUBSPACES) * SUBSPACES
    sample = unit(matrix(classes.orderBy("key").limit(SAMPLE).select("vector").toArrow().column(0), width))
    lists = min(MOST_LISTS, max(FEWEST_LISTS, 1 << max(0, round(math.log2(number / LIST_SIZE)))))
    index = fit(sample, lists, least, reach)
    kind = kinds["label"].simpleString(), kinds["vector"].elementType.simpleString()

    placed = classes.select("label", "size", "key", "vector").mapInArrow(placing(index), PLACED.format(*kind))
    groups = dealt_out(placed, F.col("vector").isNotNull()).groupBy(*GROUP, "across", "down")
    flagged = stage(groups.applyInArrow(candidates(index), f"label {kind[0]}, size int, list int, key binary, whole boolean").distinct())

    met = flagged.join(classes.select("key", "vector", "copies"), "key")
    groups = dealt_out(met, F.col("whole")).groupBy(*GROUP, "across", "down")
    found = stage(groups.applyInArrow(verified(index, least), "key binary, root binary, links long"))

    nodes = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    named = stage(nodes.join(classes.select("key", "first"), "key"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    return named.join(smallest, "root").select("key", "component").join(links, "key")


def placing(index: Index):
    """Rows of classes as one whole vector in its home, and one code in every list within reach."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK * 4):
                batch = whole.slice(start, BLOCK * 4)
                units = unit(matrix(batch.column("vector"), index.width))
                home, margins = index.margins(units)
                coded, bar = index.codes(units, home)
                row, place_list = np.nonzero(index.within(margins))
                queries = np.arange(batch.num_rows)
                taken = pa.array(np.concatenate([queries, row]))
                own = np.concatenate([np.ones(queries.size, bool), np.zeros(row.size, bool)])
                lists = np.concatenate([home, place_list]).astype(np.int32)
                gone = pa.array(np.where(own, taken.to_numpy(), 0), mask=~own)
                codes = pa.array([None] * queries.size + [coded[one].tobytes() for one in row.tolist()], pa.binary())
                yield pa.record_batch(
                    [
                        batch.column("label").take(taken), batch.column("size").take(taken), pa.array(lists), batch.column("key").take(taken),
                        batch.column("vector").take(gone), pa.array(home[taken.to_numpy()].astype(np.int32)), codes,
                        pa.array(bar[taken.to_numpy()].astype(np.float32)),
                    ],
                    names=["label", "size", "list", "key", "vector", "home", "coded", "bar"],
                )

    return place


def candidates(index: Index):
    """Within a group, the whole vectors and the codes that have a looked-up product over the code's bar."""
    def look_up(group: pa.Table) -> pa.Table:
        whole = group.column("vector").is_valid()
        queries, members = group.filter(whole), group.filter(pa.compute.invert(whole))
        units = unit(matrix(queries.column("vector"), index.width))
        coded = np.frombuffer(b"".join(members.column("coded").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        home, bar = members.column("home").to_numpy(), members.column("bar").to_numpy()
        places = {key: place for place, key in enumerate(members.column("key").to_pylist())}
        own = np.fromiter((places.get(key, -1) for key in queries.column("key").to_pylist()), np.int64, queries.num_rows)
        asked, answered = np.zeros(queries.num_rows, bool), np.zeros(members.num_rows, bool)
        for start in range(0, queries.num_rows if members.num_rows else 0, BLOCK):
            hit = index.products(units[start : start + BLOCK], home, coded) >= bar[None]
            mine = own[start : start + BLOCK]
            hit[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
            asked[start : start + BLOCK] = hit.any(1)
            answered |= hit.any(0)
        kept = pa.concat_tables([
            part.select([*GROUP, "key"]).filter(pa.array(mask)).append_column("whole", pa.array(np.full(int(mask.sum()), is_whole)))
            for part, mask, is_whole in ((queries, asked, True), (members, answered, False))
        ])
        return kept

    return look_up


def verified(index: Index, least: float):
    """Within a group, each vector's links by exact cosine, and the least key of what it hangs together with there.

    A pair counts for the vector that is at home in the list. Where the other's own list didn't get this vector's
    code, the pair counts for the other here too, as it will not be met again.
    """
    def compare(group: pa.Table) -> pa.Table:
        whole = group.column("whole")
        queries, members = group.filter(whole), group.filter(pa.compute.invert(whole))
        one, other = (unit(matrix(part.column("vector"), index.width)) for part in (queries, members))
        one_keys, other_keys = (np.array(part.column("key").to_pylist(), dtype=object) for part in (queries, members))
        one_copies, other_copies = (part.column("copies").to_numpy() for part in (queries, members))
        places = {key: place for place, key in enumerate(other_keys.tolist())}
        own = np.fromiter((places.get(key, -1) for key in one_keys.tolist()), np.int64, len(one))
        hit = np.zeros((len(one), len(other)), dtype=bool)
        for start in range(0, len(one), BLOCK):
            hit[start : start + BLOCK] = one[start : start + BLOCK] @ other.T >= least
        hit[np.flatnonzero(own >= 0), own[own >= 0]] = False
        links = hit @ other_copies
        returned = np.zeros(len(other), dtype=np.int64)
        if len(one) and len(other):
            seen = index.within(index.margins(one)[1])[:, index.margins(other)[0]]
            returned = one_copies @ (hit & ~seen)
        rows, columns = components(hit)
        keys = np.concatenate([one_keys, other_keys])
        numbers, counts = np.concatenate([rows, columns]), np.concatenate([links, returned])
        linked = np.flatnonzero(numbers >= 0)
        roots: dict[int, bytes] = {}
        for number, key in zip(numbers[linked].tolist(), keys[linked].tolist(), strict=True):
            roots[number] = min(key, roots.get(number, key))
        return pa.table({
            "key": pa.array(keys[linked].tolist(), pa.binary()), "root": pa.array([roots[number] for number in numbers[linked].tolist()], pa.binary()),
            "links": pa.array(counts[linked].astype(np.int64)),
        })

    return compare
