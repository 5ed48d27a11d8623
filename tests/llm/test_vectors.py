import math
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from vigilframe.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, links int"


def cosine(one, other):
    if one is None or other is None or len(one) != len(other) or not one:
        return None
    if any(part is None or not math.isfinite(part) for part in (*one, *other)) or not any(one) or not any(other):
        return None
    a, b = np.array(one, dtype=float), np.array(other, dtype=float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def brute(rows, least=0.98):
    root, links = list(range(len(rows))), Counter()

    def find(one):
        while root[one] != one:
            one = root[one]
        return one

    for one, other in combinations(range(len(rows)), 2):
        if rows[one][2] is None or rows[one][2] != rows[other][2]:
            continue
        found = cosine(rows[one][1], rows[other][1])
        if found is not None and found >= least:
            links[one] += 1
            links[other] += 1
            low, high = sorted((find(one), find(other)))
            root[high] = low
    smallest = {}
    for place, row in enumerate(rows):
        if row[0] is not None:
            smallest[find(place)] = min(row[0], smallest.get(find(place), row[0]))
    return sorted(
        ((row[0], links[place], smallest.get(find(place)), row[0] == smallest.get(find(place))) for place, row in enumerate(rows)), key=repr
    )


def found_rows(frame):
    return sorted(((row.vec_id, row.n_links, row.component_id, row.kept) for row in frame.collect()), key=repr)


def clouds(seed, size=24, labels=3):
    """Vectors of a few labels: lone ones, exact copies, tight groups, chains of neighbours that drift away."""
    generator = np.random.default_rng(seed)
    rows = []

    def add(vector, label):
        rows.append((len(rows) * 3, [float(np.float32(part)) for part in vector], label, None))

    for label in range(labels):
        for _ in range(60):
            add(generator.normal(size=size), label)
        middle = generator.normal(size=size)
        for _ in range(50):
            add(middle + generator.normal(size=size) * 0.12, label)
        for _ in range(20):
            add(middle * 2, label)
        step = generator.normal(size=size)
        for place in range(25):
            add(step, label)
            step = step + generator.normal(size=size) * 0.15
    return [rows[place] for place in generator.permutation(len(rows))]


@pytest.mark.parametrize("queries_held,members_held,reach", [(2048, 4096, 0.5), (16, 24, 1.0)])
def test_links_and_components_are_brute_force(spark, monkeypatch, queries_held, members_held, reach):
    monkeypatch.setattr(vectors, "QUERIES", queries_held)
    monkeypatch.setattr(vectors, "MEMBERS", members_held)
    rows = clouds(1)
    found = found_rows(vectors.near_copies(spark.createDataFrame(rows, SCHEMA), reach=reach))
    want = brute(rows)
    pairs = sum(row[1] for row in want)
    assert pairs > 1000
    if reach == 1.0:
        assert found == want
    else:
        assert sum(row[1] for row in found) >= 0.999 * pairs
        assert sum(one == other for one, other in zip(found, want, strict=True)) >= 0.99 * len(want)


def test_cases_without_links(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, None), (1, [1.0, 0.0], 1, None), (2, [2.0, 0.0], 1, None), (3, [1.0, 0.0], None, None), (4, None, 1, None),
        (5, [], 1, None), (6, [0.0, 0.0], 1, None), (7, [1.0, None], 1, None), (8, [nan, 1.0], 1, None), (9, [inf, 1.0], 1, None),
        (10, [1.0, 0.0, 0.0], 1, None), (11, [1.0, 0.0], 2, None), (None, [0.0, 1.0], 1, None), (None, [0.0, 1.0], 1, None), (12, [-0.0, 3.0], 1, None),
        (13, [1e30, 1e30], 3, None), (14, [3e-30, 3e-30], 3, None), (None, [0.0, 1.0], 9, None),
    ]
    assert found_rows(vectors.near_copies(spark.createDataFrame(rows, SCHEMA), reach=1.0)) == brute(rows)


def test_no_rows(spark):
    assert vectors.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found_rows(vectors.near_copies(spark.createDataFrame([(1, None, 1, None)], SCHEMA))) == [(1, 0, 1, True)]


def test_a_code_of_a_close_vector_passes_its_bar():
    generator = np.random.default_rng(3)
    points = vectors.unit(generator.normal(size=(3000, 16)))
    index = vectors.fit(points, 16, 0.9)
    near = vectors.unit(points + generator.normal(size=points.shape) * 0.06)
    home, _ = index.margins(points)
    coded, bar = index.codes(points, home)
    close = (points * near).sum(1) >= 0.9
    assert close.sum() > 1000
    assert (np.diagonal(index.products(near[:1000], home[:1000], coded[:1000])) >= bar[:1000])[close[:1000]].all()


def test_full_reach_never_misses_a_list():
    generator = np.random.default_rng(4)
    points = vectors.unit(generator.normal(size=(2000, 8)))
    index = vectors.fit(points, 64, 0.98, reach=1.0)
    near = vectors.unit(points + generator.normal(size=points.shape) * 0.06)
    close = (points * near).sum(1) >= 0.98
    seen = index.within(index.margins(points)[1])[np.arange(2000), index.margins(near)[0]]
    assert close.sum() > 500
    assert seen[close].all()


def test_query_is_its_sql(spark, sf_copy):
    rows = clouds(6, labels=2)[:150]
    folder = sf_copy(embeddings=spark.createDataFrame(rows, SCHEMA))
    found = queries.QUERIES["op12_vector_copies"](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op12_vector_copies"]).fetchall()
    assert found_rows(found) == sorted(want, key=repr)
