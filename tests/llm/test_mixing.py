import re

import duckdb
import pytest
from brute import water_level

from vigilframe.llm import mixing, queries


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 10, "d": 7, None: 300}, {"é": 5, "Z": 500, "a": 0}, {"only": 12}, {"a": 0}, {},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(name, part) for name, size in sizes.items() for part in (size // 2, size - size // 2)], "source string, size long")
    found = {row.source: row.target for row in mixing.source_targets(frame, (5, 2, 1), 1.5, 2.0).collect()}
    order = sorted(sizes, key=lambda name: (name is None, (name or "").encode()))
    want = water_level(sizes, {name: (5, 2, 1)[place % 3] for place, name in enumerate(order)}, 1.5, 2.0)
    assert found == pytest.approx(want)


def test_awkward_rows(spark, documents):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "two words", "en", None), (3, "two words", "en", None), (None, "no id here", "en", "b"), (5, "w " * 5000, "en", "b"), (6, "tab\tand\x0bmore", "en", "c")]
    frame = documents(*rows).withColumnRenamed("lang", "copies").withColumnRenamed("n_chars", "rate")
    measured = mixing.measured(frame)
    rates = mixing.source_rates(measured)
    plan = mixing.plan_mix(measured, rates).collect()
    assert sorted((str(row.doc_id), row.size) for row in plan) == sorted((str(row[0]), len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))) for row in rows)
    assert all(row.copies in (int(row.rate), int(row.rate) + 1) and row.copies <= 2 for row in plan)
    taken = mixing.emit(frame, rates)
    assert taken.columns == frame.columns
    wanted = sorted(str(row.doc_id) for row in plan for _ in range(row.copies))
    assert sorted(str(row.doc_id) for row in taken.collect()) == wanted
    empty = mixing.measured(frame.where("false"))
    assert mixing.plan_mix(empty, mixing.source_rates(empty)).count() == 0


def test_fractions_are_drawn_at_their_rate(spark):
    frame = spark.range(40_000).selectExpr("id AS doc_id", "'x' AS hashed", "1.3D AS rate")
    drawn = frame.select(mixing.copies(frame.rate, "seed", frame.doc_id, frame.hashed).alias("copies")).groupBy("copies").count().collect()
    counts = {row["copies"]: row["count"] for row in drawn}
    assert set(counts) == {1, 2} and abs(counts[2] / 40_000 - 0.3) < 0.01


def test_query_and_sql(spark, sf_dir):
    frame = queries.QUERIES["op5_mixing"](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = sorted(tuple(row) for row in frame.collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert found == sorted(db.execute(queries.ORACLE["op5_mixing"]).fetchall())
    assert all(row[4] <= 2 * row[1] for row in found)
