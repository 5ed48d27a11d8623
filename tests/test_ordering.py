import random
import statistics

from pyspark.sql import functions as F

from vigilframe.operators import ordering, peers


def _groups():
    draw = random.Random(3)
    rows = []
    for group in range(40):
        for place in range(draw.randint(1, 9)):
            rows.append((f"g{group}", f"e{place}", draw.choice([0.0, -1.5, 0.25, 0.25, 3.0, draw.uniform(-5, 5), draw.uniform(0, 1)])))
    return rows


def test_order_statistics_match_sorting(spark):
    rows = _groups() + [("g0", "null", None)]
    df = spark.createDataFrame(rows, "g string, e string, v double")
    got = {
        row["g"]: row for row in ordering.order_statistics(
            df, ["g"], "v", lambda n: {"first": F.lit(1), "last": n, "p25": ordering.nearest_rank(n, 0.25), "beyond": n + 1}
        ).collect()
    }
    medians = {row["g"]: row["median"] for row in ordering.exact_medians(df, ["g"], "v").collect()}
    for group in {row[0] for row in rows}:
        ordered = sorted(row[2] for row in rows if row[0] == group and row[2] is not None)
        n = len(ordered)
        assert got[group]["n"] == n
        assert (got[group]["first"], got[group]["last"], got[group]["beyond"]) == (ordered[0], ordered[-1], None)
        assert got[group]["p25"] == ordered[int((n - 1) * 0.25 + 0.5)]
        assert abs(medians[group] - statistics.median(ordered)) < 1e-12


def test_whole_table_median(spark):
    df = spark.createDataFrame([(float(value),) for value in (5, 1, 4, 2)], "v double")
    assert ordering.exact_medians(df, [], "v").first()["median"] == 3.0


def test_leave_one_out_medians_match_brute_force(spark):
    rows = _groups()
    df = spark.createDataFrame(rows, "g string, e string, value double")
    got = {(row["g"], row["e"]): row for row in peers.leave_one_out_medians(df, ["g"]).collect()}
    for group, entity, _ in rows:
        others = [row[2] for row in rows if row[0] == group and row[1] != entity]
        if len(others) < 2:
            assert (group, entity) not in got
        else:
            assert got[(group, entity)]["peer_count"] == len(others)
            assert abs(got[(group, entity)]["peer_median"] - statistics.median(others)) < 1e-12


def test_global_rank_is_dense_and_ordered(spark):
    rows = [(random.Random(place).randint(0, 5), f"k{place:04d}") for place in range(500)]
    df = spark.createDataFrame(rows, "score int, key string").repartition(7)
    ranked = ordering.global_rank(df, [F.col("score").desc(), F.col("key")]).orderBy("rank").collect()
    assert [row["rank"] for row in ranked] == list(range(1, 501))
    assert [(row["score"], row["key"]) for row in ranked] == sorted(rows, key=lambda row: (-row[0], row[1]))
