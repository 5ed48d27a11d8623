import random

from support import values
from pyspark.sql import functions as F

from vigilframe.functions import measures, text


def test_number_formats_match_python(spark):
    draw = random.Random(7)
    numbers = [0.0, 0.125, 0.15, 1.005, 2.675, 12.25, 0.6, 12.5, 999.5, 1234.5, 0.00012, 1e-5, 2.5e-7, 123456789.125, 1e16, -3.25]
    numbers += [draw.uniform(0, 1000) for _ in range(500)] + [draw.randint(1, 60) / draw.randint(1, 60) for _ in range(500)]
    df = spark.createDataFrame([(value,) for value in numbers], "v double").select(
        "v", text.fixed(F.col("v"), 1).alias("f1"), text.percent(F.col("v"), 1).alias("p1"),
        text.significant3(F.col("v")).alias("g3"), text.round_half_even(F.col("v"), 2).alias("r2"),
        text.number_text(F.col("v")).alias("s"),
    )
    for row in df.collect():
        assert row["f1"] == f"{row['v']:.1f}"
        assert row["p1"] == f"{row['v']:.1%}"
        assert row["g3"] == f"{row['v']:.3g}"
        assert row["r2"] == round(row["v"], 2)
        assert row["s"] == str(row["v"])


def test_time_text_keeps_six_digits_or_none(spark):
    df = spark.sql("select timestamp_ntz '2024-01-02 03:04:05' a, timestamp_ntz '2024-01-02 03:04:05.1' b")
    row = df.select(text.time_text(F.col("a"), "T").alias("a"), text.time_text(F.col("b")).alias("b")).first()
    assert (row["a"], row["b"]) == ("2024-01-02T03:04:05", "2024-01-02 03:04:05.100000")


def test_rates_and_strengths(spark):
    df = spark.createDataFrame([(20, 0.25), (10, 0.1), (3, 0.2), (3, 0.1)], "n int, gap double")
    got = [
        tuple(row) for row in df.select(
            measures.gap_strength(F.col("n"), F.col("gap")), measures.absence_strength(F.col("n"), F.col("gap")),
            measures.absence_strength(F.col("n"), F.col("gap"), explicit=False), measures.peer_strength(F.col("n"), F.col("gap")),
        ).collect()
    ]
    assert got == [("High", "High", "Medium", "High"), ("Medium", "Medium", "Medium", "Low"), ("Medium", "Low", "Low", "Medium"), ("Low", "Low", "Low", "Low")]
    rates = spark.createDataFrame([(1, 4), (1, 0), (1, None)], "a int, b int")
    assert [row[0] for row in rates.select(measures.safe_rate(F.col("a"), F.col("b"))).collect()] == [0.25, None, None]


def test_bands_and_priorities(spark):
    df = spark.createDataFrame([(0.0,), (24.99,), (24.9995,), (25.0,), (49.99,), (50.0,), (74.9995,), (75.0,), (100.0,)], "s double")
    assert [row[0] for row in df.select(measures.risk_band(F.col("s"))).collect()] == [
        "LOW", "LOW", "LOW", "MODERATE", "MODERATE", "HIGH", "LOW", "CRITICAL", "CRITICAL",
    ]
    df = spark.createDataFrame([(70.0,), (69.9,), (40.0,), (39.9,)], "s double")
    assert [row[0] for row in df.select(measures.priority(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_ids_are_prefixed_digests(spark):
    import hashlib

    row = spark.range(1).select(measures.finding_id(F.lit("R001"), F.lit("E"), F.lit("C")).alias("f")).first()
    assert row["f"] == "F-" + hashlib.sha256(b"R001|E|C").hexdigest()[:16]


def test_cohort_key_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", None, "c")], "sector string, size string, criticality string")
    assert values(df.withColumn("k", measures.cohort_key()), "k") == [("a|b|c",), (None,)]
