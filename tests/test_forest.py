import random

from vigilframe import catalog
from vigilframe.operators import forest


def _entities(spark, count, outlier=True):
    draw = random.Random(5)
    rows = [(f"E{n:03d}", *[draw.gauss(10, 1) for _ in catalog.ANOMALY_FEATURES]) for n in range(count)]
    if outlier:
        rows[0] = ("E000", *[100.0 for _ in catalog.ANOMALY_FEATURES])
    return spark.createDataFrame(rows, "entity_id string, " + ", ".join(f"{name} double" for name in catalog.ANOMALY_FEATURES))


def test_planted_outlier_ranks_first_and_runs_agree(spark):
    entities = _entities(spark, 60)
    first = sorted(map(tuple, forest.detect_anomalies(entities).collect()))
    again = sorted(map(tuple, forest.detect_anomalies(entities.repartition(5)).collect()))
    assert first == again
    assert len(first) == 6
    ranks = {row[0]: row[2] for row in first}
    assert ranks["E000"] == 1 and sorted(ranks.values()) == list(range(1, 7))


def test_small_population_yields_nothing(spark):
    assert forest.detect_anomalies(_entities(spark, 9)).count() == 0


def test_findings_name_three_deviations(spark):
    found = forest.anomaly_detection(_entities(spark, 40))
    row = found.findings.filter("entity_id = 'E000'").first()
    assert row["confidence"] == "High" and len(row["contributing_deviations"]) == 3
    deviations = [item["relative_deviation"] for item in row["contributing_deviations"]]
    assert deviations == sorted(deviations, reverse=True)
    assert found.evidence.filter(found.evidence["finding_id"] == row["id"]).count() == 3


def test_unusable_columns_are_screened(spark):
    rows = [(f"E{n}", float(n), 1.0, None if n % 3 else 2.0, float(n) if n % 3 else None) for n in range(12)]
    entities = spark.createDataFrame(rows, "entity_id string, alert_count double, case_count double, remediation_rate double, rapid_closure_rate double")
    usable = {row["feature"]: row["is_usable"] for row in forest.column_profile(entities).collect()}
    assert usable == {"alert_count": True, "case_count": False, "remediation_rate": False, "rapid_closure_rate": True}
    matrix = forest.anomaly_matrix(entities)
    assert matrix.filter("case_count is not null or remediation_rate is not null or rapid_closure_rate is null").count() == 0
