import random
from datetime import datetime, timedelta

from support import values

from vigilframe import schemas
from vigilframe.operators import features

START = datetime(2024, 1, 1)


def _alert(number, asset, at, **other):
    row = dict(id=f"ALT-{number}", entity_id="E1", asset_id=asset, timestamp=at, severity="Critical", source="EDR", status="Open",
               acknowledged_at=None, closed_at=None, case_id=None)
    row.update(other)
    return tuple(row[name] for name in schemas.CANONICAL["alerts"].names)


def _alerts(spark, rows):
    return spark.createDataFrame(rows, schemas.CANONICAL["alerts"])


def test_trailing_counts_agree_on_both_routes(spark):
    draw = random.Random(11)
    rows = []
    for number in range(400):
        asset = draw.choice(["hot", "hot", "hot", "a", "b", None])
        at = START + timedelta(minutes=draw.randint(0, 100 * 24 * 60)) if draw.random() > 0.02 else None
        if number % 50 == 0:
            at = START + timedelta(days=draw.choice([0, 30, 60]))
        rows.append(_alert(number, asset, at))
    alerts = _alerts(spark, rows)
    expected = {}
    for row in rows:
        at = row[3]
        expected[row[0]] = 0 if row[2] is None or at is None else sum(
            other[2] == row[2] and other[3] is not None and at - timedelta(days=30) <= other[3] <= at for other in rows
        )
    got = {row["id"]: row for row in features.alert_features(alerts).collect()}
    assert len(got) == len(rows)
    assert {key: row["asset_recent_alert_count"] for key, row in got.items()} == expected
    assert all(row["asset_alert_count"] == sum(other[2] == "a" for other in rows) for row in got.values() if row["asset_id"] == "a")
    assert got[next(row[0] for row in rows if row[2] is None)]["asset_alert_count"] is None


def test_alert_flags_and_durations(spark):
    row = features.alert_features(_alerts(spark, [
        _alert(1, "a", START, acknowledged_at=START + timedelta(minutes=5, seconds=59), closed_at=START + timedelta(hours=2), case_id="C"),
        _alert(2, "a", START + timedelta(days=31), severity="Odd", source=None, status="Closed"),
    ])).orderBy("id").collect()
    assert (row[0]["acknowledgement_minutes"], row[0]["alert_lifetime_minutes"]) == (5.0, 120.0)
    assert (row[0]["has_case"], row[0]["is_closed"], row[0]["severity_rank"], row[0]["is_critical"]) == (True, True, 4, True)
    assert (row[1]["severity_rank"], row[1]["is_closed"], row[1]["alert_lifetime_minutes"]) == (None, True, None)
    assert row[0]["asset_distinct_alert_sources"] == 2
    assert [item["asset_recent_alert_count"] for item in row] == [1, 1]


def test_case_features(spark):
    cases = spark.createDataFrame([
        ("C1", "E1", "A1", START, "two  words", "Benign", True, False, START + timedelta(minutes=9)),
        ("C2", "E1", "A2", START, None, "Benign", False, True, None),
    ], schemas.CANONICAL["cases"])
    escalations = spark.createDataFrame([
        ("X2", "E1", "C1", START + timedelta(minutes=7), "Management"), ("X1", "E1", "C1", START + timedelta(minutes=3), "Management"),
    ], schemas.CANONICAL["escalations"])
    alerts = _alerts(spark, [_alert(1, "a", START, id="A1", severity="High")])
    got = features.case_features(cases, escalations, alerts)
    assert values(got, "id", "investigation_minutes", "escalation_delay_minutes", "is_closed", "investigation_word_count", "has_investigation_text", "severity") == [
        ("C1", 9.0, 3.0, True, 2, True, "High"), ("C2", None, None, False, 0, False, None),
    ]


def test_assets_and_entities_keep_silent_rows(spark):
    alerts = _alerts(spark, [_alert(1, "S1", START, case_id="C1"), _alert(2, "S1", START + timedelta(days=3, hours=5)), _alert(3, "S2", START)])
    assets = spark.createDataFrame([
        ("S1", "E1", "Server", "Critical", True, "EDR"), ("S2", "E1", "Server", "Low", True, "EDR"), ("S3", "E1", "Server", "High", True, None),
    ], schemas.CANONICAL["assets"])
    got = features.asset_features(assets, alerts)
    assert values(got, "id", "alert_count", "days_since_last_alert", "expected_monitoring_no_activity", "asset_alert_rate_relative_to_entity") == [
        ("S1", 2, 0.0, False, 2 / 3), ("S2", 1, 3.0, False, 1 / 3), ("S3", 0, None, True, 0.0),
    ]
    entities = spark.createDataFrame([("E1", "n", "s", "z", "c", None), ("E2", "n", "s", "z", "c", None)], schemas.CANONICAL["entities"])
    cases = features.case_features(spark.createDataFrame([], schemas.CANONICAL["cases"]), spark.createDataFrame([], schemas.CANONICAL["escalations"]), alerts)
    table = {row["entity_id"]: row for row in features.entity_features(entities, features.alert_flags(alerts), cases, got).collect()}
    assert (table["E1"]["alert_count"], table["E1"]["repeat_alert_event_count"], table["E1"]["monitoring_coverage_rate"]) == (3, 2, 2 / 3)
    assert (table["E2"]["alert_count"], table["E2"]["case_rate"], table["E2"]["total_assets"]) == (0, None, 0)


def test_calendar_and_months(spark):
    alerts = _alerts(spark, [_alert(1, "a", datetime(2024, 12, 30, 23, 5))])
    row = features.time_features(alerts, "timestamp").first()
    assert (row["year"], row["month"], row["week"], row["day_of_week"], row["hour"], str(row["date"])) == (2024, 12, 1, 1, 23, "2024-12-30")
    cases = spark.createDataFrame([("C1", "E9", "A1", START, "", "Benign", True, True, START + timedelta(minutes=4))], schemas.CANONICAL["cases"])
    cases = features.case_features(cases, spark.createDataFrame([], schemas.CANONICAL["escalations"]))
    months = features.entity_month_features(features.alert_flags(alerts), cases)
    assert values(months, "entity_id", "month", "alert_count", "case_count", "median_investigation_minutes") == [("E1", 12, 1, 0, None), ("E9", 1, 0, 1, 4.0)]


def test_trailing_window_shuffles_the_wide_rows_once(spark):
    plan = features.alert_features(_alerts(spark, [_alert(1, "a", START)]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
