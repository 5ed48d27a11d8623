from datetime import datetime, timedelta

from support import values

from vigilframe.operators import absence, gaps, peers, rules
from vigilframe.plans import analysis

START = datetime(2024, 1, 1)
CASES = "id string, entity_id string, alert_id string, severity string, is_closed boolean, investigation_minutes double, is_escalated boolean, is_remediated boolean, opened_at timestamp_ntz"
GAPS = "entity_id string, critical_case_count bigint, critical_escalated_case_count bigint, critical_escalation_rate double, critical_median_investigation_minutes double, closed_case_count bigint, remediated_case_count bigint, remediation_rate double, rapid_closure_count bigint, rapid_closure_rate double"


def _cases(spark, *rows):
    return spark.createDataFrame([(f"C{place}", "E", f"A{place}", *row, START) for place, row in enumerate(rows)], CASES)


def test_rapid_and_short_limits_differ(spark):
    bundle = {"case_features": _cases(
        spark, ("Critical", True, 10.0, True, True), ("Critical", True, 10.1, True, True), ("Critical", False, 4.0, True, True),
        ("High", True, 9.9, True, True), ("Critical", True, None, False, True), ("Low", True, 1.0, False, True),
    )}
    assert values(rules.rapid_critical_closure(bundle).findings, "summary") == [("Critical case C0 was closed in 10.0 minutes.",)]
    assert [row[0] for row in values(rules.short_investigation(bundle).findings, "summary")] == [
        "Critical case C2 was investigated for 4.0 minutes.", "High case C3 was investigated for 9.9 minutes.",
    ]
    unescalated = rules.unescalated_critical_case(bundle)
    assert values(unescalated.evidence, "source_type", "source_id", "field", "value") == [
        ("alert_feature", "A4", "id", "A4"), ("case_feature", "C4", "is_escalated", "False"), ("case_feature", "C4", "severity", "Critical"),
    ]


def test_repeated_alerts_need_no_remediation_at_all(spark):
    alerts = spark.createDataFrame([("A0", "E", "S1"), ("A1", "E", "S1"), ("A2", "E", "S2"), ("A3", "E", "S2")], "id string, entity_id string, asset_id string")
    assets = spark.createDataFrame([("S1", "E", 3, 2), ("S2", "E", 3, 2), ("S3", "E", 2, 1)], "id string, entity_id string, alert_count bigint, case_count bigint")
    cases = _cases(spark, ("Low", True, 1.0, True, False), ("Low", True, 1.0, True, False), ("Low", True, 1.0, True, False), ("Low", True, 1.0, True, True))
    found = rules.repeated_unremediated_alerts({"alert_features": alerts, "asset_features": assets, "case_features": cases})
    assert values(found.findings, "entity_id", "observed_value", "population_size", "threshold") == [("E", 3.0, 2, 3.0)]
    assert found.evidence.count() == 5


def test_monitoring_coverage_guard(spark):
    schema = "entity_id string, expected_monitored_assets bigint, expected_monitored_assets_without_activity bigint, assets_with_alert_activity bigint, expected_monitored_assets_with_activity bigint, monitoring_coverage_rate double"
    rows = [("hit", 10, 5, 5, 5, 0.5), ("few", 9, 5, 4, 4, 0.44), ("covered", 100, 10, 90, 90, 0.9), ("small gap", 10, 4, 6, 6, 0.6)]
    found = rules.low_monitoring_activity({"entity_features": spark.createDataFrame(rows, schema)})
    assert values(found.findings, "entity_id") == [("hit",)]
    assert found.evidence.count() == 5


def test_gap_limits(spark):
    rows = [
        ("at", 5, 2, 0.45, 12.0, 10, 6, 0.6, 2, 0.25), ("below", 5, 2, 0.4, 11.9, 10, 5, 0.59, 2, 0.24),
        ("few", 4, 0, 0.0, 1.0, 9, 0, 0.0, 9, 1.0),
    ]
    bundle = {"entity_features": spark.createDataFrame(rows, GAPS)}
    # 0.60 - 0.15 is a little less than 0.45 in binary, so 0.45 is no finding; 0.75 - 0.15 and 0.10 + 0.15 are exact.
    assert values(gaps.escalation_gap(bundle).findings, "entity_id") == [("below",)]
    assert values(gaps.investigation_gap(bundle).findings, "entity_id", "reference_value") == [("below", 11.95)]
    assert values(gaps.remediation_gap(bundle).findings, "entity_id") == [("at",), ("below",)]
    found = gaps.rapid_closure_gap(bundle).findings
    assert values(found, "entity_id", "gap_direction", "baseline_value") == [("at", "higher_is_gap", 0.1)]


def test_gap_evidence_is_a_top_ten(spark):
    rows = [("E", 12, 0, 0.0, 12.0, 10, 6, 0.6, 2, 0.25)]
    cases = spark.createDataFrame([(f"C{n:02d}", "E", "A", "Critical", True, 1.0, False, True, START) for n in range(12)], CASES)
    found = gaps.escalation_gap({"entity_features": spark.createDataFrame(rows, GAPS), "case_features": cases})
    ids = {row["source_id"] for row in found.evidence.filter("source_type = 'case_feature'").collect()}
    assert ids == {f"C{n:02d}" for n in range(10)}


def _window(spark, sufficient=True):
    return spark.createDataFrame([(START, START + timedelta(days=3), sufficient)], "start timestamp_ntz, end timestamp_ntz, sufficient boolean")


def test_observation_window(spark):
    alerts = spark.createDataFrame([(START,)], "timestamp timestamp_ntz")
    cases = spark.createDataFrame([(START,)], "opened_at timestamp_ntz")
    assert values(absence.observation_window({"alert_features": alerts, "case_features": cases}), "sufficient") == [(False,)]
    later = spark.createDataFrame([(START + timedelta(hours=1),)], "opened_at timestamp_ntz")
    assert values(absence.observation_window({"alert_features": alerts, "case_features": later}), "sufficient", "reason") == [(True, None)]
    nothing = absence.observation_window({"alert_features": alerts.limit(0)})
    assert values(nothing, "sufficient", "reason") == [(False, "INSUFFICIENT_OBSERVATION_WINDOW")]


def test_low_activity_uses_observed_months(spark):
    schema = "entity_id string, year int, month int, alert_count bigint, case_count bigint"
    rows = [("low", 2024, m, n, 1) for m, n in ((1, 100), (2, 10), (4, 20), (6, 30), (7, 5))]
    rows += [("edge", 2024, m, n, 1) for m, n in ((1, 10), (2, 10), (3, 10), (4, 3))] + [("short", 2024, m, 9, 1) for m in (1, 2, 3)]
    bundle = {"entity_month_features": spark.createDataFrame(rows, schema)}
    found = absence.low_activity(bundle, _window(spark))
    assert values(found.findings, "entity_id", "baseline_value", "observed_value", "gap_value") == [("low", 20.0, 5.0, 15.0)]
    assert found.evidence.count() == 16
    assert absence.low_activity(bundle, _window(spark, sufficient=False)).findings.count() == 0


def test_missing_source_needs_two_active_entities(spark):
    def alerts(*entities):
        rows = [(entity, source, START) for entity, sources in entities for source in sources for _ in range(10)]
        return {"alert_features": spark.createDataFrame(rows, "entity_id string, source string, timestamp timestamp_ntz")}

    found = absence.missing_sources(alerts(("a", ["EDR", "IAM"]), ("b", ["EDR", "IAM"]), ("c", ["EDR", "IDS"])), _window(spark))
    assert values(found.findings, "entity_id", "observed_value", "expected_value", "gap_value") == [("c", 2.0, 2.0, 0.5)]
    assert ("missing_categories", "IAM") in values(found.evidence, "field", "value")
    assert absence.missing_sources(alerts(("a", ["EDR", "IAM"])), _window(spark)).findings.count() == 0


def test_peer_deviation_and_expanded_evidence(spark):
    schema = "entity_id string, sector string, size string, criticality string, critical_case_count bigint, closed_case_count bigint, total_assets bigint, critical_escalation_rate double, critical_median_investigation_minutes double, remediation_rate double, alerts_per_asset double"
    rows = [(f"E{n}", "s", "z", "c", 5, 10, 20, rate, 10.0, 0.5, 1.0) for n, rate in enumerate((0.9, 0.5, 0.5, 0.6))]
    rows.append(("alone", "s", "y", "c", 5, 10, 20, 0.0, 1.0, 0.0, 9.0))
    entities = spark.createDataFrame(rows, schema)
    found = peers.peer_detection(entities)
    assert values(found.findings, "rule_id", "entity_id", "reference_value", "population_size") == [("PB001", "E0", 0.5, 3)]
    expanded = peers.peer_evidence(found.findings, found.evidence, peers.peer_reference_values(entities))
    assert values(expanded, "source_id", "value") == [("E1", "0.5"), ("E2", "0.5"), ("E3", "0.6")]
    assert values(peers.cohorts(entities), "cohort_key", "entity_count") == [("s|z|c", 4)]
    assert peers.cohort_members(entities).count() == 4


def test_registry(spark):
    assert analysis.evaluate_detector("EG005", {}) is None
    try:
        analysis.evaluate_detector("XX999", {})
    except ValueError as error:
        assert "XX999" in str(error)
    else:
        raise AssertionError("unknown detector accepted")
