import hashlib

import pytest
from support import values

from vigilframe import catalog, schemas
from vigilframe.operators import scoring, signals

SIGNAL = "entity_id string, detector_id string, source_phase string, signal_name string, raw_value double, normalized_value double, severity string, evidence_strength string, assessment_strength string, finding_count bigint, contributing_features array<string>, is_assessable boolean"
COUNTS = sorted(set(signals.ENTITY_COUNTS) | set(scoring.COUNT_COLUMNS))


def _signals(spark, *rows):
    return spark.createDataFrame(
        [("E", rule, phase, "s", 0.0, value, "High", strength, assessed, count, features, True) for rule, phase, value, strength, assessed, count, features in rows],
        SIGNAL,
    )


def _entities(spark, rows):
    return spark.createDataFrame(
        [(name, *[counts.get(column, 0) for column in COUNTS]) for name, counts in rows.items()],
        "entity_id string, " + ", ".join(f"{column} bigint" for column in COUNTS),
    )


def _findings(spark, rows):
    names = schemas.FINDINGS.names
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schemas.FINDINGS)


def _finding(identity, rule, entity="E", **other):
    return dict(id=identity, rule_id=rule, entity_id=entity, source_phase=catalog.DETECTORS[rule]["phase"], severity="High", title=catalog.TITLES.get(rule, "t"),
                rationale="r", evidence_strength="High", **other)


def test_four_agreeing_detectors_are_not_added_up(spark):
    rows = _signals(
        spark, ("EG001", "phase6", 50.0, "High", "High", 1, []), ("R002", "phase5", 45.0, None, "Medium", 2, []),
        ("PB001", "phase8", 40.0, "Medium", "Medium", 1, []), ("AN001", "phase8", 18.0, "Low", "Low", 1, ["critical_escalation_rate"]),
    )
    groups = {row["group_id"]: row for row in signals.correlation_groups(rows).collect()}
    assert set(groups) == {"CRITICAL_ESCALATION", "ANOMALY_PROFILE"}
    top = groups["CRITICAL_ESCALATION"]
    assert (top["base_value"], top["final_value"], top["corroboration_level"]) == (50.0, 62.0, "Strong")
    assert top["corroborating_phases"] == ["phase5", "phase6", "phase8"]
    assert top["participating_detectors"] == ["R002", "EG001", "PB001", "AN001"]
    assert (top["primary_detector"], top["supporting_finding_count"], top["evidence_strength"]) == ("EG001", 5, "High")
    row = signals.risk_contributions(signals.correlation_groups(rows)).filter("dimension = 'Escalation'").first()
    assert row["id"] == hashlib.sha256(b"E:CRITICAL_ESCALATION:Escalation:62.00").hexdigest()[:16]
    assert (row["detector_id"], row["source_phase"], row["contribution"]) == ("R002", "phase5", 15.5)
    links = signals.supporting_findings(rows, _findings(spark, [_finding(name, rule) for name, rule in (("f1", "R002"), ("f2", "R002"), ("f3", "EG001"))]))
    assert values(links, "group_id", "finding_id") == [("CRITICAL_ESCALATION", "f1"), ("CRITICAL_ESCALATION", "f2"), ("CRITICAL_ESCALATION", "f3")]


def test_two_phases_are_moderate_and_anomaly_stays_off_topic(spark):
    rows = _signals(
        spark, ("R003", "phase5", 30.0, None, "Medium", 1, []), ("EG003", "phase6", 40.0, "High", "High", 1, []),
        ("AN001", "phase8", 18.0, "Low", "Low", 1, ["alert_count"]),
    )
    row = signals.correlation_groups(rows).filter("group_id = 'REMEDIATION'").first()
    assert (row["base_value"], row["final_value"], row["corroboration_level"]) == (40.0, 44.8, "Moderate")


def test_unassessable_dimensions_leave_the_weighting(spark):
    groups = signals.correlation_groups(_signals(spark, ("R002", "phase5", 50.0, None, "Medium", 1, [])))
    entities = _entities(spark, {"E": {"critical_case_count": 10, "alert_count": 100}})
    row = scoring.assess_entities(entities, _findings(spark, [_finding("f", "R002")]), groups).first()
    assert (row["investigation_score"], row["monitoring_score"], row["remediation_score"]) == (None, None, None)
    assert (row["escalation_score"], row["overall_score"], row["assessment_coverage"]) == (50.0, 27.78, 0.5)
    assert row["top_reason"] == "Escalation concern: CRITICAL_ESCALATION score 50.0 (Single Phase corroboration via R002)."


def test_published_demo_score(spark):
    scores = {"Escalation": 93.0, "Investigation": 100.0, "Remediation": 40.59, "Monitoring": 0.0, "Operational Discipline": 0.0, "Cyber Resilience": 18.55}
    assert round(sum(weight * scores[name] for name, _, weight, _ in catalog.DIMENSIONS), 2) == 53.22
    rows = _signals(
        spark, ("R002", "phase5", 93.0, None, "Medium", 1, []), ("R004", "phase5", 100.0, None, "Medium", 1, []),
        ("R003", "phase5", 40.59, None, "Medium", 1, []), ("AN001", "phase8", 18.55, "High", "High", 1, ["alert_count"]),
    )
    full = {name: 5 for name in COUNTS}
    row = scoring.assess_entities(_entities(spark, {"E": full}), _findings(spark, []), signals.correlation_groups(rows)).first()
    assert (row["overall_score"], row["risk_band"], row["assessment_coverage"], row["evidence_strength_summary"]) == (53.22, "HIGH", 1.0, "No findings")


def test_normalisation_rules(spark):
    entities = _entities(spark, {"E": dict(closed_case_count=8, critical_case_count=4, total_assets=10, case_count=20, expected_monitored_assets=10, critical_assets=4, critical_alert_count=5), "Z": {}})
    deviations = [("alert_count", 1.0, 1.0, 0.5), ("case_count", 1.0, 1.0, 1.0)]
    rows = [_finding(f"r1{n}", "R001") for n in range(2)] + [_finding(f"r3{n}", "R003") for n in range(4)] + [
        _finding("r5", "R005", observed_value=0.5), _finding("g1", "EG001", gap_value=0.3, baseline_value=0.6), _finding("g4", "EG004", gap_value=0.3, baseline_value=0.1),
        _finding("n1", "NS001", observed_value=3.0, gap_value=0.4), _finding("n3", "NS003", gap_value=0.25), _finding("n5", "NS005", observed_value=2.0),
        _finding("p1", "PB001", absolute_gap=0.2, reference_value=0.5), _finding("a1", "AN001", anomaly_rank=2, anomaly_score=-0.1, contributing_deviations=deviations),
        _finding("z2", "R002", entity="Z"), _finding("u1", "EG005"),
    ]
    got = {(row["entity_id"], row["detector_id"]): row for row in signals.signals(_findings(spark, rows), entities).collect()}
    expected = {"R001": 25.0, "R003": 100.0, "R005": 5.0, "EG001": 50.0, "EG004": 75.0, "NS001": 30.0, "NS003": 25.0, "NS005": 40.0, "PB001": 24.0, "AN001": 20.0}
    assert {rule: got[("E", rule)]["normalized_value"] for rule in expected} == expected
    assert not got[("Z", "R002")]["is_assessable"] and got[("Z", "R002")]["unassessable_reason"] == "No critical cases observed for entity."
    assert not got[("E", "EG005")]["is_assessable"] and "EG005" in got[("E", "EG005")]["unassessable_reason"]
    assert got[("E", "AN001")]["contributing_features"] == ["alert_count", "case_count"]
    assert (got[("E", "R001")]["evidence_strength"], got[("E", "R001")]["assessment_strength"]) == (None, "Low")


def test_systemic_gap_outranks_noise(spark):
    entities = _entities(spark, {"SYS": {name: 5 for name in COUNTS}, "NOISE": {name: 50 for name in COUNTS}, "CALM": {name: 5 for name in COUNTS}})
    findings = _findings(spark, [_finding("gap", "EG001", entity="SYS", gap_value=0.3, baseline_value=0.6), _finding("silent", "NS001", entity="SYS", observed_value=1.0)] + [
        _finding(f"n{place:02d}", "R001", entity="NOISE") for place in range(15)
    ])
    evidence = spark.createDataFrame([("e1", "silent", "asset_feature", "S2", "SYS", "id", "S2", ""), ("e2", "silent", "asset_feature", "S1", "SYS", "id", "S1", "")], schemas.EVIDENCE)
    rows = signals.signals(findings, entities)
    assessment = scoring.assess_entities(entities, findings, signals.correlation_groups(rows))
    queue = scoring.review_queue(assessment, findings, evidence).orderBy("rank").collect()
    assert [row["rank"] for row in queue] == [1, 2, 3, 4]
    assert (queue[0]["record_id"], queue[0]["priority_score"], queue[0]["priority"]) == ("gap", 77.0, "HIGH")
    assert ("ASSET", "S1", 65.0) in [(row["record_type"], row["record_id"], row["priority_score"]) for row in queue]
    scores = {row["record_id"]: row["priority_score"] for row in queue if row["record_type"] == "ENTITY"}
    assert scores["SYS"] > scores["NOISE"] and "CALM" not in scores
    noise = next(row for row in queue if row["record_id"] == "NOISE")
    assert noise["supporting_finding_ids"] == [f"n{place:02d}" for place in range(10)]


@pytest.mark.parametrize("counts,missing", [({"alert_count": 1}, {"Investigation", "Remediation", "Monitoring"}), ({}, {"Escalation", "Investigation", "Remediation", "Monitoring", "Operational Discipline"})])
def test_assessability(spark, counts, missing):
    tests = scoring.unassessable()
    row = _entities(spark, {"E": counts}).select(*[test.alias(name) for name, test in tests.items()]).first()
    assert {name for name in tests if row[name]} == missing
