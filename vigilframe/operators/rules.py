"""Deterministic rules R001-R005 over the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilframe import catalog
from vigilframe.functions.text import render
from vigilframe.operators.findings import Detection, EvidenceItem, identify, make_evidence, make_findings, union_all

REASON = catalog.EVIDENCE_REASONS
Bundle = dict[str, DataFrame]


def _case_item(field: str, kind: str, reason: str) -> EvidenceItem:
    return EvidenceItem("case_feature", F.col("id"), field, F.col(field), kind, REASON[reason])


def _alert_item() -> EvidenceItem:
    return EvidenceItem("alert_feature", F.col("alert_id"), "id", F.col("alert_id"), "text", REASON["case_alert"])


def rapid_critical_closure(bundle: Bundle) -> Detection:
    """R001: critical case closed within the rapid-closure limit, limit included."""
    minutes, limit = F.col("investigation_minutes"), catalog.RAPID_CLOSURE_MINUTES
    hits = bundle["case_features"].filter(
        (F.col("severity") == "Critical") & F.col("is_closed") & minutes.isNotNull() & (minutes <= limit)
    )
    hits = identify(hits, "R001", F.col("id"))
    findings = make_findings(
        hits, "R001", confidence="High", text={"id": F.col("id"), "minutes": minutes},
        metric_name="investigation_minutes", observed_value=minutes, threshold=float(limit),
    )
    evidence = make_evidence(
        hits,
        [
            _case_item("investigation_minutes", "real", "R001_minutes"),
            _case_item("severity", "text", "R001_severity"),
            _alert_item(),
        ],
    )
    return Detection(findings, evidence)


def unescalated_critical_case(bundle: Bundle) -> Detection:
    """R002: critical case without an escalation. The definition's minimum case count is not applied."""
    hits = bundle["case_features"].filter((F.col("severity") == "Critical") & ~F.col("is_escalated"))
    hits = identify(hits, "R002", F.col("id"))
    findings = make_findings(
        hits, "R002", confidence="High", text={"id": F.col("id")}, metric_name="is_escalated", observed_value=0.0,
        expected_value=1.0,
    )
    evidence = make_evidence(
        hits,
        [
            _case_item("severity", "text", "R002_severity"),
            _case_item("is_escalated", "flag", "R002_escalated"),
            _alert_item(),
        ],
    )
    return Detection(findings, evidence)


def repeated_unremediated_alerts(bundle: Bundle) -> Detection:
    """R003: asset with repeated alerts whose cases have no remediation at all."""
    alerts = bundle["alert_features"].select(F.col("id").alias("alert_id"), "asset_id", "entity_id")
    cases = bundle["case_features"].select("alert_id", F.col("id").alias("case_id"), "is_remediated")
    asset_cases = alerts.join(cases, "alert_id").select("asset_id", "entity_id", "case_id", "is_remediated")
    remediation = asset_cases.groupBy("asset_id", "entity_id").agg(
        F.count_if(F.col("is_remediated")).alias("remediated_case_count")
    )
    minimum = catalog.DETECTORS["R003"]["thresholds"]["minimum_repeated_alerts"]
    candidates = (
        bundle["asset_features"]
        .select(F.col("id").alias("asset_id"), "entity_id", "alert_count", "case_count")
        .filter((F.col("alert_count") >= minimum) & (F.col("case_count") > 0))
    )
    hits = candidates.join(
        remediation.filter(F.col("remediated_case_count") == 0), ["asset_id", "entity_id"]
    )
    hits = identify(hits, "R003", F.col("asset_id"))
    findings = make_findings(
        hits, "R003", confidence="High",
        text={"id": F.col("asset_id"), "alert_count": F.col("alert_count"), "case_count": F.col("case_count")},
        metric_name="alert_count", observed_value=F.col("alert_count"), threshold=float(minimum),
        population_size=F.col("case_count"),
    )

    def asset_item(field: str, reason: str) -> EvidenceItem:
        return EvidenceItem("asset_feature", F.col("asset_id"), field, F.col(field), "whole", REASON[reason])

    asset_evidence = make_evidence(
        hits,
        [
            asset_item("alert_count", "R003_alerts"),
            asset_item("case_count", "R003_cases"),
            asset_item("remediated_case_count", "R003_remediated"),
        ],
    )
    # One row per case by a join, not a list of case ids per asset: an asset may own very many cases.
    with_cases = asset_cases.join(hits.select("asset_id", "entity_id", "finding_id"), ["asset_id", "entity_id"])
    case_evidence = make_evidence(
        with_cases,
        [EvidenceItem("case_feature", F.col("case_id"), "is_remediated", F.lit(False), "flag", REASON["R003_case"])],
    )
    return Detection(findings, union_all([asset_evidence, case_evidence]))


def short_investigation(bundle: Bundle) -> Detection:
    """R004: high or critical case investigated for less than the limit; need not be closed."""
    minutes, limit = F.col("investigation_minutes"), catalog.RAPID_CLOSURE_MINUTES
    hits = bundle["case_features"].filter(
        F.col("severity").isin("High", "Critical") & minutes.isNotNull() & (minutes < limit)
    )
    hits = identify(hits, "R004", F.col("id"))
    findings = make_findings(
        hits, "R004", confidence="Medium",
        text={"id": F.col("id"), "severity": F.col("severity"), "minutes": minutes},
        metric_name="investigation_minutes", observed_value=minutes, threshold=float(limit),
    )
    evidence = make_evidence(
        hits,
        [
            _case_item("severity", "text", "R004_severity"),
            _case_item("investigation_minutes", "real", "R004_minutes"),
            _alert_item(),
        ],
    )
    return Detection(findings, evidence)


def low_monitoring_activity(bundle: Bundle) -> Detection:
    """R005: many expected-monitored assets, several of them silent, coverage under the limit."""
    limits = catalog.DETECTORS["R005"]["thresholds"]
    coverage = F.col("monitoring_coverage_rate")
    hits = bundle["entity_features"].filter(
        (F.col("expected_monitored_assets") >= limits["minimum_expected_assets"])
        & (F.col("expected_monitored_assets_without_activity") >= limits["minimum_gap_assets"])
        & coverage.isNotNull()
        & (coverage < limits["maximum_coverage"])
    )
    hits = identify(hits, "R005", F.col("entity_id"))
    findings = make_findings(
        hits, "R005", confidence="High",
        text={
            "entity_id": F.col("entity_id"), "coverage": coverage,
            "without_activity": F.col("expected_monitored_assets_without_activity"),
        },
        metric_name="monitoring_coverage_rate", observed_value=coverage, expected_value=limits["maximum_coverage"],
        threshold=limits["maximum_coverage"], population_size=F.col("expected_monitored_assets"),
    )
    fields = (
        ("expected_monitored_assets", "whole"), ("assets_with_alert_activity", "whole"),
        ("expected_monitored_assets_with_activity", "whole"), ("expected_monitored_assets_without_activity", "whole"),
        ("monitoring_coverage_rate", "real"),
    )
    evidence = make_evidence(
        hits,
        [
            EvidenceItem(
                "entity_feature", F.col("entity_id"), field, F.col(field), kind,
                render(REASON["R005"], field=F.lit(field)),
            )
            for field, kind in fields
        ],
    )
    return Detection(findings, evidence)


EVALUATORS = {
    "R001": rapid_critical_closure,
    "R002": unescalated_critical_case,
    "R003": repeated_unremediated_alerts,
    "R004": short_investigation,
    "R005": low_monitoring_activity,
}
