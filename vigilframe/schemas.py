"""Declared schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B, N = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


CANONICAL = {
    "entities": _struct(("id", S), ("name", S), ("sector", S), ("size", S), ("criticality", S), ("created_at", N)),
    "assets": _struct(
        ("id", S), ("entity_id", S), ("asset_type", S), ("criticality", S), ("expected_monitoring", B),
        ("monitoring_source", S),
    ),
    "alerts": _struct(
        ("id", S), ("entity_id", S), ("asset_id", S), ("timestamp", N), ("severity", S), ("source", S),
        ("status", S), ("acknowledged_at", N), ("closed_at", N), ("case_id", S),
    ),
    "cases": _struct(
        ("id", S), ("entity_id", S), ("alert_id", S), ("opened_at", N), ("investigation_text", S),
        ("disposition", S), ("escalated", B), ("remediation_recorded", B), ("closed_at", N),
    ),
    "escalations": _struct(("id", S), ("entity_id", S), ("case_id", S), ("created_at", N), ("escalation_type", S)),
}

DEVIATIONS = T.ArrayType(
    _struct(("feature", S), ("observed_value", D), ("reference_value", D), ("relative_deviation", D))
)

FINDINGS = _struct(
    ("id", S), ("rule_id", S), ("entity_id", S), ("finding_type", S), ("severity", S), ("confidence", S),
    ("evidence_strength", S), ("confidence_type", S), ("title", S), ("summary", S), ("rationale", S), ("status", S),
    ("created_at", N), ("metric_name", S), ("observed_value", D), ("expected_value", D), ("threshold", D),
    ("population_size", L), ("absolute_gap", D), ("relative_gap", D), ("baseline_method", S), ("baseline_type", S),
    ("baseline_value", D), ("reference_value", D), ("gap_value", D), ("gap_direction", S), ("anomaly_score", D),
    ("anomaly_rank", L), ("contributing_deviations", DEVIATIONS), ("source_phase", S),
)

EVIDENCE = _struct(
    ("id", S), ("finding_id", S), ("source_type", S), ("source_id", S), ("entity_id", S), ("field", S), ("value", S),
    ("reason", S),
)

ISSUES = _struct(("dataset", S), ("field", S), ("error_type", S), ("message", S), ("severity", S))

COMMITMENTS = _struct(
    ("record_id", S), ("record_type", S), ("entity_id", S), ("content_hash", S), ("manifest_hash", S),
    ("finding_id", S), ("source_phase", S), ("detector_id", S), ("period", S), ("created_at", N),
    ("registered_by", S), ("version", L),
)
