"""Detector families and the risk run, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from vigilframe import catalog, session
from vigilframe.operators import absence, forest, gaps, peers, rules, scoring, signals
from vigilframe.operators.findings import Detection, combine

Bundle = dict[str, DataFrame]


def evaluate_detector(rule_id: str, bundle: Bundle) -> Detection | None:
    """Run one detector. A disabled one gives nothing, an unknown one is an error."""
    if rule_id not in catalog.DETECTORS:
        raise ValueError(f"No evaluator registered for {rule_id}")
    if not catalog.DETECTORS[rule_id].get("enabled", True):
        return None
    if rule_id in absence.EVALUATORS:
        return absence.EVALUATORS[rule_id](bundle, absence.observation_window(bundle))
    if rule_id in peers.PEER_DETECTORS:
        return peers.peer_detection(bundle["entity_features"], rule_id)
    if rule_id == "AN001":
        return forest.anomaly_detection(bundle["entity_features"])
    return {**rules.EVALUATORS, **gaps.EVALUATORS}[rule_id](bundle)


def evaluate_rules(bundle: Bundle) -> Detection:
    return combine([rules.EVALUATORS[name](bundle) for name in catalog.enabled("phase5")])


def evaluate_gaps(bundle: Bundle) -> Detection:
    return combine([gaps.EVALUATORS[name](bundle) for name in catalog.enabled("phase6")])


def evaluate_absence(bundle: Bundle) -> Detection:
    window = absence.observation_window(bundle)
    return combine([absence.EVALUATORS[name](bundle, window) for name in catalog.enabled("phase7")])


def evaluate_peers(bundle: Bundle, anomalies: bool = True) -> Detection:
    """Peer deviations and, unless switched off, the anomaly detector."""
    entities = bundle["entity_features"]
    peer = peers.peer_detection(entities)
    return combine([peer, forest.anomaly_detection(entities)]) if anomalies else peer


FAMILIES: dict[str, Callable[[Bundle], Detection]] = {
    "phase5": evaluate_rules,
    "phase6": evaluate_gaps,
    "phase7": evaluate_absence,
    "phase8": evaluate_peers,
}


def evaluate_families(bundle: Bundle, anomalies: bool = True) -> Detection:
    """Findings and evidence of all families in one frame each."""
    parts = [
        evaluate_rules(bundle), evaluate_gaps(bundle), evaluate_absence(bundle), evaluate_peers(bundle, anomalies)
    ]
    return combine(parts)


class RiskRun(NamedTuple):
    signals: DataFrame
    groups: DataFrame
    contributions: DataFrame
    contribution_findings: DataFrame
    assessment: DataFrame
    entity_risk: DataFrame
    review_queue: Callable[[], DataFrame]


def assess_risk(entities: DataFrame, findings: DataFrame, evidence: DataFrame, staged: bool = False) -> RiskRun:
    """All risk tables from entity features and findings. Ranking the queue stages it, so it is left to a call.

    Several tables start from the signals, groups and assessments. With ``staged`` these are written once, so that
    the findings are not read again for each of them.
    """
    keep = session.stage if staged else (lambda frame: frame)
    signal_rows = keep(signals.signals(findings, entities))
    groups = keep(signals.correlation_groups(signal_rows))
    assessment = keep(scoring.assess_entities(entities, findings, groups))
    return RiskRun(
        signals=signal_rows,
        groups=groups,
        contributions=signals.risk_contributions(groups),
        contribution_findings=signals.supporting_findings(signal_rows, findings),
        assessment=assessment,
        entity_risk=scoring.entity_risk(assessment),
        review_queue=lambda: scoring.review_queue(assessment, findings, evidence),
    )


def stage_detection(detection: Detection) -> Detection:
    return Detection(session.stage(detection.findings), session.stage(detection.evidence))
