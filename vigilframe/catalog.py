"""Fixed values of the supervisory model.

Column contracts, category domains, thresholds, detector definitions, message texts, correlation groups and
weights. They must equal the published model for results to agree, so they are stated here as plain data.
"""

from __future__ import annotations

# --- fixed values: canonical tables -------------------------------------------------------------------------

DATASETS = ("entities", "assets", "alerts", "cases", "escalations")

REQUIRED_COLUMNS = {
    "entities": ("id", "name", "sector", "size", "criticality"),
    "assets": ("id", "entity_id", "asset_type", "criticality", "expected_monitoring"),
    "alerts": ("id", "entity_id", "asset_id", "timestamp", "severity", "source", "status"),
    "cases": (
        "id", "entity_id", "alert_id", "opened_at", "investigation_text", "disposition", "escalated",
        "remediation_recorded",
    ),
    "escalations": ("id", "entity_id", "case_id", "created_at", "escalation_type"),
}

OPTIONAL_COLUMNS = {
    "entities": ("created_at",),
    "assets": ("monitoring_source",),
    "alerts": ("acknowledged_at", "closed_at", "case_id"),
    "cases": ("closed_at",),
    "escalations": (),
}

COLUMN_ALIASES = {
    "entities": {"entity_id": "id", "entity_name": "name", "organization": "name"},
    "assets": {"asset_id": "id"},
    "alerts": {"alert_id": "id", "detected_at": "timestamp", "alert_time": "timestamp", "severity_level": "severity"},
    "cases": {"case_id": "id", "investigation_notes": "investigation_text", "escalated_flag": "escalated"},
    "escalations": {"escalation_id": "id"},
}

DATETIME_COLUMNS = {
    "entities": ("created_at",),
    "assets": (),
    "alerts": ("timestamp", "acknowledged_at", "closed_at"),
    "cases": ("opened_at", "closed_at"),
    "escalations": ("created_at",),
}

BOOLEAN_COLUMNS = {
    "entities": (),
    "assets": ("expected_monitoring",),
    "alerts": (),
    "cases": ("escalated", "remediation_recorded"),
    "escalations": (),
}

ID_COLUMNS = {
    "entities": ("id",),
    "assets": ("id", "entity_id"),
    "alerts": ("id", "entity_id", "asset_id"),
    "cases": ("id", "entity_id", "alert_id"),
    "escalations": ("id", "entity_id", "case_id"),
}

TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")

CATEGORY_DOMAINS = {
    "severity": ("Low", "Medium", "High", "Critical"),
    "status": ("Open", "Acknowledged", "Closed"),
    "disposition": ("True Positive", "False Positive", "Benign", "Duplicate"),
}

# Domains of the strict integrity audit.
AUDIT_DOMAINS = {
    ("entities", "sector"): ("Energy", "Banking", "Telecom", "Transport", "Government"),
    ("entities", "size"): ("Small", "Medium", "Large"),
    ("entities", "criticality"): ("Low", "Medium", "High", "Critical"),
    ("assets", "asset_type"): ("Server", "Database", "Endpoint", "Network Device", "Application", "Cloud Resource"),
    ("assets", "criticality"): ("Low", "Medium", "High", "Critical"),
    ("alerts", "severity"): ("Low", "Medium", "High", "Critical"),
    ("alerts", "source"): ("EDR", "Firewall", "IAM", "IDS", "Email Security", "Cloud Security"),
    ("alerts", "status"): ("Open", "Acknowledged", "Closed"),
    ("cases", "disposition"): ("True Positive", "False Positive", "Benign", "Duplicate"),
    ("escalations", "escalation_type"): (
        "Management", "Incident Response", "Critical Infrastructure", "External Coordination",
    ),
}

# --- fixed values: features ---------------------------------------------------------------------------------

SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
STRENGTH_RANK = {"Low": 1, "Medium": 2, "High": 3}
RAPID_CLOSURE_MINUTES = 10
RECENT_WINDOW_DAYS = 30
FEATURE_TABLES = ("alert_features", "case_features", "asset_features", "entity_features", "entity_month_features")
COHORT_COLUMNS = ("sector", "size", "criticality")
BENCHMARK_METRICS = (
    "critical_escalation_rate", "critical_median_investigation_minutes", "remediation_rate", "rapid_closure_rate",
    "alert_count", "case_count", "alerts_per_asset", "cases_per_asset", "monitoring_coverage_rate",
    "repeat_alert_event_rate",
)
ANOMALY_FEATURES = (
    "alert_count", "case_count", "alerts_per_asset", "cases_per_asset", "critical_alert_rate",
    "critical_escalation_rate", "critical_median_investigation_minutes", "remediation_rate", "rapid_closure_rate",
    "monitoring_coverage_rate", "repeat_alert_event_rate",
)

# --- fixed values: detector definitions ---------------------------------------------------------------------

PHASES = ("phase5", "phase6", "phase7", "phase8")

DETECTORS = {
    "R001": dict(
        phase="phase5", name="Critical Alert Closed Rapidly", severity="Medium", finding_type="Rapid Closure",
        description="Identify critical cases closed at or below the rapid-closure threshold.",
        thresholds={"rapid_closure_minutes": 10},
    ),
    "R002": dict(
        phase="phase5", name="Critical Alert Without Escalation", severity="High", finding_type="Escalation",
        description="Identify critical cases with no associated escalation.",
        thresholds={"minimum_critical_cases": 5},
    ),
    "R003": dict(
        phase="phase5", name="Repeated Alerts Without Remediation", severity="Medium",
        finding_type="Repeated Activity",
        description="Identify assets with repeated alerts whose associated cases have no recorded remediation.",
        thresholds={"minimum_repeated_alerts": 3},
    ),
    "R004": dict(
        phase="phase5", name="Investigation Duration Anomaly Proxy", severity="Medium", finding_type="Investigation",
        description="Identify high or critical cases with short investigation duration.",
        thresholds={"investigation_minutes": 10},
    ),
    "R005": dict(
        phase="phase5", name="Very Low Monitoring Activity on Expected-Monitored Assets", severity="Medium",
        finding_type="Monitoring Coverage",
        description="Identify entities with low observed activity among sufficiently numerous expected-monitored assets.",
        thresholds={"minimum_gap_assets": 5, "maximum_coverage": 0.90, "minimum_expected_assets": 10},
    ),
    "EG001": dict(
        phase="phase6", name="Critical Escalation Execution Gap", severity="High", finding_type="Execution Gap",
        description="Critical-case escalation is materially below the configured supervisory expectation.",
        thresholds={"minimum_critical_cases": 5, "minimum_gap": 0.15, "expected_rate": 0.60},
        baseline_method="configured_supervisory_expectation", direction="lower_is_gap",
    ),
    "EG002": dict(
        phase="phase6", name="Investigation Effort Execution Gap", severity="High", finding_type="Execution Gap",
        description="Critical-case investigation duration is materially below the configured minimum expectation.",
        thresholds={"minimum_critical_cases": 5, "minimum_ratio": 0.60, "minimum_expected_minutes": 20},
        baseline_method="configured_minimum", direction="lower_is_gap",
    ),
    "EG003": dict(
        phase="phase6", name="Remediation Execution Gap", severity="High", finding_type="Execution Gap",
        description="Closed-case remediation rate is materially below the configured minimum expectation.",
        thresholds={"minimum_closed_cases": 10, "minimum_gap": 0.15, "minimum_expected_rate": 0.75},
        baseline_method="configured_minimum", direction="lower_is_gap",
    ),
    "EG004": dict(
        phase="phase6", name="Rapid Closure Execution Gap", severity="Medium", finding_type="Execution Gap",
        description="Entity rapid-closure rate is materially above the configured expected maximum.",
        thresholds={"minimum_closed_cases": 10, "minimum_gap": 0.15, "maximum_expected_rate": 0.10},
        baseline_method="configured_supervisory_expectation", direction="higher_is_gap",
    ),
    "EG005": dict(
        phase="phase6", name="Investigation Documentation Execution Gap", severity="Medium",
        finding_type="Execution Gap",
        description="Deferred: current feature contract does not provide sufficient evidence for a defensible documentation-quality detector.",
        thresholds={}, baseline_method="deferred", direction="lower_is_gap", enabled=False,
        deferred_reason="Current features provide text length and word count but no documented expected documentation standard or quality baseline.",
    ),
    "NS001": dict(
        phase="phase7", name="Expected-Monitored Asset With No Activity", severity="Medium",
        finding_type="Monitoring Coverage",
        description="Expected-monitored assets without observable alert activity during the observation period.",
        thresholds={"minimum_inactive_assets": 5, "maximum_coverage": 0.90}, minimum_population=5,
    ),
    "NS002": dict(
        phase="phase7", name="Critical Asset With No Security Activity", severity="High",
        finding_type="Critical Asset Inactivity",
        description="Critical assets without observable security-alert activity during the observation period.",
        thresholds={"minimum_critical_assets": 3, "minimum_inactive_critical": 2}, minimum_population=3,
    ),
    "NS003": dict(
        phase="phase7", name="Missing Security Telemetry Category Blindspot", severity="Medium",
        finding_type="Alert Source Coverage",
        description="Absence of alerts from expected core telemetry categories (e.g. EDR, Firewall/Network, IAM, Cloud Security) observed across peer entities.",
        thresholds={"cohort_prevalence_threshold": 0.60, "minimum_entity_alerts": 20}, minimum_population=20,
    ),
    "NS004": dict(
        phase="phase7", name="Unexpectedly Low Activity", severity="Medium", finding_type="Low Activity",
        description="Entity activity materially below its own trailing observed monthly baseline.",
        thresholds={"minimum_previous_months": 3, "maximum_current_ratio": 0.30, "minimum_historical_alerts": 1},
        minimum_population=3,
    ),
    "NS005": dict(
        phase="phase7", name="Expected Investigation Missing", severity="High", finding_type="Missing Investigation",
        description="Critical alerts without associated cases, where the critical-alert population is sufficient for an absence signal.",
        thresholds={"minimum_eligible_critical_alerts": 3}, minimum_population=3,
    ),
    "NS006": dict(
        phase="phase7", name="Expected Escalation Evidence Missing", severity="High",
        finding_type="Missing Escalation Evidence",
        description="Deferred: this would duplicate Phase 6 entity-level escalation execution-gap evidence without a distinct absence contract.",
        thresholds={}, minimum_population=0, enabled=False,
        deferred_reason="Phase 6 already evaluates critical escalation execution against an explicit expectation; no additional absence-of-record contract is defined.",
    ),
    "PB001": dict(
        phase="phase8", name="Critical Escalation Peer Deviation", severity="Medium", finding_type="Peer Deviation",
        description="Critical escalation differs materially from structural peers.",
        thresholds={"minimum_peers": 3, "minimum_critical_cases": 5, "minimum_rate_gap": 0.15},
        metric="critical_escalation_rate", population=("critical_case_count", 5),
    ),
    "PB002": dict(
        phase="phase8", name="Investigation Duration Peer Deviation", severity="Medium",
        finding_type="Peer Deviation",
        description="Critical investigation duration differs materially from structural peers.",
        thresholds={"minimum_peers": 3, "minimum_critical_cases": 5},
        metric="critical_median_investigation_minutes", population=("critical_case_count", 5),
    ),
    "PB003": dict(
        phase="phase8", name="Remediation Rate Peer Deviation", severity="Medium", finding_type="Peer Deviation",
        description="Remediation rate differs materially from structural peers.",
        thresholds={"minimum_peers": 3, "minimum_closed_cases": 10, "minimum_rate_gap": 0.15},
        metric="remediation_rate", population=("closed_case_count", 10),
    ),
    "PB004": dict(
        phase="phase8", name="Operational Volume Per Asset Deviation", severity="Medium",
        finding_type="Peer Deviation",
        description="Alert volume per asset differs materially from structural peers.",
        thresholds={"minimum_peers": 3, "minimum_assets": 20},
        metric="alerts_per_asset", population=("total_assets", 20),
    ),
    "AN001": dict(
        phase="phase8", name="Unusual Operational Profile", severity="Medium", finding_type="Unknown Anomaly",
        description="Entity operational profile is unusual in the global population.",
        thresholds={"minimum_entities": 10, "contamination": 0.10},
    ),
}

# --- fixed values: message texts ({name:spec} as in Python format strings) -------------------------------------

TITLES = {
    "R001": "Critical alert closed unusually quickly",
    "R002": "Critical alert without escalation",
    "R003": "Repeated alert activity without recorded remediation",
    "R004": "Potentially shallow investigation",
    "R005": "Potential monitoring coverage gap",
    "EG001": "Potential critical escalation execution gap",
    "EG002": "Potentially insufficient investigation effort relative to configured expectation",
    "EG003": "Potential remediation execution gap",
    "EG004": "Potential rapid-closure execution gap",
    "NS001": "Potential monitoring coverage gap",
    "NS002": "Critical assets with no observable security activity",
    "NS003": "Absence of expected security telemetry category",
    "NS004": "Potentially low activity relative to own history",
    "NS005": "Potential missing investigation evidence",
    "PB": "Significant peer deviation in {metric}",
    "AN001": "Unusual operational profile",
}

SUMMARIES = {
    "R001": "Critical case {id} was closed in {minutes:.1f} minutes.",
    "R002": "Critical case {id} has no associated escalation record.",
    "R003": "Asset {id} has {alert_count} alerts and {case_count} associated cases without recorded remediation.",
    "R004": "{severity} case {id} was investigated for {minutes:.1f} minutes.",
    "R005": "Entity {entity_id} has {without_activity} expected-monitored assets without alert activity.",
    "EG001": "{entity_id}'s critical-case escalation rate is materially below the configured baseline.",
    "EG002": "{entity_id}'s critical-case investigation duration is materially below the configured minimum expectation.",
    "EG003": "{entity_id}'s remediation rate is materially below the configured minimum expectation.",
    "EG004": "{entity_id}'s rapid-closure rate is materially above the configured expected maximum.",
    "NS001": "{inactive} expected-monitored assets have no observable alert activity.",
    "NS002": "{inactive} critical assets have no observable security-alert activity.",
    "NS003": "Entity has no observable alerts from expected core category: {missing}.",
    "NS004": "Current monthly alert activity is materially below the entity's own trailing observed baseline.",
    "NS005": "{missing} critical alerts have no associated case.",
    "PB": "{metric} differs materially from the peer reference median.",
    "AN001": "The entity's operational feature profile was unusual in the global population.",
}

RATIONALES = {
    "R001": "Critical case {id} had an investigation duration below the configured 10-minute threshold. This is a potential rapid closure concern, not a confirmed failure.",
    "R002": "Critical case {id} is marked non-escalated. The rule reports the missing escalation record without asserting that escalation was required.",
    "R003": "Asset {id} meets the minimum repeated-activity threshold of 3 alerts, while its associated cases contain no recorded remediation. This is an operational signal, not a confirmed incident.",
    "R004": "The investigation duration is below the configured 10-minute proxy threshold for high or critical cases. This is a potentially shallow investigation signal, not a definitive assessment.",
    "R005": "Observed monitoring coverage is {coverage:.3f}, below the configured 0.90 threshold, with at least 5 expected-monitored assets without activity. This is a potential coverage gap, not confirmed telemetry loss.",
    "EG001": "Expected critical escalation rate: {expected:.1%}. Observed rate: {observed:.1%}. Gap: {gap:.1%}. Population: {population} critical cases. This indicates a potential execution weakness, not a confirmed control failure.",
    "EG002": "Configured minimum expectation: {expected:.1f} minutes. Observed median: {observed:.1f} minutes. Observed/expectation ratio: {ratio:.2f}. Population: {population} critical cases. Reference population median: {reference:.1f} minutes when available. This is a potential execution gap, not a definitive investigation assessment.",
    "EG003": "Configured minimum expectation: {expected:.1%}. Observed rate: {observed:.1%}. Gap: {gap:.1%}. Population: {population} closed cases. Reference population median: {reference:.1%} when available. This is a potential remediation execution gap, not a confirmed failure.",
    "EG004": "Expected maximum rapid-closure rate: {expected:.1%}. Observed rate: {observed:.1%}. Gap: {gap:.1%}. Population: {population} closed cases. This is a systematic operational signal, not a confirmed control failure.",
    "NS001": "Expected monitored assets: {expected}. Assets with activity: {active}. Missing activity: {inactive}. Coverage: {coverage:.1%}. Observation window: {start} to {end}. This is a potential coverage gap, not confirmed telemetry loss.",
    "NS002": "Critical assets: {expected}. Critical assets with activity: {active}. No-activity critical assets: {inactive}. Observation window: {start} to {end}. No observable activity does not prove the assets are unmonitored.",
    "NS003": "Entity has {total} total alerts across sources [{observed}], but 0 alerts from expected core categories [{missing}] present in >= 60% of cohort peers ({expected_count} expected categories total). Observation window: {start} to {end}.",
    "NS004": "Trailing three-month median: {baseline:.1f} alerts. Current month: {observed:.1f} alerts. Observation window: {start} to {end}. This is a temporal absence signal, not a peer comparison.",
    "NS005": "Eligible critical alerts: {eligible}. Critical alerts without cases: {missing}. Observation window: {start} to {end}. The rule treats critical alerts as the configured expected-investigation population and does not assume this for lower severities.",
    "PB": "Observed {metric}: {observed:.3g}. Peer median: {median:.3g} across {peers} comparable entities in cohort {cohort}. Absolute deviation: {deviation:.3g}. This is a peer-relative signal, not a control-failure finding.",
    "AN001": "Contributing deviations: {deviations}. These are contextual deviations, not formal feature attribution or risk scores.",
    "AN001_ITEM": "{feature}={observed:.3g} vs population median {reference:.3g}",
}

EVIDENCE_REASONS = {
    "R001_minutes": "Closed critical case duration used by R001.",
    "R001_severity": "Case severity used by R001.",
    "case_alert": "Alert associated with the case.",
    "R002_severity": "Critical case severity used by R002.",
    "R002_escalated": "Case escalation state used by R002.",
    "R003_alerts": "Repeated alert count used by R003.",
    "R003_cases": "Associated case count used by R003.",
    "R003_remediated": "No associated case has recorded remediation.",
    "R003_case": "Associated case has no recorded remediation.",
    "R004_severity": "Case severity used by R004.",
    "R004_minutes": "Investigation duration used by R004.",
    "R005": "Entity monitoring feature used by R005: {field}.",
    "EG_feature": "Entity feature {field} supports {rule}.",
    "EG_case": "Representative case evidence supports {rule}.",
    "NS001_entity": "Entity monitoring features establish expected versus observed activity.",
    "NS001_asset": "Expected-monitored asset has no alert activity.",
    "NS002_asset": "Critical asset has no observable security-alert activity.",
    "NS003": "Entity alert telemetry lacks expected core category: {missing}.",
    "NS004": "Entity's own monthly activity history supports NS004.",
    "NS005": "Critical alert lacks an associated case.",
    "PB_entity": "Observed entity value and structural peer cohort.",
    "PB_peer": "Comparable peer value used to calculate the reference median.",
    "AN001": "Operational feature contributing to the unusual-profile context.",
}

MAX_GAP_EVIDENCE_CASES = 10
MAX_ABSENCE_EVIDENCE_ROWS = 20

# --- fixed values: anomaly forest ---------------------------------------------------------------------------

FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_SEED = 42
FOREST_CONTAMINATION = 0.10
FOREST_MIN_ENTITIES = 10

# --- fixed values: risk model -------------------------------------------------------------------------------

DIMENSIONS = (
    ("Escalation", "escalation_score", 0.25, "Unescalated critical security cases & escalation execution gaps"),
    ("Investigation", "investigation_score", 0.20, "Investigation duration, rapid closure prevalence, & uninvestigated alerts"),
    ("Remediation", "remediation_score", 0.20, "Asset vulnerability remediation execution & multi-phase gaps"),
    ("Monitoring", "monitoring_score", 0.15, "Critical asset monitoring coverage & negative-space blindspots"),
    ("Operational Discipline", "operational_discipline_score", 0.10, "Alert triage activity stability & baseline operational discipline"),
    ("Cyber Resilience", "cyber_resilience_score", 0.10, "Contextual multivariate anomaly profile (AN001, capped influence)"),
)

RISK_BANDS = (("LOW", 0.0, 24.999), ("MODERATE", 25.0, 49.999), ("HIGH", 50.0, 74.999), ("CRITICAL", 75.0, 100.0))
PRIORITY_LIMITS = (("HIGH", 70.0), ("MEDIUM", 40.0), ("LOW", 0.0))

CORRELATION_GROUPS = (
    ("CRITICAL_ESCALATION", "Escalation", ("R002", "EG001", "PB001", "AN001"),
     ("critical_escalation_rate", "escalation_rate"),
     "Evaluation of critical alert and case escalation to management and response teams."),
    ("INVESTIGATION_EFFORT", "Investigation", ("R004", "EG002", "PB002", "AN001"),
     ("critical_median_investigation_minutes", "mean_investigation_minutes", "case_rate"),
     "Evaluation of active investigation effort and duration dedicated to high/critical cases."),
    ("RAPID_CLOSURE", "Investigation", ("R001", "EG004", "AN001"),
     ("rapid_closure_rate", "critical_rapid_closure_rate"),
     "Evaluation of premature or unusually rapid case closures."),
    ("UNINVESTIGATED_ALERTS", "Investigation", ("NS005",), (),
     "Evaluation of critical alerts closed or discarded without an associated investigation case."),
    ("REMEDIATION", "Remediation", ("R003", "EG003", "PB003", "AN001"), ("remediation_rate",),
     "Evaluation of whether identified security issues are remediated versus repeated indefinitely."),
    ("MONITORING_COVERAGE", "Monitoring", ("R005", "NS001", "NS002", "NS003", "PB004", "AN001"),
     ("monitoring_coverage_rate", "alerts_per_asset", "cases_per_asset"),
     "Evaluation of asset monitoring telemetry, missing telemetry categories, inactive expected assets, and blindspots."),
    ("ACTIVITY_VOLATILITY", "Operational Discipline", ("NS004",), ("alert_count",),
     "Evaluation of sudden drop-offs in observed entity activity against trailing history."),
    ("ANOMALY_PROFILE", "Cyber Resilience", ("AN001",), ("*",),
     "Contextual multivariate anomaly detection indicating overall unusual operational profile."),
)

BOOST_PER_PHASE = 0.12
MAX_BOOST = 0.30
ANOMALY_CEILING = 25.0
RAPID_CLOSURE_SIGNAL_DIVIDER = 0.40

SIGNAL_NAMES = {
    "R001": "Critical Rapid Closure Prevalence",
    "R002": "Unescalated Critical Case Prevalence",
    "R003": "Unremediated Repeated Alert Asset Prevalence",
    "R004": "Short Investigation Duration Prevalence",
    "R005": "Monitoring Coverage Gap",
    "AN001": "Unusual Operational Profile (Contextual Anomaly)",
}

UNASSESSABLE_REASONS = {
    "R001": "No closed cases observed for entity.",
    "R002": "No critical cases observed for entity.",
    "R003": "No asset inventory available.",
    "R004": "No cases observed for entity.",
    "R005": "No expected-monitored assets defined.",
    "R005_value": "Observed monitoring gap is not numeric and cannot be normalized.",
    "other": "No normalization rule registered for detector {rule}.",
}

SIGNAL_RATIONALES = {
    "R001": "{count} critical rapid closure findings observed across {denominator} closed cases ({norm:.1f}% prevalence).",
    "R002": "{count} unescalated critical cases out of {denominator} critical cases ({norm:.1f}% prevalence).",
    "R003": "{count} assets with repeated unremediated alerts across {denominator} total assets.",
    "R004": "{count} short investigation cases out of {denominator} total cases ({norm:.1f}% prevalence).",
    "R005": "Observed monitoring gap on expected-monitored assets: {observed} gap assets out of {denominator}.",
    "EG": "Execution gap of {gap:.3g} against configured baseline {baseline:.3g} ({rationale})",
    "AN001": "Contextual relative anomaly signal (rank {rank}, avg dev {deviation:.2f}) from Isolation Forest; not a probability of compromise or compliance violation.",
}

GROUP_RATIONALE = (
    "Correlation Group {group}: Base signal {base:.1f} from {primary}. {phases} with boost +{boost:.0f}%, resulting "
    "in final group score {final:.1f}. Participating detectors: {details}."
)
GROUP_RATIONALE_DETAIL = "{detector} ({phase}, norm={norm:.1f})"
GROUP_RATIONALE_MANY = "Corroborated across {count} phases ({phases})"
GROUP_RATIONALE_ONE = "Observed in single phase"

TOP_REASON = "{dimension} concern: {group} score {final:.1f} ({level} corroboration via {detectors})."
NO_REASON = "No material operational risks or execution gaps identified."

QUEUE_REASONS = {
    "ENTITY": "Supervisory audit recommendation for {entity_id}: Risk band {band} ({score:.1f}/100). Key concern: {reason}. {gap}{blindspot}Corroboration: {corroboration}.",
    "ENTITY_GAP": "Systemic execution gap detected; ",
    "ENTITY_BLINDSPOT": "Unmonitored assets/blindspots observed; ",
    "FINDING": "Execution Gap ({rule}): {title}. Gap: {gap:.3g} vs baseline {baseline}.",
    "ASSET": "Unmonitored Blindspot ({rule}): {title}. Critical asset without observed security activity.",
}

DIRECTIVES = {
    "audit": "Priority Supervisory Audit: Schedule direct inspection with entity SOC management within 14 business days.",
    "escalation": "Escalation Governance Review: Inspect unescalated critical cases and mandate formal escalation policy enforcement.",
    "investigation": "Investigation Depth Audit: Review closed case work notes for template-driven or superficial triage behaviors.",
    "monitoring": "Telemetry Gap Verification: Request updated asset-to-SIEM mapping to remediate unmonitored critical assets and category blindspots.",
    "routine": "Routine Monitoring: Continue standard periodic supervisory review cycle.",
}

DEFERRED_IN_RISK = {
    "EG005": "Deferred: lacks defensible documentation-quality standard baseline.",
    "NS006": "Deferred: avoid duplicating Phase 6 critical escalation execution gap.",
}

# --- fixed values: integrity --------------------------------------------------------------------------------

FINDING_DIGEST_FIELDS = (
    "entity_id", "expected_value", "finding_id", "metric_name", "observed_value", "rationale", "rule_id", "severity",
)
EVIDENCE_DIGEST_FIELDS = ("entity_id", "field", "finding_id", "reason", "source_id", "source_type", "value")
SUBMISSION_FILES = (
    "entities.parquet", "assets.parquet", "alerts.parquet", "cases.parquet", "escalations.parquet", "manifest.json",
)


def enabled(phase: str) -> list[str]:
    """Enabled detector ids of one phase, in definition order."""
    return [key for key, item in DETECTORS.items() if item["phase"] == phase and item.get("enabled", True)]


def deferred(phase: str) -> dict[str, str]:
    """Deferred detector ids of one phase with the stated reason."""
    return {
        key: item["deferred_reason"]
        for key, item in DETECTORS.items()
        if item["phase"] == phase and not item.get("enabled", True)
    }
