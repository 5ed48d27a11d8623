"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vigilframe import catalog, schemas, session
from vigilframe.functions.text import round_half_even
from vigilframe.operators import (
    absence, audit, features, forest, gaps, integrity, normalize, peers, scoring, serving, validate,
)
from vigilframe.operators.findings import Detection, combine, finalize
from vigilframe.plans import analysis
from vigilframe.plans.oracle import EVIDENCE_COLUMNS, FINDING_COLUMNS
from vigilframe.sources import files, fixture_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Engine-neutral types: whole numbers as bigint, times and dates as text, lists joined by a bar."""

    def column(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("long")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            value = F.array_join(value, "|")
        return value.alias(field.name)

    return df.select(*[column(field) for field in df.schema])


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: comparable(function(spark, sf_dir))
        return function

    return add


# --- shared steps ---------------------------------------------------------------------------------------------
#
# As in a pipeline run, the detectors read feature tables that were written once, and the risk steps read findings
# that were written once. Within a session these tables are kept per data directory; reset() forgets them.

_KEPT: dict[tuple, object] = {}


def reset() -> None:
    _KEPT.clear()


def once(function: Callable) -> Callable:
    def kept(spark: SparkSession, sf_dir: str):
        key = (function.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _KEPT:
            _KEPT[key] = function(spark, sf_dir)
        return _KEPT[key]

    return kept


@once
def canonical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture_views.canonical_tables(spark, sf_dir)


@once
def lazy_features(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return features.feature_tables(canonical_tables(spark, sf_dir))


@once
def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Feature tables, written once to the checkpoint folder."""
    tables = features.feature_tables(canonical_tables(spark, sf_dir), keep=session.stage)
    written = {"case_features", "asset_features"}
    return {name: frame if name in written else session.stage(frame) for name, frame in tables.items()}


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle(spark, sf_dir)["entity_features"]


@once
def peer_detection(spark: SparkSession, sf_dir: str) -> Detection:
    """Peer deviations and anomalies, written once: the forest is grown a single time."""
    return analysis.stage_detection(analysis.evaluate_peers(bundle(spark, sf_dir)))


@once
def detection(spark: SparkSession, sf_dir: str) -> Detection:
    """Findings and evidence of all detectors, written once to the checkpoint folder."""
    tables, peer = bundle(spark, sf_dir), peer_detection(spark, sf_dir)
    others = [analysis.FAMILIES[phase](tables) for phase in ("phase5", "phase6", "phase7")]
    return analysis.stage_detection(combine([*others, peer]))


@once
def risk(spark: SparkSession, sf_dir: str) -> analysis.RiskRun:
    found = detection(spark, sf_dir)
    return analysis.assess_risk(entity_table(spark, sf_dir), found.findings, found.evidence, staged=True)


@once
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(spark, sf_dir).review_queue()


# --- canonical tables and ingestion ---------------------------------------------------------------------------


def _canonical(name: str) -> None:
    @register(f"canonical_{name}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return canonical_tables(spark, sf_dir)[name]


for _name in catalog.DATASETS:
    _canonical(_name)


@register("normalize_text_bool_datetime")
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture_views.raw_tables(spark, canonical_tables(spark, sf_dir))
    return normalize.normalize(raw["raw_cases"], "cases").frame


@register("normalize_issues")
def _normalize_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture_views.raw_tables(spark, canonical_tables(spark, sf_dir))
    return normalize.normalize(raw["raw_cases"], "cases").issues


def _raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as a submission might hold them: other names, padded text, ISO times, one of 37 unreadable, optional columns missing."""
    alerts, at = canonical_tables(spark, sf_dir)["alerts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    unreadable = F.substring("id", -9, 9).cast("long") % 37 == 0
    return alerts.select(
        F.concat(F.lit("  "), "id").alias("alert_id"), "entity_id", "asset_id",
        F.when(unreadable, "not-a-date").otherwise(F.date_format("timestamp", at)).alias("detected_at"),
        F.concat("severity", F.lit(" ")).alias("severity_level"), "source", "status", F.lit("x").alias("extra"),
    )


@register("normalize_alerts")
def _normalize_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases renamed, texts trimmed, times parsed, missing optional columns null."""
    return normalize.normalize(_raw_alerts(spark, sf_dir), "alerts").frame


def _faulty(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture_views.faulty_tables(spark, canonical_tables(spark, sf_dir))


@register("validate_frame_issues")
def _frame_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.frames_issues(_faulty(spark, sf_dir))


@register("validate_references")
def _reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reference_issues(_faulty(spark, sf_dir))


@register("validate_temporal")
def _temporal_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.temporal_issues(_faulty(spark, sf_dir))


@register("quality_report")
def _quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _faulty(spark, sf_dir)
    report = validate.quality_report(validate.bundle_issues(tables), tables, files=len(tables))
    return report.select("status", "files", "total_rows", "errors", "warnings", "summary")


@register("report_lines")
def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _faulty(spark, sf_dir)
    issues = session.stage(validate.bundle_issues(tables))
    return validate.report_lines(validate.quality_report(issues, tables, files=len(tables)), issues)


@register("integrity_audit")
def _integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.integrity_audit(_faulty(spark, sf_dir))


# --- features -------------------------------------------------------------------------------------------------


def _feature(name: str) -> None:
    @register(name)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lazy_features(spark, sf_dir)[name]


for _name in catalog.FEATURE_TABLES:
    _feature(_name)


@register("recent_alert_count")
def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sliced_alert_counts(canonical_tables(spark, sf_dir)["alerts"])


@register("time_features")
def _time(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = canonical_tables(spark, sf_dir)["alerts"].select("id", "timestamp")
    return features.time_features(alerts, "timestamp")


# --- detectors ------------------------------------------------------------------------------------------------


def _detector(query_name: str, rule_id: str) -> None:
    @register(query_name)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis.evaluate_detector(rule_id, bundle(spark, sf_dir)).findings.select(*FINDING_COLUMNS)


LABELS = {"phase5": "rule", "phase6": "gap", "phase7": "absence", "phase8": "peer"}
for _phase, _label in LABELS.items():
    for _rule in catalog.enabled(_phase):
        if _rule != "AN001":
            _detector(f"{_label}_{_rule.lower()}", _rule)


def _family(phase: str, label: str) -> None:
    def evaluate(spark: SparkSession, sf_dir: str) -> Detection:
        return peer_detection(spark, sf_dir) if phase == "phase8" else analysis.FAMILIES[phase](bundle(spark, sf_dir))

    @register(f"{label}_findings_all")
    def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(spark, sf_dir).findings.select(*FINDING_COLUMNS)

    @register(f"{label}_evidence_all")
    def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(spark, sf_dir).evidence.select(*EVIDENCE_COLUMNS)


for _phase, _label in LABELS.items():
    _family(_phase, _label)


@register("population_median")
def _population_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = entity_table(spark, sf_dir)
    minutes = gaps.population_median(entities, "critical_median_investigation_minutes", "critical_case_count", 5)
    rates = gaps.population_median(entities, "remediation_rate", "closed_case_count", 10)
    return minutes.withColumn("detector_id", F.lit("EG002")).unionByName(rates.withColumn("detector_id", F.lit("EG003")))


@register("observation_window")
def _observation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absence.observation_window(bundle(spark, sf_dir))


@register("source_prevalence")
def _source_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absence.source_prevalence(bundle(spark, sf_dir)["alert_features"])


@register("cohorts")
def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.cohorts(entity_table(spark, sf_dir))


@register("cohort_members")
def _cohort_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.cohort_members(entity_table(spark, sf_dir))


@register("benchmark_table")
def _benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = peers.benchmark_table(entity_table(spark, sf_dir))
    return table.withColumns({name: round_half_even(F.col(name), 6) for name in ("peer_mean", "peer_std")})


@register("peer_reference_values")
def _peer_reference_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.peer_reference_values(entity_table(spark, sf_dir))


@register("anomaly_profile")
def _anomaly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.column_profile(entity_table(spark, sf_dir))


@register("anomaly_matrix")
def _anomaly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.anomaly_matrix(entity_table(spark, sf_dir))


def _filled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = forest.anomaly_matrix(entity_table(spark, sf_dir))
    return matrix.select("entity_id", *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in forest.FEATURES])


@register("anomaly_sample")
def _anomaly_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that each tree is grown from."""
    rows = forest.sample_trees(_filled_matrix(spark, sf_dir), catalog.FOREST_TREES, catalog.FOREST_SAMPLE, catalog.FOREST_SEED)
    return rows.select("tree", "entity_id")


@register("anomaly_scores")
def _anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = forest.isolation_scores(forest.anomaly_matrix(entity_table(spark, sf_dir)))
    return scores.select("entity_id", round_half_even(F.col("score"), 9).alias("score"))


@register("anomaly_flags")
def _anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities below the contaminated share, with their rank."""
    flagged = forest.detect_anomalies(entity_table(spark, sf_dir))
    return flagged.select("entity_id", round_half_even(F.col("anomaly_score"), 9).alias("anomaly_score"), "anomaly_rank")


@register("anomaly_an001")
def _anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.anomaly_detection(entity_table(spark, sf_dir)).findings.select(*FINDING_COLUMNS, "anomaly_score", "anomaly_rank")


# --- risk -----------------------------------------------------------------------------------------------------


@register("signals")
def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(spark, sf_dir).signals.drop("contributing_features", "unassessable_reason")


@register("correlation_groups")
def _correlation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(spark, sf_dir).groups.drop("group_position")


@register("risk_contributions")
def _risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(spark, sf_dir).contributions


@register("contribution_findings")
def _contribution_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(spark, sf_dir).contribution_findings


@register("dimension_scores")
def _dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dimension_scores(entity_table(spark, sf_dir), risk(spark, sf_dir).groups)


@register("entity_risk")
def _entity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk(spark, sf_dir).entity_risk


@register("review_queue")
def _review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(spark, sf_dir)


# --- serving --------------------------------------------------------------------------------------------------


@register("portfolio_kpis")
def _portfolio_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = serving.portfolio_kpis(risk(spark, sf_dir).entity_risk)
    return kpis.withColumn("average_coverage", round_half_even(F.col("average_coverage"), 6))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.enrich_entities(risk(spark, sf_dir).entity_risk, entity_table(spark, sf_dir))


@register("sector_averages")
def _sector_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.sector_averages(_enriched(spark, sf_dir))


@register("dimension_averages")
def _dimension_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.dimension_averages(risk(spark, sf_dir).entity_risk)


@register("distinct_sectors")
def _distinct_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.distinct_sectors(_enriched(spark, sf_dir))


@register("elevated_dimensions")
def _elevated_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.elevated_dimensions(risk(spark, sf_dir).entity_risk)


@register("entity_search")
def _entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.search_entities(_enriched(spark, sf_dir), criticality="Medium", text="BUILD", sort="overall_score")
    return found.select("entity_id", "name", "sector", "size", "criticality", "overall_score", "risk_band")


@register("queue_by_priority")
def _queue_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, run = detection(spark, sf_dir), risk(spark, sf_dir)
    return serving.queue_by_priority(scoring.queue_items(run.assessment, found.findings, found.evidence))


@register("queue_search")
def _queue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = review_queue(spark, sf_dir)
    return serving.search_queue(queue, priority="HIGH", record_type="FINDING", text="remediation")


@register("queue_headings")
def _queue_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.queue_headings(review_queue(spark, sf_dir))


@register("top_queue_item")
def _top_queue_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_queue_item(review_queue(spark, sf_dir))


@register("why_flagged")
def _why_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = risk(spark, sf_dir)
    return serving.why_flagged(run.entity_risk, run.contributions, run.contribution_findings)


@register("finding_detail")
def _finding_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection(spark, sf_dir)
    return serving.finding_detail(found.findings, found.evidence)


@register("finding_lookup")
def _finding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding of any phase with its evidence: the first by id."""
    found = detection(spark, sf_dir)
    wanted = found.findings.agg(F.min("id")).first()[0]
    return serving.finding_detail(*serving.find_finding(found, wanted))


@register("entity_contributions")
def _entity_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of one entity: the first by id that has some."""
    contributions = risk(spark, sf_dir).contributions
    return serving.entity_contributions(contributions, contributions.agg(F.min("entity_id")).first()[0])


def _put_together(spark: SparkSession, sf_dir: str) -> Detection:
    """Outputs of two runs put together: every row twice, findings once retitled, and evidence whose finding is gone."""
    found = detection(spark, sf_dir)
    retitled = found.findings.withColumn("title", F.concat("title", F.lit(" (again)")))
    orphans = found.evidence.withColumns({"finding_id": F.concat("finding_id", F.lit("-gone")), "id": F.concat("id", F.lit("-gone"))})
    return finalize(Detection(found.findings.unionByName(retitled), found.evidence.unionByName(found.evidence).unionByName(orphans)))


@register("finalized_findings")
def _finalized_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _put_together(spark, sf_dir).findings.select(*FINDING_COLUMNS)


@register("finalized_evidence")
def _finalized_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _put_together(spark, sf_dir).evidence.select(*EVIDENCE_COLUMNS)


@register("detector_report")
def _detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector, enabled or deferred, with the findings it made."""
    counts = detection(spark, sf_dir).findings.groupBy(F.col("rule_id").alias("detector_id")).agg(F.count(F.lit(1)).alias("findings"))
    return serving.detector_catalogue(spark).join(counts, "detector_id", "left").select(
        "detector_id", "phase", "name", "finding_type", "severity", "enabled", F.coalesce("findings", F.lit(0)).alias("findings")
    )


@register("run_report")
def _run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.run_report(detection(spark, sf_dir).findings)


@register("run_summary")
def _run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.run_summary(*detection(spark, sf_dir))


@register("entities_benchmarked")
def _entities_benchmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.entities_benchmarked(analysis.evaluate_peers(bundle(spark, sf_dir), anomalies=False).findings)


@register("dossier")
def _dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, found, run = entity_table(spark, sf_dir), detection(spark, sf_dir), risk(spark, sf_dir)
    result = serving.dossiers(
        run.entity_risk, entities, run.contributions, review_queue(spark, sf_dir), found.findings, found.evidence, "20240101"
    )
    return result.withColumns({name: F.to_json(name) for name in ("dimensions", "risk_contributions")})


@register("dossier_dimensions")
def _dossier_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension rows of all dossiers, one row each."""
    entities, found, run = entity_table(spark, sf_dir), detection(spark, sf_dir), risk(spark, sf_dir)
    result = serving.dossiers(
        run.entity_risk, entities, run.contributions, review_queue(spark, sf_dir), found.findings, found.evidence, "20240101"
    )
    return result.select("entity_id", F.inline("dimensions"))


@register("dossier_summary")
def _dossier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dossier says of its entity outside its lists."""
    entities, found, run = entity_table(spark, sf_dir), detection(spark, sf_dir), risk(spark, sf_dir)
    result = serving.dossiers(
        run.entity_risk, entities, run.contributions, review_queue(spark, sf_dir), found.findings, found.evidence, "20240101"
    )
    return result.select(
        "dossier_id", "entity_id", "title", "name", "sector", "size", "criticality", "total_assets", "total_alerts", "total_cases",
        "overall_score", "risk_band", "top_risk_dimension", "review_queue_rank", "review_priority_score", "review_urgency", "finding_count",
        F.size("risk_contributions").alias("contribution_count"),
    )


@register("dossier_inventory")
def _dossier_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.dossier_inventory(detection(spark, sf_dir).findings)


# --- integrity ------------------------------------------------------------------------------------------------


@register("finding_digest")
def _finding_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.finding_records(detection(spark, sf_dir).findings)


@register("evidence_digest")
def _evidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.evidence_records(detection(spark, sf_dir).evidence)


@register("table_digests")
def _table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every language's documents, each document a part."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return integrity.table_digests(documents.select(
        F.col("lang").alias("file"), F.col("doc_id").cast("string").alias("part"), integrity.text_digest(F.col("text")).alias("sha256")))


@register("submission_digest")
def _submission_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the directory the tables come from, over the files the canonical tables are built on."""
    names = ("customer.parquet", "events.parquet", "nation.parquet")
    parts = files.file_digests(spark, [f"{sf_dir}/{name}" for name in names])
    return integrity.submission_digest(
        parts.select(F.col("filename").alias("file"), F.col("filename").alias("part"), "sha256"), names
    )


def _tampered(findings: DataFrame) -> DataFrame:
    """A later copy of the findings in which every critical-case rule finding has another severity."""
    changed = F.when(F.col("rule_id") == "R002", "Low").otherwise(F.col("severity"))
    return findings.withColumn("severity", changed)


def _commitments(findings: DataFrame) -> DataFrame:
    """Commitments of all findings but the peer deviations, the execution gaps registered twice."""
    records = integrity.finding_records(findings)
    none = files.empty(findings.sparkSession, schemas.COMMITMENTS)
    first = integrity.register(records.filter(F.col("source_phase") != "phase8"), none, "2024-07-01 00:00:00")
    second = integrity.register(records.filter(F.col("source_phase") == "phase6"), first, "2024-08-01 00:00:00")
    return first.unionByName(second)


@register("commitment_verify")
def _commitment_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = detection(spark, sf_dir).findings
    return integrity.verify(integrity.finding_records(_tampered(findings)), _commitments(findings))


@register("commitment_history")
def _commitment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.history(_commitments(detection(spark, sf_dir).findings))


@register("commitment_latest")
def _commitment_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.latest(_commitments(detection(spark, sf_dir).findings))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution gap EG001 from raw events to findings, as one lazy plan."""
    return analysis.evaluate_detector("EG001", lazy_features(spark, sf_dir)).findings

