"""Lookups, searches and dashboard aggregates over the published tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilframe import catalog
from vigilframe.functions.text import round_half_even
from vigilframe.operators.findings import Detection
from vigilframe.operators.peers import PEER_DETECTORS

ALL = "ALL"
DIMENSION_FIELDS = {name: field for name, field, _, _ in catalog.DIMENSIONS}


class NotFound(ValueError):
    """No record with the given id."""


# --- catalogues and configuration -----------------------------------------------------------------------------


def detector_catalogue(spark: SparkSession, phase: str | None = None) -> DataFrame:
    """Detector definitions as a table, thresholds as a JSON text."""
    rows = [
        (
            name, item["phase"], item["name"], item["description"], item["finding_type"], item["severity"],
            item.get("enabled", True), json.dumps(item["thresholds"], sort_keys=True), item.get("deferred_reason"),
        )
        for name, item in catalog.DETECTORS.items()
        if phase in (None, item["phase"])
    ]
    return spark.createDataFrame(
        rows,
        "detector_id string, phase string, name string, description string, finding_type string, severity string, "
        "enabled boolean, thresholds string, deferred_reason string",
    )


def group_catalogue(spark: SparkSession) -> DataFrame:
    """Correlation groups: a fixed table of eight rows."""
    rows = [
        (group, place, dimension, list(detectors), description)
        for place, (group, dimension, detectors, _, description) in enumerate(catalog.CORRELATION_GROUPS)
    ]
    return spark.createDataFrame(
        rows, "group_id string, group_position int, dimension string, detectors array<string>, description string"
    )


def dimension_config(spark: SparkSession, manifest: dict | None = None) -> DataFrame:
    """Dimension metadata of a manifest, or the built-in one when the manifest has none or not all six."""
    stated = (manifest or {}).get("dimensions_config") or []
    rows = (
        [(item["key"], item["field"], float(item["weight"]), item["description"]) for item in stated]
        if len(stated) == len(catalog.DIMENSIONS)
        else list(catalog.DIMENSIONS)
    )
    return spark.createDataFrame(rows, "dimension string, field string, weight double, description string")


def band_limits(manifest: dict | None = None) -> dict[str, float]:
    """Lower limits of the risk bands, from a manifest if all are numeric there."""
    fallback = {"moderate": 25.0, "high": 50.0, "critical": 75.0}
    stated = (manifest or {}).get("risk_band_thresholds") or {}
    try:
        return {name: float(stated[name.upper()][0]) for name in fallback}
    except (KeyError, IndexError, TypeError, ValueError):
        return fallback


def band_label(band: Column, limits: dict[str, float] | None = None) -> Column:
    """Text of a band's score range."""
    limit = limits or band_limits()

    def text(low: float, high: float) -> str:
        return f"Score {low:.1f}–{high - 0.1:.1f}"

    return (
        F.when(band == "CRITICAL", f"Score ≥ {limit['critical']:.1f}")
        .when(band == "HIGH", text(limit["high"], limit["critical"]))
        .when(band == "MODERATE", text(limit["moderate"], limit["high"]))
        .when(band == "LOW", text(0.0, limit["moderate"]))
    )


def parse_finding_ids(value: Column) -> Column:
    """Finding ids from a JSON text list; a bare finding id is a list of one, anything else is empty."""
    parsed = F.from_json(value, "array<string>")
    none = F.array().cast("array<string>")
    return (
        F.when(F.trim(value).startswith("["), F.coalesce(parsed, none))
        .when(value.startswith("F-"), F.array(value))
        .otherwise(none)
    )


def parse_deviations(value: Column) -> Column:
    """Contributing deviations from their JSON export; null when the text is no list."""
    return F.from_json(
        value,
        "array<struct<feature:string,observed_value:double,reference_value:double,relative_deviation:double>>",
    )


# --- findings -------------------------------------------------------------------------------------------------


def find_finding(detection: Detection, finding_id: str) -> Detection:
    """One finding and its evidence; both filters reach the Parquet scan."""
    finding = detection.findings.filter(F.col("id") == finding_id)
    if finding.isEmpty():
        raise NotFound(f"Finding not found: {finding_id}")
    return Detection(finding, detection.evidence.filter(F.col("finding_id") == finding_id))


def finding_detail(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with their evidence, one row per evidence item; a finding without evidence keeps one row."""
    head = findings.select("id", "rule_id", "entity_id", "source_phase", "severity", "title")
    items = evidence.select(
        F.col("finding_id").alias("id"), F.col("id").alias("evidence_id"), "source_type", "source_id", "field",
        "value", "reason",
    )
    return head.join(items, "id", "left").withColumnRenamed("id", "finding_id")


def run_report(findings: DataFrame) -> DataFrame:
    """Findings per phase, rule, severity and baseline method."""
    return findings.groupBy("source_phase", "rule_id", "severity", "baseline_method").agg(
        F.count(F.lit(1)).alias("findings")
    )


def run_summary(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts a run reports per phase."""
    phases = findings.select(F.col("id").alias("finding_id"), "source_phase")
    per_phase = findings.groupBy("source_phase").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("rule_id").alias("detectors"),
        F.count_distinct("entity_id").alias("entities"),
    )
    items = (
        evidence.groupBy("finding_id").agg(F.count(F.lit(1)).alias("rows")).join(phases, "finding_id")
        .groupBy("source_phase").agg(F.sum("rows").alias("evidence"))
    )
    return per_phase.join(items, "source_phase", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))


# --- entities -------------------------------------------------------------------------------------------------


def enrich_entities(risk: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity risk next to the entity's name, sector, size and criticality."""
    return risk.join(entities.select("entity_id", "name", "sector", "size", "criticality"), "entity_id", "left")


def find_entity(enriched: DataFrame, entity_id: str) -> DataFrame:
    row = enriched.filter(F.col("entity_id") == entity_id)
    if row.isEmpty():
        raise NotFound(f"Entity {entity_id} not found in risk assessment")
    return row


def entity_contributions(contributions: DataFrame, entity_id: str) -> DataFrame:
    return contributions.filter(F.col("entity_id") == entity_id)


def _matches(text: str, *columns: str) -> Column:
    needle = F.lit(text.lower())
    found = F.lit(False)
    for name in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), needle)
    return found


def search_entities(
    enriched: DataFrame, *, band: str = ALL, sector: str = ALL, criticality: str = ALL, text: str = "",
    sort: str = "overall_score", ascending: bool = False,
) -> DataFrame:
    """Filter by equality and by substring over id, name and sector; missing sort values count as -1."""
    result = enriched
    for name, value in (("risk_band", band), ("sector", sector), ("criticality", criticality)):
        if value != ALL:
            result = result.filter(F.col(name) == value)
    if text.strip():
        result = result.filter(_matches(text, "entity_id", "name", "sector"))
    key = F.coalesce(F.col(sort), F.lit(-1).cast(enriched.schema[sort].dataType))
    return result.orderBy(key.asc() if ascending else key.desc(), "entity_id")


def portfolio_kpis(risk: DataFrame) -> DataFrame:
    """One row: entities per band, average coverage, fully and partially assessable entities."""
    bands = [F.count_if(F.col("risk_band") == name).alias(f"{name.lower()}_entities") for name, _, _ in catalog.RISK_BANDS]
    full = F.count_if(F.col("assessment_coverage") == 1.0)
    return risk.agg(
        F.count(F.lit(1)).alias("entities"), *bands, F.avg("assessment_coverage").alias("average_coverage"),
        full.alias("fully_assessable"), (F.count(F.lit(1)) - full).alias("partially_assessable"),
    )


def sector_averages(enriched: DataFrame) -> DataFrame:
    sector = F.when(F.coalesce("sector", F.lit("")) != "", F.col("sector")).otherwise("Energy")
    return enriched.groupBy(sector.alias("sector")).agg(
        round_half_even(F.avg("overall_score")).alias("average_score"), F.count(F.lit(1)).alias("entities")
    )


def dimension_averages(risk: DataFrame) -> DataFrame:
    """Average score per dimension, a missing score counting as zero."""
    averages = risk.agg(*[F.avg(F.coalesce(field, F.lit(0.0))).alias(name) for name, field in DIMENSION_FIELDS.items()])
    return averages.unpivot([], list(DIMENSION_FIELDS), "dimension", "average").select(
        "dimension", round_half_even(F.col("average"), 1).alias("average_score")
    )


def distinct_sectors(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.coalesce("sector", F.lit("")) != "").select("sector").distinct()


def elevated_dimensions(risk: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Dimensions at or above the moderate limit per entity, strongest first (at most six each)."""
    places = {name: place for place, name in enumerate(DIMENSION_FIELDS)}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"), F.col(field).alias("score"), F.lit(places[name]).alias("place")
            )
            for name, field in DIMENSION_FIELDS.items()
        ]
    )
    kept = F.array_sort(
        F.transform(
            F.filter(rows, lambda item: item["score"] >= threshold),
            lambda item: F.struct((-item["score"]).alias("order"), item["place"].alias("place"),
                                  item["dimension"].alias("dimension"), item["score"].alias("score")),
        )
    )
    return risk.select("entity_id", F.posexplode(kept).alias("position", "item")).select(
        "entity_id", (F.col("position") + 1).alias("position"), "item.dimension", "item.score"
    )


def why_flagged(risk: DataFrame, contributions: DataFrame, links: DataFrame) -> DataFrame:
    """Per entity with a concern: the top dimension's leading group, who agrees with it, and a finding to start from."""
    groups = group_catalogue(risk.sparkSession)
    leading = groups.groupBy(F.col("dimension").alias("top_risk_dimension")).agg(
        F.min_by(F.struct("group_id", "detectors", "description"), "group_position").alias("_group")
    )
    top = (
        risk.filter(F.col("top_risk_dimension") != "None")
        .select("entity_id", "top_risk_dimension")
        .join(F.broadcast(leading), "top_risk_dimension")
        .select("entity_id", "top_risk_dimension", "_group.*")
    )
    member = F.array_contains(F.col("detectors"), F.col("detector_id"))
    same_group = F.col("corroboration_group") == F.col("group_id")
    same_dimension = F.col("dimension") == F.col("top_risk_dimension")
    ordered = F.struct("dimension", "id")
    chosen = F.struct(
        F.when(same_group & same_dimension, 0).when(same_dimension, 1).otherwise(2).alias("preference"),
        F.col("dimension"), F.col("id"),
    )
    picked = (
        contributions.select("entity_id", "id", "dimension", "detector_id", "source_phase", "corroboration_group")
        .join(top, "entity_id")
        .groupBy("entity_id", "top_risk_dimension", "group_id", "description")
        .agg(
            F.array_sort(F.collect_set(F.when(member, F.col("source_phase")))).alias("phases"),
            F.array_sort(F.collect_set(F.when(member, F.col("detector_id")))).alias("detectors"),
            F.min_by("corroboration_group", chosen).alias("top_group"),
            F.min_by("corroboration_group", ordered).alias("first_group"),
        )
    )
    starts = links.groupBy("entity_id", F.col("group_id").alias("top_group")).agg(
        F.min_by("finding_id", F.struct("detector_position", "finding_id")).alias("primary_finding_id")
    )
    return picked.join(starts, ["entity_id", "top_group"], "left").select(
        "entity_id", "top_risk_dimension", F.col("group_id").alias("correlation_group"), "description", "phases",
        "detectors", "primary_finding_id",
    )


# --- review queue ---------------------------------------------------------------------------------------------


def queue_in_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy("rank")


def find_queue_item(queue: DataFrame, record_id: str) -> DataFrame:
    rows = queue.filter(F.col("record_id") == record_id)
    if rows.isEmpty():
        raise NotFound(f"Review queue item {record_id} not found")
    return rows


def queue_by_priority(queue: DataFrame) -> DataFrame:
    counts = queue.agg(*[F.count_if(F.col("priority") == name).alias(name) for name, _ in catalog.PRIORITY_LIMITS])
    return counts.unpivot([], [name for name, _ in catalog.PRIORITY_LIMITS], "priority", "items")


def search_queue(queue: DataFrame, *, priority: str = ALL, record_type: str = ALL, text: str = "") -> DataFrame:
    result = queue
    for name, value in (("priority", priority), ("record_type", record_type)):
        if value != ALL:
            result = result.filter(F.col(name) == value)
    if text.strip():
        result = result.filter(_matches(text, "record_id", "entity_id", "reason"))
    return result


def top_queue_item(queue: DataFrame) -> DataFrame:
    """The most urgent review item of each entity."""
    return queue.groupBy("entity_id").agg(
        F.min_by(F.struct("rank", "record_type", "record_id", "priority", "priority_score"), "rank").alias("_item")
    ).select("entity_id", "_item.*")


def queue_headings(queue: DataFrame) -> DataFrame:
    """Reason split at its first colon into category and title, ``X (ID)`` becoming ``X · ID``."""
    reason = F.col("reason")
    colon = F.instr(reason, ":")
    category = F.regexp_replace(F.trim(F.substring_index(reason, ":", 1)), r"^([^(]*?)\s*\(([^)]+)\)", "$1 · $2")
    return queue.select(
        "rank", "record_id",
        F.when(colon > 0, category).alias("category"),
        F.when(colon > 0, F.trim(F.substr(reason, colon + 1))).otherwise(reason).alias("title"),
    )


# --- dossiers -------------------------------------------------------------------------------------------------


def dossiers(
    risk: DataFrame, entities: DataFrame, contributions: DataFrame, queue: DataFrame, findings: DataFrame,
    evidence: DataFrame, as_of: str,
) -> DataFrame:
    """One examination dossier per entity, for all entities at once.

    Lists inside a dossier are short by construction (six dimensions, eight groups). The findings of an entity may
    be very many and stay rows: see ``dossier_inventory``.
    """
    inventory = findings.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.sum(F.when(F.col("rule_id").isin(*PEER_DETECTORS), F.col("population_size"))).alias("peer_rows"),
    )
    traced = evidence.groupBy("entity_id").agg(F.count(F.lit(1)).alias("evidence_rows"))
    item = F.struct(
        "dimension", "id", "source_phase", "detector_id", "signal_name", "normalized_value", "weight", "contribution",
        "severity", "corroboration_group",
    )
    parts = contributions.groupBy("entity_id").agg(F.array_sort(F.collect_list(item)).alias("risk_contributions"))
    urgent = top_queue_item(queue).select(
        "entity_id", F.col("rank").alias("review_queue_rank"), F.col("priority_score").alias("review_priority_score"),
        F.col("priority").alias("review_urgency"),
    )
    about = entities.select(
        "entity_id", "name", "sector", "size", "criticality", "total_assets", "expected_monitored_assets",
        F.col("alert_count").alias("total_alerts"), F.col("case_count").alias("total_cases"),
    )
    dimensions = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"), F.col(field).alias("score"), F.lit(weight).alias("weight"),
                F.coalesce(round_half_even(F.col(field) * weight), F.lit(0.0)).alias("weighted_contribution"),
                F.col(field).isNotNull().alias("is_assessable"),
                F.when(F.col(field).isNotNull(), "Assessable")
                .otherwise("Not Assessable (Missing Telemetry Denominator)")
                .alias("status"),
            )
            for name, field, weight, _ in catalog.DIMENSIONS
        ]
    )
    texts = catalog.DIRECTIVES
    directives = F.array_compact(
        F.array(
            F.when(F.col("risk_band").isin("HIGH", "CRITICAL"), texts["audit"]),
            F.when(F.col("escalation_score") >= 50, texts["escalation"]),
            F.when(F.col("investigation_score") >= 50, texts["investigation"]),
            F.when(F.col("monitoring_score") >= 30, texts["monitoring"]),
        )
    )
    gaps = F.transform(F.filter(F.col("dimensions"), lambda x: ~x["is_assessable"]), lambda x: x["dimension"])
    return (
        risk.join(about, "entity_id", "left")
        .join(parts, "entity_id", "left")
        .join(urgent, "entity_id", "left")
        .join(inventory, "entity_id", "left")
        .join(traced, "entity_id", "left")
        .withColumn("dimensions", dimensions)
        .select(
            F.concat(F.lit("SED-"), "entity_id", F.lit(f"-{as_of}")).alias("dossier_id"),
            "entity_id",
            F.concat(F.lit("Supervisory Examination Dossier — "), "entity_id").alias("title"),
            F.coalesce("name", "entity_id").alias("name"), "sector", "size", "criticality", "total_assets",
            "expected_monitored_assets", "total_alerts", "total_cases", "overall_score", "risk_band",
            "top_risk_dimension",
            (F.col("assessable_dimensions") == F.col("total_dimensions")).alias("is_fully_assessable"),
            gaps.alias("unassessable_dimensions"),
            "review_queue_rank", "review_priority_score",
            F.coalesce("review_urgency", F.lit("LOW")).alias("review_urgency"),
            "dimensions", "risk_contributions",
            F.when(F.size(directives) > 0, directives).otherwise(F.array(F.lit(texts["routine"]))).alias("directives"),
            F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
            (F.coalesce("evidence_rows", F.lit(0)) + F.coalesce("peer_rows", F.lit(0))).alias("evidence_count"),
        )
    )


def dossier_inventory(findings: DataFrame) -> DataFrame:
    """Findings listed in the dossiers, keyed by entity."""
    return findings.select(
        "entity_id", "id", "rule_id", "source_phase", "finding_type", "severity", "evidence_strength", "title",
        "summary", "rationale", "observed_value", "baseline_value", "gap_value",
    )
