"""Strict integrity audit of the five canonical tables, stricter than ingestion validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe import catalog
from vigilframe.operators.findings import union_all

Bundle = dict[str, DataFrame]


def _counts(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check with its number of violations, from one aggregation over the frame."""
    totals = frame.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    return totals.unpivot([], list(checks), "check", "violations")


def _duplicate_ids(bundle: Bundle) -> DataFrame:
    parts = [
        bundle[name].select("id").agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("violations"))
        for name in catalog.DATASETS
    ]
    return union_all(parts).agg(F.sum("violations").alias("violations")).select(
        F.lit("duplicate_id").alias("check"), "violations"
    )


def _categories(bundle: Bundle, domains: dict[tuple[str, str], tuple[str, ...]]) -> DataFrame:
    parts = []
    for name in catalog.DATASETS:
        tests = [
            F.count_if(~F.coalesce(F.col(field).isin(*allowed), F.lit(False)))
            for (dataset, field), allowed in domains.items()
            if dataset == name
        ]
        if tests:
            total = tests[0]
            for test in tests[1:]:
                total = total + test
            parts.append(bundle[name].agg(total.alias("violations")))
    return union_all(parts).agg(F.sum("violations").alias("violations")).select(
        F.lit("invalid_category").alias("check"), "violations"
    )


def integrity_audit(bundle: Bundle, domains: dict[tuple[str, str], tuple[str, ...]] | None = None) -> DataFrame:
    """Violations per check; all zero for a sound data set."""
    entities = bundle["entities"].select(F.col("id").alias("entity_id")).distinct()
    assets = bundle["assets"].select(F.col("id").alias("asset_id"), F.col("entity_id").alias("owner"))
    alerts, cases, escalations = bundle["alerts"], bundle["cases"], bundle["escalations"]

    orphan_assets = (
        bundle["assets"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows")).join(entities, "entity_id", "left_anti")
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
        .select(F.lit("orphan_asset_entity").alias("check"), "violations")
    )
    known = entities.withColumn("is_known", F.lit(True))
    pairs = alerts.groupBy("asset_id", "entity_id").agg(F.count(F.lit(1)).alias("rows"))
    alert_owner = (
        pairs.join(assets, "asset_id", "left").join(known, "entity_id", "left")
        .filter(F.col("is_known").isNull() | ~F.equal_null("owner", "entity_id"))
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
        .select(F.lit("alert_relationship").alias("check"), "violations")
    )
    missing_cases = (
        alerts.filter(F.col("case_id").isNotNull()).select("case_id")
        .join(cases.select(F.col("id").alias("case_id")), "case_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit("alert_missing_case").alias("check"), "violations")
    )
    alert_times = _counts(
        alerts,
        {
            "alert_acknowledged_early": F.col("acknowledged_at") < F.col("timestamp"),
            "alert_closed_early": F.col("closed_at") < F.col("acknowledged_at"),
        },
    )
    behind = alerts.select(
        F.col("id").alias("alert_id"), F.col("entity_id").alias("owner"), F.col("case_id").alias("back_reference"),
        F.col("timestamp").alias("alerted"),
    )
    case_checks = _counts(
        cases.join(behind, "alert_id", "left"),
        {
            "case_relationship": ~F.equal_null("owner", "entity_id")
            | ~F.equal_null("back_reference", "id")
            | F.coalesce(F.col("opened_at") < F.col("alerted"), F.lit(False)),
            "case_closed_early": F.col("closed_at") < F.col("opened_at"),
        },
    )
    parents = cases.select(
        F.col("id").alias("case_id"), F.col("entity_id").alias("owner"), "opened_at", "closed_at", "escalated"
    )
    escalation_checks = _counts(
        escalations.join(parents, "case_id", "left"),
        {
            "escalation_relationship": ~F.equal_null("owner", "entity_id")
            | F.coalesce(F.col("created_at") < F.col("opened_at"), F.lit(False)),
            "escalation_lifecycle": ~F.coalesce("escalated", F.lit(False))
            | F.coalesce(F.col("created_at") > F.col("closed_at"), F.lit(False)),
        },
    )
    flagged = cases.filter(F.col("escalated")).select(F.col("id").alias("case_id")).distinct()
    recorded = escalations.select("case_id").distinct()
    set_difference = (
        flagged.exceptAll(recorded).unionByName(recorded.exceptAll(flagged))
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit("escalation_sets_differ").alias("check"), "violations")
    )
    return union_all(
        [
            _duplicate_ids(bundle), _categories(bundle, domains or catalog.AUDIT_DOMAINS), orphan_assets, alert_owner,
            missing_cases, alert_times, case_checks, escalation_checks, set_difference,
        ]
    )


def assert_integrity(bundle: Bundle, domains: dict[tuple[str, str], tuple[str, ...]] | None = None) -> None:
    """Raise with the failed checks; the audit result has a dozen rows."""
    failed = integrity_audit(bundle, domains).filter(F.col("violations") > 0).orderBy("check").collect()
    if failed:
        raise ValueError("Integrity violated: " + ", ".join(f"{row['check']} ({row['violations']})" for row in failed))
