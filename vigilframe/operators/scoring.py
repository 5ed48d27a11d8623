"""Dimension scores, overall entity risk and the ranked manual-review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe import catalog
from vigilframe.functions.measures import priority, risk_band
from vigilframe.functions.text import number_text, render, round_half_even
from vigilframe.operators.findings import first_rows, union_all
from vigilframe.operators.ordering import global_rank

COUNT_COLUMNS = (
    "closed_case_count", "case_count", "alert_count", "total_assets", "expected_monitored_assets",
    "critical_case_count",
)
QUEUE_FINDING_IDS = 10


def _none(*names: str) -> Column:
    """True when all the named entity counts are zero or missing."""
    test = F.lit(True)
    for name in names:
        test = test & (F.coalesce(F.col(name), F.lit(0)) == 0)
    return test


def unassessable() -> dict[str, Column]:
    """Per dimension, whether the entity has no data to assess it by."""
    return {
        "Escalation": _none("critical_case_count", "case_count", "alert_count"),
        "Investigation": _none("closed_case_count", "case_count"),
        "Remediation": _none("total_assets", "expected_monitored_assets"),
        "Monitoring": _none("total_assets", "expected_monitored_assets"),
        "Operational Discipline": _none("alert_count", "case_count"),
        "Cyber Resilience": F.lit(False),
    }


def dimension_scores(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Six scores per entity: the strongest group plus a fifth of the others, null where not assessable.

    At most three groups belong to one dimension, so the value lists stay tiny.
    """
    finals = groups.groupBy("entity_id").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("dimension") == name, F.col("final_value"))), asc=False).alias(field)
            for name, field, _, _ in catalog.DIMENSIONS
        ]
    )
    missing = unassessable()

    def score(name: str, field: str) -> Column:
        values = F.col(f"_finals.{field}")
        rest = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.lit(0.0), lambda acc, item: acc + item)
        combined = F.least(F.lit(100.0), F.element_at(values, 1) + F.lit(0.20) * rest)
        return (
            F.when(missing[name], F.lit(None).cast("double"))
            .when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(0.0))
            .when(F.size(values) == 1, round_half_even(F.element_at(values, 1)))
            .otherwise(round_half_even(combined))
            .alias(field)
        )

    nested = finals.select("entity_id", F.struct(*[field for _, field, _, _ in catalog.DIMENSIONS]).alias("_finals"))
    return entities.select("entity_id", *COUNT_COLUMNS).join(nested, "entity_id", "left").select(
        "entity_id", *[score(name, field) for name, field, _, _ in catalog.DIMENSIONS]
    )


def finding_profile(findings: DataFrame) -> DataFrame:
    """Per entity: number of findings, evidence-strength histogram text, and which systemic phases occur."""
    counted = findings.groupBy(
        "entity_id", F.coalesce("evidence_strength", F.lit("Unannotated")).alias("strength")
    ).agg(
        F.count(F.lit(1)).alias("findings"),
        F.bool_or(F.col("source_phase") == "phase6").alias("gap"),
        F.bool_or(F.col("source_phase") == "phase7").alias("blindspot"),
    )
    entry = F.concat_ws(": ", "strength", F.col("findings").cast("string"))
    return counted.groupBy("entity_id").agg(
        F.sum("findings").alias("supporting_finding_count"),
        F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("evidence_strength_summary"),
        F.bool_or("gap").alias("has_execution_gap"),
        F.bool_or("blindspot").alias("has_negative_space"),
    )


def assess_entities(entities: DataFrame, findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Overall risk per entity, with the flags the review queue needs."""
    scores = dimension_scores(entities, groups)
    group = F.struct(
        "group_position", "group_id", "dimension", "final_value", "corroboration_level", "participating_detectors"
    )
    group_lists = groups.groupBy("entity_id").agg(F.array_sort(F.collect_list(group)).alias("_groups"))
    joined = (
        scores.join(group_lists, "entity_id", "left")
        .join(finding_profile(findings), "entity_id", "left")
        .withColumn(
            "_groups",
            F.coalesce("_groups", F.array().cast(group_lists.schema["_groups"].dataType)),
        )
    )
    weighted, weights, assessable = F.lit(0.0), F.lit(0.0), F.lit(0)
    for _, field, weight, _ in catalog.DIMENSIONS:
        present = F.col(field).isNotNull()
        weighted = weighted + F.when(present, F.lit(weight) * F.col(field)).otherwise(0.0)
        weights = weights + F.when(present, F.lit(weight)).otherwise(0.0)
        assessable = assessable + present.cast("int")
    overall = F.when(
        weights > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), round_half_even(weighted / weights)))
    ).otherwise(0.0)
    # The first dimension in the fixed order wins a tie.
    ranked = F.array_max(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(field).isNotNull(),
                        F.struct(F.col(field).alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")),
                    )
                    for place, (name, field, _, _) in enumerate(catalog.DIMENSIONS)
                ]
            )
        )
    )
    driving = F.array_max(
        F.transform(
            F.filter("_groups", lambda item: item["dimension"] == F.col("_top.name")),
            lambda item: F.struct(
                item["final_value"].alias("final"), (-item["group_position"]).alias("place"),
                item["group_id"].alias("group"), item["corroboration_level"].alias("level"),
                F.array_join(item["participating_detectors"], ", ").alias("detectors"),
            ),
        )
    )
    levels = F.transform("_groups", lambda item: item["corroboration_level"])
    corroborated = F.transform(
        F.filter("_groups", lambda item: item["corroboration_level"].isin("Moderate", "Strong")),
        lambda item: F.concat(item["group_id"], F.lit(" ("), item["corroboration_level"], F.lit(")")),
    )
    concern = F.col("_top.score") > 0
    reason = render(
        catalog.TOP_REASON, dimension=F.col("_top.name"), group=F.col("_driver.group"), final=F.col("_driver.final"),
        level=F.col("_driver.level"), detectors=F.col("_driver.detectors"),
    )
    return (
        joined.withColumn("_top", ranked)
        .withColumn("_driver", driving)
        .withColumn("overall_score", overall)
        .select(
            "entity_id",
            *[field for _, field, _, _ in catalog.DIMENSIONS],
            "overall_score",
            risk_band(F.col("overall_score")).alias("risk_band"),
            round_half_even(assessable / F.lit(float(len(catalog.DIMENSIONS)))).alias("assessment_coverage"),
            assessable.cast("long").alias("assessable_dimensions"),
            F.lit(len(catalog.DIMENSIONS)).cast("long").alias("total_dimensions"),
            F.coalesce("evidence_strength_summary", F.lit("No findings")).alias("evidence_strength_summary"),
            F.when(
                F.size(corroborated) > 0,
                F.concat(F.lit("Corroborated groups: "), F.array_join(corroborated, ", ")),
            )
            .otherwise("No multi-phase corroborated groups")
            .alias("corroboration_summary"),
            F.when(concern, F.col("_top.name")).otherwise("None").alias("top_risk_dimension"),
            F.when(concern, reason).otherwise(catalog.NO_REASON).alias("top_reason"),
            F.coalesce("supporting_finding_count", F.lit(0)).cast("long").alias("supporting_finding_count"),
            F.coalesce("has_execution_gap", F.lit(False)).alias("has_execution_gap"),
            F.coalesce("has_negative_space", F.lit(False)).alias("has_negative_space"),
            F.array_contains(levels, "Strong").alias("has_strong_corroboration"),
            F.array_contains(levels, "Moderate").alias("has_moderate_corroboration"),
        )
    )


ASSESSMENT_FLAGS = (
    "has_execution_gap", "has_negative_space", "has_strong_corroboration", "has_moderate_corroboration",
)


def entity_risk(assessment: DataFrame) -> DataFrame:
    return assessment.drop(*ASSESSMENT_FLAGS)


def queue_items(assessment: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unranked review items: one per entity with cause for concern, execution gap and silent-asset finding."""
    texts = catalog.QUEUE_REASONS
    summary = F.col("evidence_strength_summary")
    factor = F.when(F.contains(summary, F.lit("High")), 1.05).when(F.contains(summary, F.lit("Low")), 0.90).otherwise(1.0)
    gap = F.when(F.col("has_execution_gap"), 25.0).otherwise(0.0)
    blindspot = F.when(F.col("has_negative_space"), 15.0).otherwise(0.0)
    agreement = (
        F.when(F.col("has_strong_corroboration"), 15.0).when(F.col("has_moderate_corroboration"), 8.0).otherwise(0.0)
    )
    points = (F.col("overall_score") * 0.40 + gap + blindspot + agreement) * factor
    leading = (
        first_rows(
            findings.select("entity_id", "source_phase", "rule_id", "id"), ["entity_id"],
            ["source_phase", "rule_id", "id"], QUEUE_FINDING_IDS,
        )
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("source_phase", "rule_id", "id"))).alias("_ids"))
        .select("entity_id", F.transform("_ids", lambda item: item["id"]).alias("supporting_finding_ids"))
    )
    entity_rows = (
        assessment.filter((F.col("supporting_finding_count") > 0) | (F.col("overall_score") != 0))
        .join(leading, "entity_id", "left")
        .select(
            "entity_id",
            F.lit("ENTITY").alias("record_type"),
            F.col("entity_id").alias("record_id"),
            F.least(F.lit(100.0), F.greatest(F.lit(0.0), round_half_even(points))).alias("priority_score"),
            render(
                texts["ENTITY"], entity_id=F.col("entity_id"), band=F.col("risk_band"), score=F.col("overall_score"),
                reason=F.col("top_reason"),
                gap=F.when(F.col("has_execution_gap"), texts["ENTITY_GAP"]).otherwise(""),
                blindspot=F.when(F.col("has_negative_space"), texts["ENTITY_BLINDSPOT"]).otherwise(""),
                corroboration=F.col("corroboration_summary"),
            ).alias("reason"),
            F.coalesce("supporting_finding_ids", F.array().cast("array<string>")).alias("supporting_finding_ids"),
            F.when(F.contains(summary, F.lit("High")), "High").otherwise("Medium").alias("evidence_strength"),
        )
    )
    assessed = findings.join(assessment.select("entity_id"), "entity_id", "left_semi")
    size = F.coalesce(F.col("gap_value"), F.lit(0.0))
    gap_rows = assessed.filter(F.col("source_phase") == "phase6").select(
        "entity_id",
        F.lit("FINDING").alias("record_type"),
        F.col("id").alias("record_id"),
        F.least(F.lit(100.0), round_half_even(F.lit(65.0) + F.abs(size) * 40.0)).alias("priority_score"),
        render(
            texts["FINDING"], rule=F.col("rule_id"), title=F.col("title"), gap=size,
            baseline=F.coalesce(number_text(F.col("baseline_value")), F.lit("None")),
        ).alias("reason"),
        F.array("id").alias("supporting_finding_ids"),
        "evidence_strength",
    )
    first_asset = (
        evidence.filter(F.col("source_type") == "asset_feature")
        .groupBy("finding_id")
        .agg(F.min("source_id").alias("asset_id"))
    )
    silent = assessed.filter(F.col("rule_id").isin("NS001", "NS002"))
    asset_rows = silent.join(first_asset, silent["id"] == first_asset["finding_id"], "left").select(
        "entity_id",
        F.lit("ASSET").alias("record_type"),
        F.coalesce("asset_id", "id").alias("record_id"),
        F.when(F.col("rule_id") == "NS002", 80.0).otherwise(65.0).alias("priority_score"),
        render(texts["ASSET"], rule=F.col("rule_id"), title=F.col("title")).alias("reason"),
        F.array("id").alias("supporting_finding_ids"),
        "evidence_strength",
    )
    items = union_all([entity_rows, gap_rows, asset_rows])
    return items.withColumn("priority", priority(F.col("priority_score")))


QUEUE_COLUMNS = (
    "rank", "entity_id", "record_type", "record_id", "priority", "priority_score", "reason",
    "supporting_finding_ids", "evidence_strength",
)


def review_queue(assessment: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """All review items with their global rank, highest priority first."""
    order = [F.col("priority_score").desc(), F.col("entity_id"), F.col("record_type"), F.col("record_id")]
    return global_rank(queue_items(assessment, findings, evidence), order).select(*QUEUE_COLUMNS)
