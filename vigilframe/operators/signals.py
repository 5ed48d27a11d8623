"""From findings to bounded signals, correlation groups and auditable risk contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe import catalog
from vigilframe.functions.measures import assessment_strength, lookup
from vigilframe.functions.text import number_text, render, round_half_even

PREVALENCE_RULES = ("R001", "R002", "R003", "R004")
ENTITY_COUNTS = (
    "critical_closed_case_count", "closed_case_count", "critical_case_count", "total_assets", "case_count",
    "expected_monitored_assets", "critical_assets", "critical_alert_count", "alert_count",
)


def detector_summaries(findings: DataFrame) -> DataFrame:
    """Findings per (entity, detector): their number and the one with the smallest id as representative.

    The ids themselves stay rows of the findings table; an entity may have very many of them.
    """
    kept = (
        "source_phase", "severity", "evidence_strength", "title", "rationale", "observed_value", "population_size",
        "absolute_gap", "baseline_value", "reference_value", "gap_value", "anomaly_score", "anomaly_rank",
        "contributing_deviations",
    )
    return (
        findings.groupBy("entity_id", "rule_id")
        .agg(F.count(F.lit(1)).alias("finding_count"), F.min_by(F.struct(*kept), "id").alias("_first"))
        .select("entity_id", F.col("rule_id").alias("detector_id"), "finding_count", "_first.*")
    )


def signals(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """One bounded 0-100 signal per (entity, detector).

    Record-level rules count their findings against the entity's own population; entity-level detectors scale their
    gap or ratio; the anomaly signal is capped. A missing denominator or an unknown detector gives an explicit
    unassessable signal of zero.
    """
    counts = [F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name) for name in ENTITY_COUNTS]
    base = detector_summaries(findings).join(entities.select("entity_id", *counts), "entity_id")
    rule, count = F.col("detector_id"), F.col("finding_count")
    is_gap, is_peer = rule.startswith("EG"), rule.startswith("PB")
    known = rule.isin(*[name for phase in catalog.PHASES for name in catalog.enabled(phase)])

    denominator = (
        F.when(
            rule == "R001",
            F.when(F.col("critical_closed_case_count") != 0, F.col("critical_closed_case_count")).otherwise(
                F.col("closed_case_count")
            ),
        )
        .when(rule == "R002", F.col("critical_case_count"))
        .when(rule == "R003", F.col("total_assets"))
        .when(rule == "R004", F.col("case_count"))
        .when(rule == "R005", F.col("expected_monitored_assets"))
    )
    assessable = (
        known
        & (F.coalesce(denominator, F.lit(1)) != 0)
        & ((rule != "R005") | F.col("observed_value").isNotNull())
    )
    share = F.least(F.lit(1.0), count.cast("double") / F.nullif(denominator, F.lit(0)))

    observed = F.coalesce(F.col("observed_value"), F.lit(0.0))
    gap = F.coalesce(F.col("gap_value"), F.lit(0.0))
    stated = F.coalesce(F.col("baseline_value"), F.lit(1.0))
    baseline = F.when(stated > 0, stated).otherwise(1.0)
    divider = F.when(rule == "EG004", F.lit(catalog.RAPID_CLOSURE_SIGNAL_DIVIDER)).otherwise(baseline)
    ns_population = F.greatest(
        F.when(rule == "NS001", F.col("expected_monitored_assets"))
        .when(rule == "NS002", F.col("critical_assets"))
        .otherwise(F.col("critical_alert_count")),
        F.lit(1),
    )
    reference = F.greatest(F.abs(F.coalesce(F.col("reference_value"), F.lit(1.0))), F.lit(1e-6))
    absolute = F.coalesce(F.col("absolute_gap"), F.lit(0.0))

    deviations = F.coalesce(F.col("contributing_deviations"), F.array().cast("array<struct<feature:string,observed_value:double,reference_value:double,relative_deviation:double>>"))
    total = F.aggregate(deviations, F.lit(0.0), lambda acc, item: acc + item["relative_deviation"])
    mean_deviation = F.when(F.size(deviations) > 0, total / F.size(deviations)).otherwise(0.0)
    place = F.coalesce(F.col("anomaly_rank"), F.lit(1))
    anomaly = F.greatest(F.lit(5.0), F.lit(18.0) - (place - 1) * F.lit(4.0)) + F.least(
        F.lit(7.0), round_half_even(mean_deviation * 8.0)
    )

    unbounded = (
        F.when(rule == "R003", round_half_even(share * 300.0))
        .when(rule.isin("R001", "R002", "R004"), round_half_even(share * 100.0))
        .when(rule == "R005", round_half_even(F.col("observed_value") / F.nullif(denominator, F.lit(0)) * 100.0))
        .when(is_gap, round_half_even(gap / divider * 100.0))
        .when(rule.isin("NS001", "NS002", "NS005"), round_half_even(observed / ns_population * 100.0))
        .when(rule.isin("NS003", "NS004"), round_half_even(F.coalesce(F.col("gap_value"), F.lit(0.5)) * 100.0))
        .when(rule == "AN001", F.least(F.lit(catalog.ANOMALY_CEILING), round_half_even(anomaly)))
        .when(is_peer, round_half_even(absolute / reference * 60.0))
    )
    normalized = F.when(assessable, F.least(F.lit(100.0), unbounded)).otherwise(0.0)
    raw = (
        F.when(rule.isin(*PREVALENCE_RULES), count.cast("double"))
        .when(rule == "R005", F.col("observed_value"))
        .when(is_gap, gap)
        .when(rule.startswith("NS"), observed)
        .when(rule == "AN001", F.col("anomaly_score"))
        .when(is_peer, absolute)
        .otherwise(F.col("observed_value"))
    )
    is_rule = rule.startswith("R0")
    own_strength = F.when(~is_rule, F.col("evidence_strength"))
    sample = F.when(is_rule, denominator).otherwise(F.col("population_size"))
    texts = catalog.SIGNAL_RATIONALES
    values = {"count": count, "denominator": denominator, "norm": normalized}
    rationale = (
        F.when(~assessable, F.lit(""))
        .when(rule == "R001", render(texts["R001"], **values))
        .when(rule == "R002", render(texts["R002"], **values))
        .when(rule == "R003", render(texts["R003"], **values))
        .when(rule == "R004", render(texts["R004"], **values))
        .when(rule == "R005", render(texts["R005"], observed=number_text(F.col("observed_value")), **values))
        .when(is_gap, render(texts["EG"], gap=gap, baseline=baseline, rationale=F.col("rationale")))
        .when(rule == "AN001", render(texts["AN001"], rank=place, deviation=mean_deviation))
        .otherwise(F.col("rationale"))
    )
    reasons = catalog.UNASSESSABLE_REASONS
    reason = (
        F.when(assessable, F.lit(None).cast("string"))
        .when(~known, render(reasons["other"], rule=rule))
        .when((rule == "R005") & (denominator != 0), F.lit(reasons["R005_value"]))
        .otherwise(lookup({name: reasons[name] for name in (*PREVALENCE_RULES, "R005")}, rule))
    )
    return base.select(
        "entity_id",
        "detector_id",
        "source_phase",
        F.coalesce(lookup(catalog.SIGNAL_NAMES, rule), F.col("title")).alias("signal_name"),
        raw.alias("raw_value"),
        normalized.alias("normalized_value"),
        "severity",
        own_strength.alias("evidence_strength"),
        F.when(assessable, assessment_strength(own_strength, sample)).otherwise("Low").alias("assessment_strength"),
        "finding_count",
        F.when(rule == "AN001", F.transform(deviations, lambda item: item["feature"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("contributing_features"),
        rationale.alias("rationale"),
        assessable.alias("is_assessable"),
        reason.alias("unassessable_reason"),
    )


def group_config(spark) -> DataFrame:
    """Membership of detectors in correlation groups: a fixed table of 24 rows."""
    rows = [
        (group, place, dimension, detector, order, list(features), "*" in features)
        for place, (group, dimension, detectors, features, _) in enumerate(catalog.CORRELATION_GROUPS)
        for order, detector in enumerate(detectors)
    ]
    return spark.createDataFrame(
        rows,
        "group_id string, group_position int, dimension string, detector_id string, detector_position int, "
        "relevant_features array<string>, matches_any boolean",
    )


def active_members(signal_rows: DataFrame) -> DataFrame:
    """Signals that count in a group: assessable, positive, and for the anomaly signal on a feature of the group."""
    config = F.broadcast(group_config(signal_rows.sparkSession))
    on_topic = (
        (F.col("detector_id") != "AN001")
        | F.col("matches_any")
        | F.arrays_overlap("contributing_features", "relevant_features")
    )
    return signal_rows.filter(F.col("is_assessable") & (F.col("normalized_value") > 0)).join(
        config, "detector_id"
    ).filter(on_topic)


def _highest(column: str, ranks: dict[str, int]) -> Column:
    """Name of the highest rank in the group, null if none is known."""
    best = F.max(lookup(ranks, F.col(column)))
    return lookup({rank: name for name, rank in ranks.items()}, best)


def correlation_groups(signal_rows: DataFrame) -> DataFrame:
    """One row per (entity, group): strongest signal plus a bounded boost for other phases that agree.

    The lists hold at most six detectors and four phases.
    """
    members = active_members(signal_rows)
    member = F.struct("detector_position", "detector_id", "source_phase", "normalized_value")
    grouped = members.groupBy("entity_id", "group_id", "group_position", "dimension").agg(
        F.max("normalized_value").alias("base_value"),
        F.min_by("detector_id", F.struct(-F.col("normalized_value"), F.col("detector_position"))).alias("primary_detector"),
        F.array_sort(F.collect_set("source_phase")).alias("corroborating_phases"),
        F.array_sort(F.collect_list(member)).alias("_members"),
        _highest("severity", catalog.SEVERITY_RANK).alias("severity"),
        _highest("assessment_strength", catalog.STRENGTH_RANK).alias("assessment_strength"),
        _highest("evidence_strength", catalog.STRENGTH_RANK).alias("evidence_strength"),
        F.sum("finding_count").alias("supporting_finding_count"),
    )
    phases = F.size("corroborating_phases")
    boost = F.least(F.lit(catalog.MAX_BOOST), (phases - 1) * F.lit(catalog.BOOST_PER_PHASE))
    final = F.least(F.lit(100.0), round_half_even(F.col("base_value") * (F.lit(1.0) + F.col("corroboration_boost"))))
    details = F.array_join(
        F.transform(
            "_members",
            lambda item: render(
                catalog.GROUP_RATIONALE_DETAIL, detector=item["detector_id"], phase=item["source_phase"],
                norm=item["normalized_value"],
            ),
        ),
        "; ",
    )
    agreement = F.when(
        phases > 1,
        render(catalog.GROUP_RATIONALE_MANY, count=phases, phases=F.array_join("corroborating_phases", ", ")),
    ).otherwise(catalog.GROUP_RATIONALE_ONE)
    return (
        grouped.withColumn("corroboration_boost", boost)
        .withColumn("final_value", final)
        .withColumn(
            "corroboration_level",
            F.when(phases >= 3, "Strong").when(phases == 2, "Moderate").otherwise("Single Phase"),
        )
        .withColumn("participating_detectors", F.transform("_members", lambda item: item["detector_id"]))
        .withColumn(
            "rationale",
            render(
                catalog.GROUP_RATIONALE, group=F.col("group_id"), base=F.col("base_value"),
                primary=F.col("primary_detector"), phases=agreement, boost=F.col("corroboration_boost") * 100.0,
                final=F.col("final_value"), details=details,
            ),
        )
        .drop("_members")
    )


def supporting_findings(signal_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Link rows (entity, group, detector, finding) in place of one id list per contribution."""
    members = active_members(signal_rows).select("entity_id", "detector_id", "group_id", "detector_position")
    ids = findings.select("entity_id", F.col("rule_id").alias("detector_id"), F.col("id").alias("finding_id"))
    return ids.join(members, ["entity_id", "detector_id"]).select(
        "entity_id", "group_id", "detector_position", "detector_id", "finding_id"
    )


def risk_contributions(groups: DataFrame) -> DataFrame:
    """Weighted contribution of every correlation group to its entity's overall score."""
    weights = {name: weight for name, _, weight, _ in catalog.DIMENSIONS}
    weight, final = lookup(weights, F.col("dimension")), F.col("final_value")
    digest = F.sha2(
        render("{entity}:{group}:{dimension}:{final:.2f}", entity=F.col("entity_id"), group=F.col("group_id"),
               dimension=F.col("dimension"), final=final),
        256,
    )
    return groups.select(
        F.substring(digest, 1, 16).alias("id"),
        "entity_id",
        "dimension",
        F.element_at("corroborating_phases", 1).alias("source_phase"),
        F.element_at("participating_detectors", 1).alias("detector_id"),
        render("{group} ({level} Corroboration)", group=F.col("group_id"), level=F.col("corroboration_level")).alias(
            "signal_name"
        ),
        F.col("base_value").alias("raw_value"),
        final.alias("normalized_value"),
        weight.alias("weight"),
        round_half_even(final * weight).alias("contribution"),
        "severity",
        "evidence_strength",
        "assessment_strength",
        F.col("group_id").alias("corroboration_group"),
        "supporting_finding_count",
        "rationale",
    )
