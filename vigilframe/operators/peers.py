"""Structural cohorts, peer benchmarks and peer-deviation detectors PB001-PB004."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe import catalog
from vigilframe.functions.measures import cohort_key, material_deviation, peer_strength
from vigilframe.operators.findings import Detection, EvidenceItem, identify, make_evidence, make_findings
from vigilframe.operators.ordering import midpoint, nearest_rank, order_statistics

MIN_COHORT_SIZE = 3
PEER_DETECTORS = tuple(name for name in catalog.enabled("phase8") if name.startswith("PB"))


def with_cohort(entities: DataFrame) -> DataFrame:
    return entities.withColumn("cohort_key", cohort_key())


def cohorts(entities: DataFrame, minimum: int = MIN_COHORT_SIZE) -> DataFrame:
    """Cohorts of at least ``minimum`` entities with their size. Members are rows of ``cohort_members``."""
    return (
        with_cohort(entities)
        .groupBy("cohort_key", *catalog.COHORT_COLUMNS)
        .agg(F.count(F.lit(1)).alias("entity_count"))
        .filter((F.col("entity_count") >= minimum) & F.col("cohort_key").isNotNull())
    )


def cohort_members(entities: DataFrame, minimum: int = MIN_COHORT_SIZE) -> DataFrame:
    """One row per member of every cohort large enough, instead of one list per cohort."""
    sizes = cohorts(entities, minimum).select("cohort_key")
    return with_cohort(entities).select("cohort_key", "entity_id").join(sizes, "cohort_key", "left_semi")


def metric_values(entities: DataFrame, metrics: tuple[str, ...], *keep: str) -> DataFrame:
    """Long form: one row per entity and metric with a value, next to the cohort and the columns in ``keep``."""
    present = [name for name in metrics if name in entities.columns]
    typed = with_cohort(entities).select(
        "entity_id", "cohort_key", *keep, *[F.col(name).cast("double").alias(name) for name in present]
    )
    return typed.unpivot(["entity_id", "cohort_key", *keep], present, "metric_name", "value").filter(
        F.col("value").isNotNull() & F.col("cohort_key").isNotNull()
    )


def benchmark_table(
    entities: DataFrame, metrics: tuple[str, ...] = catalog.BENCHMARK_METRICS, minimum: int = MIN_COHORT_SIZE
) -> DataFrame:
    """Count, median, mean, population deviation and nearest-rank quartiles per cohort and metric."""
    values = metric_values(entities, metrics)
    keys = ["cohort_key", "metric_name"]
    moments = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("peer_count"),
        F.avg("value").alias("peer_mean"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("peer_std"),
    )
    positions = order_statistics(
        values, keys, "value",
        lambda n: {
            "_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1, "peer_p25": nearest_rank(n, 0.25),
            "peer_p75": nearest_rank(n, 0.75),
        },
    )
    return (
        moments.filter(F.col("peer_count") >= minimum)
        .join(positions, keys)
        .select(
            *keys, "peer_count", midpoint(F.col("_low"), F.col("_high")).alias("peer_median"), "peer_mean", "peer_std",
            "peer_p25", "peer_p75",
        )
    )


def leave_one_out_medians(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Add ``peer_count`` and ``peer_median``: the median of the other values in the same group.

    Taking one value out moves the middle by at most one place, so three order statistics per group answer for
    every member; no member is paired with its peers. Groups of fewer than three values are dropped.
    """
    places = order_statistics(
        values, keys, value,
        lambda n: {
            "_first": F.floor(n / 2), "_second": F.floor(n / 2) + 1, "_third": F.floor(n / 2) + 2,
        },
    ).filter(F.col("n") >= MIN_COHORT_SIZE)
    x = F.col(value)

    def other(here: Column, after: Column) -> Column:
        return F.when(x > here, here).otherwise(after)

    low = other(F.col("_first"), F.col("_second"))
    high = F.when(F.col("n") % 2 == 0, low).otherwise(other(F.col("_second"), F.col("_third")))
    return (
        values.join(places, keys)
        .withColumn("peer_count", F.col("n") - 1)
        .withColumn("peer_median", midpoint(low, high))
        .drop("n", "_first", "_second", "_third")
    )


def peer_deviations(entities: DataFrame) -> DataFrame:
    """Materially deviating (entity, metric) pairs, one per finding of PB001-PB004."""
    definitions = {name: catalog.DETECTORS[name] for name in PEER_DETECTORS}
    populations = tuple(dict.fromkeys(item["population"][0] for item in definitions.values()))
    metrics = tuple(item["metric"] for item in definitions.values())
    compared = leave_one_out_medians(metric_values(entities, metrics, *populations), ["cohort_key", "metric_name"])
    metric = F.col("metric_name")
    enough = reduce(
        lambda left, right: left | right,
        [(metric == item["metric"]) & (F.col(item["population"][0]) >= item["population"][1]) for item in definitions.values()],
    )
    rule = F.coalesce(*[F.when(metric == item["metric"], F.lit(name)) for name, item in definitions.items()])
    return (
        compared.filter(enough & material_deviation(metric, F.col("value"), F.col("peer_median")))
        .withColumn("rule_id", rule)
        .withColumn("deviation", F.abs(F.col("value") - F.col("peer_median")))
    )


def peer_detection(entities: DataFrame, *rule_ids: str) -> Detection:
    """Findings of the peer detectors (all by default) with the entities' own evidence, in one pass.

    The peers behind a median are the other members of the cohort. Writing them out per finding would pair every
    deviating entity with every peer, so the evidence names the cohort and ``peer_reference_values`` holds each
    member's value once; ``peer_evidence`` joins the two for the findings somebody looks at.
    """
    deviations = peer_deviations(entities)
    if rule_ids:
        deviations = deviations.filter(F.col("rule_id").isin(*rule_ids))
    metric, observed, median = F.col("metric_name"), F.col("value"), F.col("peer_median")
    hits = identify(deviations, F.col("rule_id"), F.concat(F.col("cohort_key"), F.lit("|"), metric))
    deviation = F.col("deviation")
    magnitude = deviation / F.greatest(F.abs(median), F.lit(1e-9))
    # The four definitions share severity, type and texts; only the rule id differs.
    findings = make_findings(
        hits, PEER_DETECTORS[0], confidence=peer_strength(F.col("peer_count"), magnitude), text_key="PB",
        text={
            "metric": metric, "observed": observed, "median": median, "peers": F.col("peer_count"),
            "cohort": F.col("cohort_key"), "deviation": deviation,
        },
        rule_id=F.col("rule_id"), metric_name=metric, observed_value=observed, population_size=F.col("peer_count"),
        absolute_gap=deviation, baseline_method="peer_median", baseline_type="peer_reference", baseline_value=median,
        reference_value=median, gap_value=deviation, gap_direction="peer_deviation",
    )
    reason = catalog.EVIDENCE_REASONS["PB_entity"]
    evidence = make_evidence(
        hits,
        [
            EvidenceItem("entity_feature", F.col("entity_id"), metric, observed, "real", reason),
            EvidenceItem("entity_feature", F.col("entity_id"), "cohort_key", F.col("cohort_key"), "text", reason),
        ],
    )
    return Detection(findings, evidence)


def peer_reference_values(entities: DataFrame) -> DataFrame:
    """Each entity's value of each benchmarked peer metric, once: the rows the peer medians were taken over."""
    return metric_values(entities, tuple(catalog.DETECTORS[name]["metric"] for name in PEER_DETECTORS))


def peer_evidence(findings: DataFrame, evidence: DataFrame, reference: DataFrame) -> DataFrame:
    """Evidence rows of the peers behind the given peer findings.

    Meant for the findings under review: the result has one row per finding and peer.
    """
    chosen = findings.filter(F.col("rule_id").isin(*PEER_DETECTORS)).select(
        F.col("id").alias("finding_id"), "entity_id", "metric_name"
    )
    keys = evidence.filter(F.col("field") == "cohort_key").select("finding_id", F.col("value").alias("cohort_key"))
    peers = reference.select("cohort_key", "metric_name", F.col("entity_id").alias("peer_id"), "value")
    rows = (
        chosen.join(keys, "finding_id")
        .join(peers, ["cohort_key", "metric_name"])
        .filter(F.col("peer_id") != F.col("entity_id"))
    )
    return make_evidence(
        rows,
        [
            EvidenceItem(
                "entity_feature", F.col("peer_id"), F.col("metric_name"), F.col("value"), "real",
                catalog.EVIDENCE_REASONS["PB_peer"],
            )
        ],
    )


def entities_benchmarked(findings: DataFrame) -> DataFrame:
    """Number of distinct entities with a peer finding."""
    peers = findings.filter(F.col("rule_id").isin(*PEER_DETECTORS))
    return peers.agg(F.count_distinct("entity_id").alias("entities_benchmarked"))
