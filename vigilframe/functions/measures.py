"""Scalar measures shared by features, detectors and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vigilframe import catalog


def whole_minutes(end: Column, start: Column) -> Column:
    """Elapsed whole minutes, truncated towards zero; null when either side is null."""
    return F.timestamp_diff("MINUTE", start, end).cast("double")


def whole_days(end: Column, start: Column) -> Column:
    return F.timestamp_diff("DAY", start, end).cast("double")


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """Ratio as double; null unless the denominator is positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def lookup(values: dict[str, object], key: Column) -> Column:
    """Constant map lookup; null for unknown keys."""
    cases = [F.when(key == name, F.lit(value)) for name, value in values.items()]
    return F.coalesce(*cases)


def cohort_key() -> Column:
    """sector|size|criticality; null as soon as one part is null."""
    first, *rest = (F.col(name) for name in catalog.COHORT_COLUMNS)
    return F.concat(first, *[part for column in rest for part in (F.lit("|"), column)])


def finding_id(*parts: Column) -> Column:
    joined = F.concat_ws("|", *parts)
    return F.concat(F.lit("F-"), F.substring(F.sha2(joined, 256), 1, 16))


def evidence_id(finding: Column, source_type: Column, source_id: Column, field: Column) -> Column:
    joined = F.concat_ws("|", finding, source_type, source_id, field)
    return F.concat(F.lit("E-"), F.substring(F.sha2(joined, 256), 1, 16))


def relative_gap(expected: Column, observed: Column) -> Column:
    return F.when(expected != 0, (expected - observed) / F.abs(expected))


def gap_strength(population: Column, gap: Column) -> Column:
    """Evidence strength of an execution gap."""
    return (
        F.when((population >= 20) & (gap >= 0.25), "High")
        .when((population >= 10) | (gap >= 0.20), "Medium")
        .otherwise("Low")
    )


def absence_strength(population: Column, magnitude: Column, explicit: bool = True) -> Column:
    """Evidence strength of an absence; only an explicit expectation can be High."""
    high = (population >= 20) & (magnitude >= 0.25) & F.lit(explicit)
    return F.when(high, "High").when((population >= 5) & (magnitude >= 0.10), "Medium").otherwise("Low")


def peer_strength(peers: Column, magnitude: Column) -> Column:
    return (
        F.when((peers >= 4) & (magnitude >= 0.25), "High")
        .when((peers >= 2) & (magnitude >= 0.15), "Medium")
        .otherwise("Low")
    )


def material_deviation(metric: Column, observed: Column, median: Column) -> Column:
    """Whether a value differs materially from its peers' median; the test depends on the kind of metric."""
    rates = (
        "critical_escalation_rate", "remediation_rate", "rapid_closure_rate", "monitoring_coverage_rate",
        "repeat_alert_event_rate",
    )
    low = observed <= median * 0.5
    return (
        F.when(metric.isin(*rates), F.abs(observed - median) >= 0.15)
        .when(metric == "critical_median_investigation_minutes", (median > 0) & (low | (observed >= median * 1.5)))
        .when(metric.isin("alerts_per_asset", "cases_per_asset"), (median > 0) & (low | (observed >= median * 2.0)))
        .otherwise(F.lit(False))
    )


def risk_band(score: Column) -> Column:
    """Band whose closed range holds the score; scores between two ranges fall to CRITICAL or LOW."""
    def add(chain: Column | None, band: tuple[str, float, float]) -> Column:
        name, low, high = band
        test = score.between(low, high)
        return F.when(test, name) if chain is None else chain.when(test, name)

    chain = reduce(add, catalog.RISK_BANDS, None)
    return chain.when(score >= 75.0, "CRITICAL").otherwise("LOW")


def priority(score: Column) -> Column:
    (high, high_from), (medium, medium_from), (low, _) = catalog.PRIORITY_LIMITS
    return F.when(score >= high_from, high).when(score >= medium_from, medium).otherwise(low)


def assessment_strength(evidence_strength: Column, sample: Column) -> Column:
    return F.coalesce(
        F.when(evidence_strength.isin("High", "Medium", "Low"), evidence_strength),
        F.when(sample >= 10, F.lit("Medium")),
        F.lit("Low"),
    )
