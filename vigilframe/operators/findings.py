"""Building, ordering and de-duplicating findings and their evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe import catalog, schemas
from vigilframe.functions.measures import evidence_id, finding_id
from vigilframe.functions.text import canonical_text, render


class Detection(NamedTuple):
    """What a detector emits."""

    findings: DataFrame
    evidence: DataFrame


class EvidenceItem(NamedTuple):
    """One evidence row per hit: where the value comes from, what it is, why it matters."""

    source_type: str
    source_id: Column
    field: Column | str
    value: Column
    kind: str
    reason: Column | str


def identify(hits: DataFrame, rule_id: Column | str, source_id: Column) -> DataFrame:
    """Add the deterministic finding id, a digest of rule, entity and source."""
    rule = rule_id if isinstance(rule_id, Column) else F.lit(rule_id)
    return hits.withColumn("finding_id", finding_id(rule, F.col("entity_id"), source_id))


def make_findings(
    hits: DataFrame, detector: str, /, *, confidence: Column | str, text: dict[str, Column], text_key: str | None = None,
    **values: Column | str | float,
) -> DataFrame:
    """Project hits to the full findings schema. ``values`` set metric and gap columns, the rest stay null."""
    definition = catalog.DETECTORS[detector]
    key = text_key or detector
    strength = confidence if isinstance(confidence, Column) else F.lit(confidence)
    columns: dict[str, Column | str | float] = {
        "id": F.col("finding_id"),
        "rule_id": detector,
        "entity_id": F.col("entity_id"),
        "finding_type": definition["finding_type"],
        "severity": definition["severity"],
        "confidence": strength,
        "evidence_strength": strength,
        "confidence_type": "evidence_strength",
        "title": render(catalog.TITLES[key], **text),
        "summary": render(catalog.SUMMARIES[key], **text),
        "rationale": render(catalog.RATIONALES[key], **text),
        "status": "OPEN",
        "created_at": F.lit("1970-01-01 00:00:00"),
        "source_phase": definition["phase"],
        **values,
    }

    def column(name: str) -> Column:
        value = columns.get(name)
        return value if isinstance(value, Column) else F.lit(value)

    return hits.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in schemas.FINDINGS])


def make_evidence(hits: DataFrame, items: Sequence[EvidenceItem]) -> DataFrame:
    """One evidence row per item and hit, in one pass over the hits."""

    def field_name(item: EvidenceItem) -> Column:
        return item.field if isinstance(item.field, Column) else F.lit(item.field)

    rows = F.array(
        *[
            F.struct(
                F.lit(item.source_type).alias("source_type"),
                item.source_id.cast("string").alias("source_id"),
                field_name(item).alias("field"),
                canonical_text(item.value, item.kind).alias("value"),
                (item.reason if isinstance(item.reason, Column) else F.lit(item.reason)).alias("reason"),
            )
            for item in items
        ]
    )
    exploded = hits.select("finding_id", "entity_id", F.inline(rows))
    return exploded.select(
        evidence_id(F.col("finding_id"), F.col("source_type"), F.col("source_id"), F.col("field")).alias("id"),
        *[name for name in schemas.EVIDENCE.names if name != "id"],
    )


def first_rows(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; Spark keeps only those per map task before it shuffles."""
    ranking = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(ranking)).filter(F.col("_row") <= limit).drop("_row")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def combine(detections: Sequence[Detection]) -> Detection:
    return Detection(
        union_all([item.findings for item in detections]), union_all([item.evidence for item in detections])
    )


def deduplicate(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id. Among rows that share an id the largest is kept, so the choice does not depend on order."""
    rest = [name for name in df.columns if name != key]
    merged = df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row"))
    return merged.select(*[F.col(key) if name == key else F.col(f"_row.{name}").alias(name) for name in df.columns])


def finalize(detection: Detection) -> Detection:
    """De-duplicate findings and evidence and drop evidence whose finding is gone.

    Published canonical tables have unique ids, so the ids made from them are unique too; tables that did not pass
    ingestion, or outputs put together from several runs, may repeat rows or leave evidence behind.
    """
    findings = deduplicate(detection.findings)
    evidence = deduplicate(detection.evidence).join(
        findings.select(F.col("id").alias("finding_id")), "finding_id", "left_semi"
    )
    return Detection(findings, evidence.select(*schemas.EVIDENCE.names))


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule_id", "entity_id", "id")


def order_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.orderBy("finding_id", "source_type", "source_id", "field", "id")
