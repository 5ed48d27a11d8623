"""End-to-end jobs: ingest a submission, derive features, run the detector families, assess risk, commit digests.

Each job reads published tables and publishes its own, so a job can be repeated without the ones before it.
"""

from __future__ import annotations

import posixpath
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilframe import catalog, schemas, session
from vigilframe.operators import absence, features, forest, integrity, normalize, peers, validate
from vigilframe.operators.findings import Detection, finalize, order_evidence, order_findings, union_all
from vigilframe.plans import analysis
from vigilframe.sources import files

SCHEMA_VERSION = "1.0"
MANIFESTS = {
    "phase5": "rule_manifest.json", "phase6": "execution_gap_manifest.json",
    "phase7": "negative_space_manifest.json", "phase8": "peer_anomaly_manifest.json",
}


class ValidationFailed(ValueError):
    """A submission has errors; ``report`` and ``issues`` say which."""

    def __init__(self, report: DataFrame, issues: DataFrame, summary: str) -> None:
        super().__init__(summary)
        self.report, self.issues = report, issues


class Prepared(NamedTuple):
    bundle: dict[str, DataFrame]
    sources: dict[str, str]
    issues: DataFrame
    report: DataFrame


def prepare(spark: SparkSession, path: str, dataset: str | None = None) -> Prepared:
    """Read, normalise and validate a file or package.

    Every source is parsed once into a staged raw table, and normalised once into a staged canonical one, which all
    checks and the publishing read; rows and values that can't be converted are counted as it is written. The issue rows
    are staged too, the report is computed from them.
    """
    sources, known = files.discover(spark, path, dataset)
    bundle, counts = {}, {}
    for name, source in sources.items():
        try:
            raw = files.staged_table(spark, source)
        except files.ReadError as error:
            known.append(normalize.issue(name, "READ_ERROR", str(error)))
            continue
        bundle[name], counts[name], found = normalize.normalize_staged(raw, name, session.stage)
        known += found
    parts = [normalize.issue_frame(spark, known)]
    if bundle:
        parts.append(validate.bundle_issues(bundle))
    issues = session.stage(union_all(parts))
    return Prepared(bundle, sources, issues, validate.quality_report(issues, bundle, len(sources), counts))


def validate_submission(spark: SparkSession, path: str, dataset: str | None = None) -> Prepared:
    """Validation without writing anything."""
    return prepare(spark, path, dataset)


def ingest(spark: SparkSession, path: str, output_root: str, dataset: str | None = None) -> dict:
    """Validate a submission and publish its canonical tables under a new run directory."""
    prepared = prepare(spark, path, dataset)
    outcome = prepared.report.first()
    if outcome["status"] != "passed":
        raise ValidationFailed(prepared.report, prepared.issues, outcome["summary"])
    sources = [
        {"filename": row["filename"], "size": row["size"], "sha256": row["sha256"]}
        for row in _source_digests(spark, prepared.sources).collect()
    ]
    joined = "".join(item["sha256"] for item in sources)
    digest = spark.range(1).select(F.substring(F.sha2(F.lit(joined), 256), 1, 12)).first()[0]
    dataset_id = f"{files.utc_stamp()}-{digest}"

    def manifest(written: dict[str, files.Written]) -> dict:
        return {
            "dataset_id": dataset_id, "ingested_at": files.utc_now(), "source_files": sources,
            "row_counts": files.row_counts(written), "schema_version": SCHEMA_VERSION, "validation_status": "passed",
            "output_location": dataset_id,
        }

    return files.publish(spark, prepared.bundle, f"{output_root}/{dataset_id}", files.CANONICAL_MANIFEST, manifest)


def _source_digests(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Name, size and digest per source table, in table order."""
    parts = union_all(
        [
            files.file_digests(spark, [path]).select(
                F.lit(f"{place}/{posixpath.basename(path)}").alias("file"), F.col("filename").alias("part"), "size", "sha256"
            )
            for place, path in enumerate(sources.values())
        ]
    )
    sizes = parts.groupBy("file").agg(F.sum("size").alias("size"))
    named = F.substring_index("file", "/", -1).alias("filename")
    return integrity.table_digests(parts).join(sizes, "file").orderBy("file").select(named, "size", "sha256")


# --- features -------------------------------------------------------------------------------------------------


def generate_features(spark: SparkSession, input_dir: str, output_dir: str, dataset_id: str | None = None) -> dict:
    """Derive and publish the five feature tables.

    Case and asset features are written first, entity and month features are derived from the written ones.
    """
    tables = features.feature_tables(files.load_canonical(spark, input_dir), keep=session.stage)
    tables["entity_month_features"] = tables["entity_month_features"].orderBy("entity_id", "year", "month")

    def manifest(written: dict[str, files.Written]) -> dict:
        return {
            "dataset_id": dataset_id or posixpath.basename(input_dir), "source_dataset": input_dir,
            "schema_version": SCHEMA_VERSION, "generated_at": files.utc_now(),
            "row_counts": files.row_counts(written),
            "feature_counts": {name: len(table.kinds) for name, table in written.items()},
            "features": [
                {"table": name, "name": column, "type": kind, "nullable": table.nulls[column] > 0}
                for name, table in written.items() for column, kind in table.kinds.items()
            ],
            "table_columns": {name: list(table.kinds) for name, table in written.items()},
            "monthly_semantics": "Only entity-months with an alert or a case have a row; absent months are not filled.",
        }

    return files.publish(spark, tables, output_dir, files.FEATURE_MANIFEST, manifest)


# --- detectors ------------------------------------------------------------------------------------------------


def run_family(spark: SparkSession, phase: str, feature_dir: str, output_dir: str, dataset_id: str | None = None) -> dict:
    """Evaluate one detector family on published features and publish findings, evidence and manifest."""
    bundle = files.load_features(spark, feature_dir)
    found = analysis.stage_detection(analysis.FAMILIES[phase](bundle))
    detection = finalize(found)
    tables = {"findings": order_findings(detection.findings), "evidence": order_evidence(detection.evidence)}
    extra: dict[str, object] = {}
    if phase == "phase7":
        window = absence.observation_window(bundle).first()
        extra["observation_window"] = {
            "start": window["start"] and window["start"].isoformat(), "end": window["end"] and window["end"].isoformat(),
            "sufficient": window["sufficient"], "reason": window["reason"],
        }
    if phase == "phase8":
        profile = forest.column_profile(bundle["entity_features"]).filter("is_usable").orderBy("feature")
        extra["feature_list"] = [row["feature"] for row in profile.collect()]
        extra["cohort_definition"] = list(catalog.COHORT_COLUMNS)
        tables["peer_reference_values"] = peers.peer_reference_values(bundle["entity_features"]).orderBy("cohort_key", "metric_name", "entity_id")

    def manifest(written: dict[str, files.Written]) -> dict:
        return {
            "schema_version": SCHEMA_VERSION, "dataset_id": dataset_id or posixpath.basename(feature_dir),
            "generated_at": files.utc_now(), "detectors_evaluated": catalog.enabled(phase),
            "deferred_detectors": catalog.deferred(phase),
            "thresholds": {name: catalog.DETECTORS[name]["thresholds"] for name in catalog.enabled(phase)},
            "row_counts": files.row_counts(written), **extra,
        }

    return files.publish(spark, tables, output_dir, MANIFESTS[phase], manifest)


def load_upstream(
    spark: SparkSession, root: str, preferred: dict[str, str] | None = None
) -> tuple[DataFrame, Detection, dict[str, str]]:
    """Entity features plus findings and evidence of all phases; a phase that has not run counts as empty."""
    chosen = preferred or {}
    base = files.resolve_phase(spark, root, "phase4", chosen.get("phase4"))
    if base is None:
        raise FileNotFoundError(f"Cannot find entity_features.parquet in {root}")
    entities = spark.read.parquet(f"{base}/entity_features.parquet")
    found, traced, paths = [], [], {"phase4": base}
    for phase in catalog.PHASES:
        directory = files.resolve_phase(spark, root, phase, chosen.get(phase))
        paths[phase] = directory or "NOT_FOUND"
        if directory is None:
            continue
        found.append(files.read_findings(spark, directory).withColumn("source_phase", F.lit(phase)))
        traced.append(files.read_evidence(spark, directory))
    findings = union_all(found) if found else files.empty(spark, schemas.FINDINGS)
    evidence = union_all(traced) if traced else files.empty(spark, schemas.EVIDENCE)
    return entities, Detection(findings, evidence), paths


def run_risk(
    spark: SparkSession, root: str, output_dir: str, dataset_id: str | None = None,
    preferred: dict[str, str] | None = None,
) -> dict:
    """Assess risk from the published phases and publish risk, contributions, their findings and the review queue."""
    entities, detection, paths = load_upstream(spark, root, preferred)
    run = analysis.assess_risk(entities, detection.findings, detection.evidence, staged=True)
    counts = {row["source_phase"]: row["count"] for row in detection.findings.groupBy("source_phase").count().collect()}
    consumed = sorted(row["rule_id"] for row in detection.findings.select("rule_id").distinct().collect())
    tables = {
        "entity_risk": run.entity_risk.orderBy("entity_id"),
        "risk_contributions": run.contributions.orderBy("entity_id", "dimension", "id"),
        "contribution_findings": run.contribution_findings,
        "review_queue": run.review_queue().orderBy("rank"),
    }

    def manifest(written: dict[str, files.Written]) -> dict:
        return {
            "schema_version": SCHEMA_VERSION, "dataset_id": dataset_id or posixpath.basename(root),
            "generated_at": files.utc_now(), "input_paths": paths,
            "input_phase_counts": {phase: counts.get(phase, 0) for phase in catalog.PHASES},
            "dimensions": [name for name, *_ in catalog.DIMENSIONS],
            "dimension_weights": {name: weight for name, _, weight, _ in catalog.DIMENSIONS},
            "dimensions_config": [
                {"key": name, "field": field, "weight": weight, "description": text}
                for name, field, weight, text in catalog.DIMENSIONS
            ],
            "risk_band_thresholds": {name: [low, high] for name, low, high in catalog.RISK_BANDS},
            "priority_thresholds": dict(catalog.PRIORITY_LIMITS),
            "correlation_groups": {
                group: {"dimension": dimension, "detectors": list(detectors), "relevant_features": list(names), "description": text}
                for group, dimension, detectors, names, text in catalog.CORRELATION_GROUPS
            },
            "detectors_consumed": consumed, "detectors_excluded": catalog.DEFERRED_IN_RISK,
            "row_counts": files.row_counts(written),
        }

    return files.publish(spark, tables, output_dir, "supervisory_risk_manifest.json", manifest)


def read_risk_manifest(spark: SparkSession, directory: str) -> dict:
    """The risk manifest, with the built-in dimension metadata where an older one lacks it."""
    document = files.read_document(spark, f"{directory}/supervisory_risk_manifest.json")
    document.setdefault(
        "dimensions_config",
        [
            {"key": name, "field": field, "weight": weight, "description": text}
            for name, field, weight, text in catalog.DIMENSIONS
        ],
    )
    return document


# --- commitments ----------------------------------------------------------------------------------------------


def read_commitments(spark: SparkSession, path: str) -> DataFrame:
    """All batches that were appended to the commitment table."""
    if not files.exists(spark, path) or not commitment_batches(spark, path):
        return files.empty(spark, schemas.COMMITMENTS)
    batches = [f"{path}/{name}" for name in commitment_batches(spark, path)]
    return spark.read.schema(schemas.COMMITMENTS).parquet(*batches)


def commitment_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of batches that were written whole, in their order."""
    names = [name for name in files.list_names(spark, path) if name.startswith("batch-")] if files.exists(spark, path) else []
    return [name for name in names if files.exists(spark, f"{path}/{name}/_SUCCESS")]


def commit_records(
    spark: SparkSession, records: DataFrame, path: str, created_at: str, only_new: bool = False
) -> int:
    """Append new versions of the records to the commitment table and return how many were added.

    A batch is a numbered folder. Its number is claimed first, by a file that only one run can create, and versions are
    taken from the batches before it; a second run with the same number fails before it writes anything. A batch
    counts once it is written whole. A claim that its run could not keep is given back.
    """
    number = len(commitment_batches(spark, path))
    claim, batch = f"{path}/_claims/{number:09d}", f"{path}/batch-{number:09d}"
    if not files.create_exclusively(spark, claim):
        raise FileExistsError(f"Another run commits batch {number} of {path}; if it is gone, remove {claim}")
    try:
        if len(commitment_batches(spark, path)) != number:
            raise FileExistsError(f"Batch {number} of {path} was committed meanwhile")
        rows = session.stage(integrity.register(records, read_commitments(spark, path), created_at, only_new=only_new))
        rows.write.mode("overwrite").parquet(batch)
    except BaseException:
        if not files.exists(spark, f"{batch}/_SUCCESS"):
            files.remove(spark, claim)
        raise
    return rows.count()


def submission_files(spark: SparkSession, directory: str) -> DataFrame:
    """``file, part, sha256`` of every canonical file present in a published submission."""
    present = [name for name in catalog.SUBMISSION_FILES if files.exists(spark, f"{directory}/{name}")]
    digests = files.file_digests(spark, [f"{directory}/{name}" for name in present])
    name = F.coalesce(
        *[
            F.when(F.contains("path", F.lit(f"/{name}/")) | F.col("path").endswith(f"/{name}"), F.lit(name))
            for name in present
        ]
    )
    return digests.select(name.alias("file"), F.col("filename").alias("part"), "sha256")
