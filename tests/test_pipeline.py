import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import integrity, serving
from vigilframe.plans import pipeline
from vigilframe.sources import files, fixture_views


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    """A whole pipeline run from CSV and Parquet files to commitments."""
    root = tmp_path_factory.mktemp("run")
    package = root / "package"
    package.mkdir()
    tables = fixture_views.canonical_tables(spark, sf_dir)
    tables["entities"].toPandas().to_csv(package / "entities.csv", index=False)
    tables["escalations"].toPandas().to_csv(package / "escalations.csv", index=False)
    for name in ("assets", "alerts", "cases"):
        tables[name].write.parquet(str(package / f"{name}.parquet"))
    manifest = pipeline.ingest(spark, str(package), str(root / "canonical"))
    canonical = f"{root}/canonical/{manifest['dataset_id']}"
    features = pipeline.generate_features(spark, canonical, f"{root}/processed/phase4-features")
    for phase, directory in (("phase5", "phase5-findings"), ("phase6", "execution_gap"), ("phase7", "negative_space"), ("phase8", "peer_anomaly")):
        pipeline.run_family(spark, phase, f"{root}/processed/phase4-features", f"{root}/processed/{directory}")
    risk = pipeline.run_risk(spark, f"{root}/processed", f"{root}/processed/supervisory_risk")
    return dict(root=str(root), canonical=canonical, manifest=manifest, features=features, risk=risk)


def test_manifests(run):
    assert run["manifest"]["row_counts"] == {"entities": 15, "assets": 432, "alerts": 1000, "cases": 666, "escalations": 180}
    assert [item["filename"] for item in run["manifest"]["source_files"]] == ["entities.csv", "assets.parquet", "alerts.parquet", "cases.parquet", "escalations.csv"]
    assert run["features"]["row_counts"]["entity_features"] == 15
    nullable = {(item["table"], item["name"]): item["nullable"] for item in run["features"]["features"]}
    assert nullable[("alert_features", "case_id")] and not nullable[("alert_features", "id")]
    assert run["risk"]["row_counts"]["entity_risk"] == 15
    assert run["risk"]["input_phase_counts"]["phase5"] == 86 and "AN001" in run["risk"]["detectors_consumed"]


def test_outputs_are_never_replaced(spark, run):
    with pytest.raises(FileExistsError):
        pipeline.generate_features(spark, run["canonical"], f"{run['root']}/processed/phase4-features")
    assert not [name for name in files.list_names(spark, f"{run['root']}/processed") if name.startswith(".staging")]


def test_missing_phases_count_as_empty(spark, run, tmp_path):
    _, detection, paths = pipeline.load_upstream(spark, str(tmp_path), {"phase4": f"{run['root']}/processed/phase4-features"})
    assert detection.findings.count() == 0 and paths["phase7"] == "NOT_FOUND"
    with pytest.raises(FileNotFoundError):
        pipeline.load_upstream(spark, str(tmp_path))


def test_no_orphan_or_repeated_evidence(spark, run):
    _, detection, _ = pipeline.load_upstream(spark, f"{run['root']}/processed")
    findings, evidence = detection
    assert findings.select("id").distinct().count() == findings.count()
    assert evidence.select("id").distinct().count() == evidence.count()
    ids = findings.select(F.col("id").alias("finding_id"))
    assert evidence.join(ids, "finding_id", "left_anti").count() == 0


def test_lookups_and_searches(spark, run):
    entities, detection, _ = pipeline.load_upstream(spark, f"{run['root']}/processed")
    risk = spark.read.parquet(f"{run['root']}/processed/supervisory_risk/entity_risk.parquet")
    queue = spark.read.parquet(f"{run['root']}/processed/supervisory_risk/review_queue.parquet")
    first = detection.findings.first()
    detail = serving.find_finding(detection, first["id"])
    assert detail.findings.count() == 1 and detail.evidence.count() >= 2
    with pytest.raises(serving.NotFound):
        serving.find_finding(detection, "F-unknown")
    enriched = serving.enrich_entities(risk, entities)
    top = serving.search_entities(enriched).first()
    assert top["overall_score"] == risk.agg(F.max("overall_score")).first()[0]
    assert serving.search_entities(enriched, band=top["risk_band"], text=top["entity_id"].lower()).count() == 1
    assert serving.find_entity(enriched, top["entity_id"]).count() == 1
    head = serving.queue_in_order(queue).first()
    assert head["rank"] == 1 and serving.find_queue_item(queue, head["record_id"]).count() >= 1
    with pytest.raises(serving.NotFound):
        serving.find_queue_item(queue, "nothing")
    manifest = pipeline.read_risk_manifest(spark, f"{run['root']}/processed/supervisory_risk")
    assert serving.band_limits(manifest) == {"moderate": 25.0, "high": 50.0, "critical": 75.0}
    assert serving.dimension_config(spark, manifest).count() == 6
    assert serving.detector_catalogue(spark, "phase6").count() == 5


def test_finding_digest_is_the_digest_of_sorted_json(spark, run):
    _, detection, _ = pipeline.load_upstream(spark, f"{run['root']}/processed")
    rows = detection.findings.withColumn("digest", integrity.finding_digest()).limit(200).collect()
    for row in rows:
        document = {
            "entity_id": row["entity_id"], "expected_value": row["expected_value"], "finding_id": row["id"], "metric_name": str(row["metric_name"]),
            "observed_value": row["observed_value"], "rationale": row["rationale"], "rule_id": row["rule_id"], "severity": row["severity"],
        }
        text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert row["digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_tampering_is_detected(spark, run):
    _, detection, _ = pipeline.load_upstream(spark, f"{run['root']}/processed")
    path = f"{run['root']}/commitments"
    records = integrity.finding_records(detection.findings)
    total = detection.findings.count()
    assert pipeline.commit_records(spark, records, path, "2024-07-01 00:00:00") == total
    assert pipeline.commit_records(spark, records, path, "2024-07-02 00:00:00", only_new=True) == 0
    commitments = pipeline.read_commitments(spark, path)
    assert {row["status"] for row in integrity.verify(records, commitments).collect()} == {"VERIFIED"}
    target = detection.findings.agg(F.min("id")).first()[0]
    changed = detection.findings.withColumn("rationale", F.when(F.col("id") == target, "edited").otherwise(F.col("rationale")))
    statuses = {row["record_id"]: row["status"] for row in integrity.verify(integrity.finding_records(changed), commitments).collect()}
    assert [key for key, status in statuses.items() if status == "MISMATCH"] == [target]
    assert pipeline.commit_records(spark, integrity.finding_records(changed).filter(F.col("record_id") == target), path, "2024-07-03 00:00:00") == 1
    commitments = pipeline.read_commitments(spark, path)
    assert [row["version"] for row in integrity.history(commitments, target).collect()] == [2, 1]
    assert integrity.latest(commitments).count() == total
    unknown = records.limit(1).withColumn("record_id", F.lit("F-unknown"))
    assert integrity.verify(unknown, commitments).first()["status"] == "NOT_REGISTERED"
    assert integrity.verify(unknown, None).first()["status"] == "UNAVAILABLE"


def test_submission_digest(spark, run, tmp_path):
    digest = integrity.submission_digest(pipeline.submission_files(spark, run["canonical"])).first()
    again = integrity.submission_digest(pipeline.submission_files(spark, run["canonical"])).first()
    assert digest == again and digest["files"] == 6 and len(digest["manifest_hash"]) == 64
    single = tmp_path / "single"
    single.mkdir()
    listed = []
    for name in ("entities.parquet", "alerts.parquet", "manifest.json"):
        (single / name).write_bytes(name.encode())
        listed.append({"file": name, "sha256": hashlib.sha256(name.encode()).hexdigest()})
    row = integrity.submission_digest(pipeline.submission_files(spark, str(single))).first()
    assert row["content_hash"] == hashlib.sha256(json.dumps(listed, separators=(",", ":")).encode()).hexdigest()
    assert row["manifest_hash"] == listed[2]["sha256"]


