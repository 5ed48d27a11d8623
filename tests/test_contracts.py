"""Run contract, texts of exported columns and digests that other tests do not reach."""

import hashlib
import math

import pytest
from support import values
from pyspark.sql import functions as F

from vigilframe import schemas
from vigilframe.operators import integrity, ordering, serving
from vigilframe.operators.findings import Detection, finalize
from vigilframe.plans import pipeline


def _rows(spark, schema, *rows):
    return spark.createDataFrame([tuple(row.get(name) for name in schema.names) for row in rows], schema)


def test_finalize_drops_repeats_and_orphans(spark):
    findings = _rows(spark, schemas.FINDINGS, {"id": "F-1", "title": "a"}, {"id": "F-1", "title": "b"}, {"id": "F-2", "title": "c"})
    evidence = _rows(
        spark, schemas.EVIDENCE, {"id": "E-1", "finding_id": "F-1", "value": "1"}, {"id": "E-1", "finding_id": "F-1", "value": "1"},
        {"id": "E-2", "finding_id": "F-9"}, {"id": "E-3", "finding_id": "F-2"},
    )
    done = finalize(Detection(findings, evidence))
    assert values(done.findings, "id", "title") == [("F-1", "b"), ("F-2", "c")]
    assert values(done.evidence, "id") == [("E-1",), ("E-3",)]
    assert done.findings.columns == findings.columns and done.evidence.columns == evidence.columns


def test_list_texts(spark):
    frame = spark.createDataFrame([('["F-1","F-2"]',), ("F-7",), ("other",), ("[broken",), (None,)], "value string")
    assert [row[0] for row in frame.select(serving.parse_finding_ids(F.col("value"))).collect()] == [["F-1", "F-2"], ["F-7"], [], [], []]
    text = '[{"feature":"x","observed_value":1.5,"reference_value":1,"relative_deviation":0.5}]'
    row = spark.createDataFrame([(text,)], "value string").select(serving.parse_deviations(F.col("value")).alias("d")).first()
    assert (row.d[0].feature, row.d[0].observed_value, row.d[0].relative_deviation) == ("x", 1.5, 0.5)


def test_band_labels(spark):
    frame = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("MODERATE",), ("LOW",), ("other",)], "band string")
    assert [row[0] for row in frame.select(serving.band_label(F.col("band"))).collect()] == [
        "Score \u2265 75.0", "Score 50.0\u201374.9", "Score 25.0\u201349.9", "Score 0.0\u201324.9", None]


def test_text_digest_and_submission_records(spark):
    row = spark.range(1).select(integrity.text_digest(F.lit("caf\u00e9")).alias("d")).first()
    assert row.d == hashlib.sha256("caf\u00e9".encode()).hexdigest()
    digest = spark.createDataFrame([("c", "m", 2)], "content_hash string, manifest_hash string, files long")
    record = integrity.submission_records(digest, "S-1", "E1", "2024-01").first()
    assert (record.record_id, record.record_type, record.content_hash, record.period) == ("S-1", "SUBMISSION", "c", "2024-01")


def test_submission_commitments_end_to_end(spark, tmp_path):
    def record(content):
        digest = spark.createDataFrame([(content, "m", 2)], "content_hash string, manifest_hash string, files long")
        return integrity.submission_records(digest, "S-1", "E1", "2024-01")

    path = str(tmp_path / "commitments")
    assert pipeline.read_commitments(spark, path).count() == 0
    assert pipeline.commit_records(spark, record("one"), path, "2024-07-01 00:00:00") == 1
    assert pipeline.commit_records(spark, record("one"), path, "2024-07-02 00:00:00", only_new=True) == 0
    assert pipeline.commit_records(spark, record("two"), path, "2024-07-03 00:00:00") == 1
    known = pipeline.read_commitments(spark, path)
    assert values(known, "version", "content_hash") == [(1, "one"), (2, "two")]
    assert integrity.verify(record("two"), known).first()["status"] == "VERIFIED"
    assert integrity.verify(record("one"), known).first()["status"] == "MISMATCH"


def test_order_statistics_of_infinite_values(spark):
    frame = spark.createDataFrame([(float(value),) for value in (-math.inf, -1, 0, 2, 5, math.inf, math.inf)], "value double")
    assert ordering.exact_medians(frame, [], "value").first()["median"] == pytest.approx(2.0)
