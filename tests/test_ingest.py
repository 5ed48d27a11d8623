import json
from datetime import datetime

import pytest
from support import values

from vigilframe import schemas
from vigilframe.operators import audit, normalize, validate
from vigilframe.plans import pipeline
from vigilframe.sources import files

START = datetime(2024, 1, 1)
ROWS = {
    "entities": [("E1", "n", "Energy", "Small", "High", START)],
    "assets": [("S1", "E1", "Server", "High", True, "EDR")],
    "alerts": [("A1", "E1", "S1", datetime(2024, 1, 1), "High", "EDR", "Closed", datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 5), "C1")],
    "cases": [("C1", "E1", "A1", datetime(2024, 1, 1, 2), "text", "Benign", True, True, datetime(2024, 1, 1, 4))],
    "escalations": [("X1", "E1", "C1", datetime(2024, 1, 1, 3), "Management")],
}


def _bundle(spark, **changed):
    return {name: spark.createDataFrame(changed.get(name, rows), schemas.CANONICAL[name]) for name, rows in ROWS.items()}


def _kinds(issues):
    return {(row["dataset"], row["field"], row["error_type"]) for row in issues.collect()}


def _change(name, place, value):
    row = list(ROWS[name][0])
    row[schemas.CANONICAL[name].names.index(place)] = value
    return [tuple(row)]


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,value\na,1\nb,2\n")
    (tmp_path / "t.json").write_text(json.dumps([{"id": "a", "value": 1}, {"id": "b", "value": 2}]))
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, value long").write.parquet(str(tmp_path / "t.parquet"))
    for suffix in ("csv", "json", "parquet"):
        assert [row[0] for row in values(files.read_table(spark, str(tmp_path / f"t.{suffix}")), "id")] == ["a", "b"]
    with pytest.raises(files.ReadError):
        files.read_table(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(files.ReadError):
        files.read_table(spark, str(tmp_path / "none.csv"))
    assert files.dataset_name("/x/alert.csv") == files.dataset_name("/x/alerts_data.csv") == "alerts"
    with pytest.raises(ValueError):
        files.dataset_name("/x/other.csv")


def test_csv_fields_may_span_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('id,text\na,"say ""hi"", now"\nb,x\n')
    (tmp_path / "broken.csv").write_text('id,text\na,"first\nsecond ""q"""\nb,x\n')
    assert values(files.read_table(spark, str(tmp_path / "plain.csv")), "id", "text") == [("a", 'say "hi", now'), ("b", "x")]
    assert values(files.read_table(spark, str(tmp_path / "broken.csv")), "id", "text") == [("a", 'first\nsecond "q"'), ("b", "x")]


def test_csv_rows_that_do_not_fit_the_header(spark, tmp_path):
    (tmp_path / "short.csv").write_text('id,text,more\na,"x, y"\nb,y,z\n')
    assert values(files.staged_table(spark, str(tmp_path / "short.csv")), "id", "text", "more") == [("a", "x, y", None), ("b", "y", "z")]
    for name, row in (("long", "a,x,z,surplus"), ("ending", "a,x,z,"), ("quoted", 'a,"x, ""y""\nw",z,"s,t"')):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"id,text,more\n{row}\nb,y,z\n")
        with pytest.raises(files.ReadError, match="more fields than the header"):
            files.staged_table(spark, str(path))
        with pytest.raises(Exception, match="more fields than the header"):
            files.read_table(spark, str(path)).select("id").collect()


def test_surplus_fields_fail_the_submission(spark, tmp_path):
    package = tmp_path / "package"
    package.mkdir()
    (package / "entities.csv").write_text("entity_id,entity_name,sector,size,criticality\nE1,n,Energy,Small,High,surplus\n")
    prepared = pipeline.validate_submission(spark, str(package))
    assert ("entities", None, "READ_ERROR") in _kinds(prepared.issues)
    assert prepared.report.first()["status"] == "failed"


def test_aliases_text_times_and_flags(spark):
    raw = spark.createDataFrame(
        [(" A1 ", "E1", "S1", "2024-01-02T03:04:05Z", " High", "EDR", "Open", "x"), ("A2", "E1", "S1", "not-a-date", "Low", "EDR", "Open", "x")],
        "alert_id string, entity_id string, asset_id string, detected_at string, severity_level string, source string, status string, extra string",
    )
    result = normalize.normalize(raw, "alerts")
    assert values(result.frame, "id", "timestamp", "severity") == [("A1", datetime(2024, 1, 2, 3, 4, 5), "High"), ("A2", None, "Low")]
    assert result.frame.schema.names == schemas.CANONICAL["alerts"].names
    found = {(row["field"], row["error_type"], row["severity"]) for row in result.issues.collect()}
    assert found == {
        ("extra", "UNKNOWN_COLUMN", "warning"), ("acknowledged_at", "MISSING_OPTIONAL_COLUMN", "warning"), ("closed_at", "MISSING_OPTIONAL_COLUMN", "warning"),
        ("case_id", "MISSING_OPTIONAL_COLUMN", "warning"), ("timestamp", "INVALID_TIMESTAMP", "error"),
    }
    cases = spark.createDataFrame([("C1", "yes", "0", "2024-01-02"), ("C2", "perhaps", "T", "2024-01-02 03:04:05.25")], "case_id string, escalated_flag string, remediation_recorded string, opened_at string")
    result = normalize.normalize(cases, "cases")
    assert values(result.frame, "id", "escalated", "remediation_recorded", "opened_at") == [
        ("C1", True, False, datetime(2024, 1, 2)), ("C2", None, True, datetime(2024, 1, 2, 3, 4, 5, 250000)),
    ]
    kinds = {row["error_type"] for row in result.issues.collect()}
    assert {"INVALID_BOOLEAN", "MISSING_REQUIRED_COLUMN"} <= kinds


def test_ambiguous_alias_and_duplicate_column(spark):
    raw = spark.createDataFrame([("a", "b", "n", "m")], ["entity_id", "id", "name", "sector"])
    assert "AMBIGUOUS_ALIAS" in {row["error_type"] for row in normalize.normalize(raw, "entities").issues.collect()}
    twice = raw.select("id", "name", "name")
    result = normalize.normalize(twice, "entities")
    assert "DUPLICATE_COLUMN" in {row["error_type"] for row in result.issues.collect()}
    assert values(result.frame, "id", "name") == [("b", "n")]


def test_clean_bundle_has_no_issue(spark):
    bundle = _bundle(spark)
    assert validate.bundle_issues(bundle).count() == 0
    assert audit.integrity_audit(bundle).filter("violations > 0").count() == 0
    audit.assert_integrity(bundle)


@pytest.mark.parametrize("name,column,value,expected", [
    ("alerts", "severity", "Severe", ("alerts", "severity", "INVALID_CATEGORY")),
    ("alerts", "severity", None, ("alerts", "severity", "REQUIRED_NULL")),
    ("assets", "entity_id", "E9", ("assets", "entity_id", "ORPHAN_ENTITY")),
    ("alerts", "asset_id", "S9", ("alerts", "asset_id", "ORPHAN_ASSET")),
    ("alerts", "acknowledged_at", datetime(2023, 1, 1), ("alerts", "acknowledged_at", "IMPOSSIBLE_TIMESTAMP")),
    ("cases", "alert_id", "A9", ("cases", "alert_id", "ORPHAN_ALERT")),
    ("cases", "opened_at", datetime(2023, 1, 1), ("cases", "opened_at", "IMPOSSIBLE_TIMESTAMP")),
    ("escalations", "case_id", "C9", ("escalations", "case_id", "ORPHAN_CASE")),
    ("escalations", "created_at", datetime(2025, 1, 1), ("escalations", "created_at", "IMPOSSIBLE_TIMESTAMP")),
])
def test_each_fault_is_reported(spark, name, column, value, expected):
    bundle = _bundle(spark, **{name: _change(name, column, value)})
    assert expected in _kinds(validate.bundle_issues(bundle))


def test_duplicates_mismatches_and_report(spark):
    two = [("E1", "n", "Energy", "Small", "High", START), ("E2", "n", "Energy", "Small", "High", START), ("E2", "m", "Energy", "Small", "High", START)]
    bundle = _bundle(spark, entities=two, assets=_change("assets", "entity_id", "E2"))
    issues = validate.bundle_issues(bundle)
    assert {("entities", "id", "DUPLICATE_ID"), ("alerts", "asset_id", "ENTITY_MISMATCH")} <= _kinds(issues)
    report = validate.quality_report(issues, bundle, 5)
    row = report.first()
    assert (row["status"], row["errors"], row["rows"]["entities"]) == ("failed", 2, 3)
    assert row["summary"] == "Validation failed: 2 error(s), 0 warning(s), 7 row(s) across 5 file(s)."
    lines = [line["line"] for line in validate.report_lines(report, issues).orderBy("block", "line").collect()]
    assert "- entities: 3 rows" in lines and "- ERROR [entities id] 1 duplicate entities ID value(s)" in lines
    with pytest.raises(ValueError, match="duplicate_id"):
        audit.assert_integrity(bundle)


def test_package_with_missing_table_fails(spark, tmp_path):
    package = tmp_path / "package"
    package.mkdir()
    (package / "entities.csv").write_text("entity_id,entity_name,sector,size,criticality\nE1,n,Energy,Small,High\n")
    prepared = pipeline.validate_submission(spark, str(package))
    kinds = _kinds(prepared.issues)
    assert ("alerts", None, "MISSING_REQUIRED_TABLE") in kinds
    assert prepared.report.first()["status"] == "failed"
    with pytest.raises(pipeline.ValidationFailed):
        pipeline.ingest(spark, str(package), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert ("input", None, "UNREADABLE_FILE") in _kinds(pipeline.validate_submission(spark, str(tmp_path / "nowhere")).issues)
