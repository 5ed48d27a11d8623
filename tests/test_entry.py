import duckdb
import pytest

import __spark_entry__ as driver
from vigilframe.plans import queries

TABLES = ("events", "customer", "nation", "documents")
ROWS_ONLY = {"dossier", "submission_digest"}


def test_every_query_has_an_oracle_or_is_listed():
    assert set(queries.QUERIES) - set(driver.oracle_sql()) == ROWS_ONLY
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    row = driver.entry(spark).collect()
    assert [item["rule_id"] for item in row] == ["EG001"]


@pytest.mark.parametrize("name", [
    "canonical_alerts", "alert_features", "entity_features", "recent_alert_count", "validate_references", "rule_r003", "gap_eg003",
    "absence_ns003", "peer_findings_all", "benchmark_table", "anomaly_matrix", "anomaly_an001", "correlation_groups", "entity_risk", "review_queue", "why_flagged", "commitment_verify", "table_digests",
    "dossier_dimensions", "dossier_summary",
])
def test_query_equals_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    frame = driver.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted(repr(tuple(row)) for row in frame.select(*columns).collect())
    result = db.execute(driver.oracle_sql()[name])
    names = [item[0] for item in result.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    assert mine == sorted(repr(tuple(row[place] for place in places)) for row in result.fetchall())


def test_plans_have_no_cartesian_product(spark, sf_dir):
    for name in ("alert_features", "entity_features", "validate_references", "gap_findings_all", "absence_findings_all", "peer_findings_all", "signals"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan, name
