"""The five canonical tables derived from the benchmark test tables (events, customer, nation).

The SQL text is a fixture specification shared with the oracle: it runs unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilframe import session

ENTITIES = """
select concat('CSE-', lpad(cast(u.user_id as string), 6, '0')) as id, c.c_name as name, c.c_mktsegment as sector,
 case when c.c_acctbal < 4500 then 'Small' else 'Large' end as size,
 case when n.n_regionkey < 3 then 'Medium' else 'High' end as criticality,
 cast('2020-01-01 00:00:00' as {timestamp}) as created_at
from (select distinct user_id from events) u join customer c on c.c_custkey = u.user_id join nation n on n.n_nationkey = c.c_nationkey
"""

ASSETS = """
select concat('AST-', lpad(cast(u.user_id as string), 6, '0'), '-', lpad(cast(s.slot as string), 2, '0')) as id,
 concat('CSE-', lpad(cast(u.user_id as string), 6, '0')) as entity_id,
 case s.slot % 3 when 0 then 'Server' when 1 then 'Database' else 'Endpoint' end as asset_type,
 case s.slot % 4 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' else 'Low' end as criticality,
 (s.slot % 5 <> 4) as expected_monitoring,
 case when s.slot % 5 <> 4 then 'EDR' end as monitoring_source
from (select user_id, {slots} as slot from (select distinct user_id from events) d) s
join (select distinct user_id from events) u on u.user_id = s.user_id
where s.slot < (case when u.user_id % 9 = 0 then 60 else 24 end)
"""

EVENT_STEP = """
select event_id, user_id, event_type, value, ts,
 event_id % 3 <> 0 as has_case, user_id % 5 = 0 as gap_entity,
 event_id % (case when user_id % 4 = 0 then 13 else 24 end) as slot,
 case when user_id % 11 = 0 and event_id % 6 = 5 and event_id % 24 <> 5 then 0 else event_id % 6 end as shift,
 cast(floor(value) as int) as ack_min
from events
"""

ALERTS = """
select concat('ALT-', lpad(cast(event_id as string), 9, '0')) as id,
 concat('CSE-', lpad(cast(user_id as string), 6, '0')) as entity_id,
 concat('AST-', lpad(cast(user_id as string), 6, '0'), '-', lpad(cast(slot as string), 2, '0')) as asset_id,
 t0 as timestamp,
 case event_type when 'error' then 'Critical' when 'purchase' then 'High' when 'signup' then 'Medium' else 'Low' end as severity,
 case when user_id % 7 = 0 and event_id % 5 = 4 then 'EDR' else case event_id % 5 when 0 then 'EDR' when 1 then 'Firewall' when 2 then 'IAM' when 3 then 'IDS' else 'Cloud Security' end end as source,
 case when has_case and event_id % 9 <> 1 then 'Closed' when event_id % 12 = 0 then 'Open' else 'Acknowledged' end as status,
 case when event_id % 12 = 0 then null else t0 + ack_min * interval '1' minute end as acknowledged_at,
 case when has_case and event_id % 9 <> 1 then t0 + (ack_min + 300) * interval '1' minute end as closed_at,
 case when has_case then concat('CASE-', lpad(cast(event_id as string), 9, '0')) end as case_id
from (select *, ts + shift * interval '30' day as t0 from ({event_step}) ev) ev2
"""

CASES = """
select concat('CASE-', lpad(cast(event_id as string), 9, '0')) as id,
 concat('CSE-', lpad(cast(user_id as string), 6, '0')) as entity_id,
 concat('ALT-', lpad(cast(event_id as string), 9, '0')) as alert_id,
 t0 + (ack_min + 5) * interval '1' minute as opened_at,
 case when event_id % 4 = 0 then 'Reviewed endpoint activity' when event_id % 4 = 1 then '' else 'Checked recent  alert history' end as investigation_text,
 case event_id % 4 when 0 then 'True Positive' when 1 then 'False Positive' when 2 then 'Benign' else 'Duplicate' end as disposition,
 (event_type in ('error','purchase') and event_id % 10 < (case when gap_entity then 3 else 7 end)) as escalated,
 (event_id % 100 < (case when gap_entity then 45 else 80 end)) as remediation_recorded,
 case when event_id % 9 <> 1 then t0 + (ack_min + 5 + case when gap_entity then 4 + event_id % 14 else 20 + event_id % 100 end) * interval '1' minute end as closed_at
from (select *, ts + shift * interval '30' day as t0 from ({event_step}) ev) ev2 where has_case
"""

ESCALATIONS = """
select concat('ESC-', right(id, 9)) as id, entity_id, id as case_id, opened_at + interval '2' minute as created_at, 'Management' as escalation_type
from ({cases}) c where escalated
"""


# Faulty variants of the tables for the validation queries, planted by row number.
_NUMBER = "cast(right(id, 9) as bigint)"
FAULTS = {
    "bad_entities": "select id, name, sector, size, case when cast(right(id, 6) as bigint) % 50 = 7 then null else criticality end as criticality, created_at from entities",
    "bad_assets": "select id, case when cast(substr(id, 5, 6) as bigint) % 41 = 3 then 'CSE-999999' else entity_id end as entity_id, asset_type, criticality, expected_monitoring, monitoring_source from assets",
    "bad_alerts": f"""
select case when {_NUMBER} % 101 = 5 then 'ALT-000000000' else id end as id, entity_id,
 case when {_NUMBER} % 83 = 0 then 'AST-MISSING' else asset_id end as asset_id, timestamp,
 case when {_NUMBER} % 97 = 0 then null when {_NUMBER} % 71 = 0 then 'Severe' else severity end as severity, source,
 case when {_NUMBER} % 73 = 0 then 'Parked' else status end as status,
 case when {_NUMBER} % 79 = 0 then timestamp - interval '5' minute else acknowledged_at end as acknowledged_at,
 case when {_NUMBER} % 89 = 0 then timestamp - interval '1' minute else closed_at end as closed_at, case_id
from alerts
""",
    "bad_cases": f"""
select id, entity_id, case when {_NUMBER} % 67 = 0 then 'ALT-UNKNOWN' else alert_id end as alert_id,
 case when {_NUMBER} % 61 = 0 then opened_at - interval '90' day else opened_at end as opened_at, investigation_text,
 case when {_NUMBER} % 59 = 0 then 'Unsure' else disposition end as disposition, escalated, remediation_recorded,
 case when {_NUMBER} % 53 = 0 then opened_at - interval '1' minute else closed_at end as closed_at
from cases
""",
    "bad_escalations": f"""
select id, entity_id, case when {_NUMBER} % 47 = 0 then 'CASE-UNKNOWN' else case_id end as case_id,
 case when {_NUMBER} % 43 = 0 then created_at - interval '10' minute when {_NUMBER} % 37 = 0 then created_at + interval '900' minute else created_at end as created_at,
 escalation_type from escalations
""",
}
# A raw submission of cases: alias names, padded ids, ISO times, word flags, an unknown column and bad values.
RAW_CASES = """
select concat('  ', id, ' ') as case_id, entity_id, alert_id,
 case when {number} % 31 = 0 then 'not-a-date' when {number} % 29 = 0 then {day} else {opened} end as opened_at,
 investigation_text as investigation_notes, concat(disposition, ' ') as disposition,
 case {number} % 7 when 0 then 'maybe' when 1 then ' YES ' when 2 then 'f' when 3 then 'T' when 4 then '0' when 5 then 'No' end as escalated_flag,
 case when remediation_recorded then '1' else '0' end as remediation_recorded,
 {closed} as closed_at, 'shift lead' as analyst
from cases
"""


def raw_sql(dialect: str = "spark") -> dict[str, str]:
    """SQL of the raw submission for ``spark`` or ``duckdb``; it differs only in how a time is printed."""

    def text(column: str, spark_pattern: str, duckdb_pattern: str) -> str:
        if dialect == "spark":
            return f'date_format({column}, "{spark_pattern}")'
        return f"strftime({column}, '{duckdb_pattern}')"

    full = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "%Y-%m-%dT%H:%M:%S.%fZ")
    return {
        "raw_cases": RAW_CASES.format(
            number=_NUMBER, day=text("opened_at", "yyyy-MM-dd", "%Y-%m-%d"), opened=text("opened_at", *full),
            closed=text("closed_at", *full),
        )
    }


def canonical_sql(dialect: str = "spark") -> dict[str, str]:
    """SQL of each canonical table over the base tables, for ``spark`` or ``duckdb``."""
    spark = dialect == "spark"
    cases = CASES.format(event_step=EVENT_STEP)
    slots = "explode(sequence(0L, 59L))" if spark else "unnest(generate_series(0, 59))"
    return {
        "entities": ENTITIES.format(timestamp="timestamp_ntz" if spark else "timestamp"),
        "assets": ASSETS.format(slots=slots),
        "alerts": ALERTS.format(event_step=EVENT_STEP),
        "cases": cases,
        "escalations": ESCALATIONS.format(cases=cases),
    }


def canonical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy canonical tables over the Parquet files in ``sf_dir``."""
    session.configure(spark)
    base = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("events", "customer", "nation")}
    return {
        name: spark.sql(
            text.replace("from events", "from {events}")
            .replace("join customer c", "join {customer} c")
            .replace("join nation n", "join {nation} n"),
            **{key: frame for key, frame in base.items() if f" {key}" in text},
        )
        for name, text in canonical_sql("spark").items()
    }


def raw_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        name: spark.sql(text.replace("from cases", "from {cases}"), cases=tables["cases"])
        for name, text in raw_sql("spark").items()
    }


def faulty_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The canonical tables with planted faults, under their canonical names."""
    return {
        name: spark.sql(FAULTS[f"bad_{name}"].replace(f"from {name}", f"from {{{name}}}"), **{name: tables[name]})
        for name in tables
    }
