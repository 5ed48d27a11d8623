"""Independent SQL for DuckDB: what every registered query must return on the same Parquet tables.

The statements are written the plain way (self joins, pairwise comparisons, one big window), not the way the
DataFrame operators work. Each query is a WITH chain over named steps, because only the base tables are views.
"""

from __future__ import annotations

import re
from string import Formatter

from vigilframe import catalog
from vigilframe.sources.fixture_views import FAULTS, canonical_sql, raw_sql

STEPS: dict[str, str] = {**canonical_sql("duckdb"), **raw_sql("duckdb")}


# --- text helpers ---------------------------------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(value: str, digits: int = 2) -> str:
    return f"cast(format('{{:.{digits}f}}', cast({value} as double)) as double)"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(value: str) -> str:
    return (
        f"(case when microsecond({value}) % 1000000 = 0 then strftime({value}, '%Y-%m-%dT%H:%M:%S') "
        f"else strftime({value}, '%Y-%m-%dT%H:%M:%S.%f') end)"
    )


def spaced(value: str) -> str:
    return iso(value).replace("dT%", "d %")


def flag(value: str) -> str:
    return f"case when {value} then 'True' when not ({value}) then 'False' end"


def fill(template: str, **values: str) -> str:
    """SQL expression for a message template."""
    parts = []
    for literal, name, spec, _ in Formatter().parse(template):
        if literal:
            parts.append(quote(literal))
        if name is None:
            continue
        value = values[name]
        if not spec:
            parts.append(f"cast({value} as varchar)")
        elif spec.endswith("%"):
            parts.append(f"format('{{:.{spec[1:-1]}f}}', cast({value} as double) * 100) || '%'")
        else:
            parts.append(f"format('{{:{spec}}}', cast({value} as double))")
    return "(" + " || ".join(parts) + ")"


def middle(values: str) -> str:
    """Interpolated median of a sorted list."""
    low, high = f"{values}[(len({values}) + 1) // 2]", f"{values}[len({values}) // 2 + 1]"
    return f"(({high} - {low}) * 0.5 + {low})"


def digest(prefix: str, *parts: str) -> str:
    return f"('{prefix}-' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 16))"


# --- features -------------------------------------------------------------------------------------------------

STEPS["recent"] = """
select a.id, count(*) as n from alerts a join alerts b
 on a.asset_id = b.asset_id and b.timestamp <= a.timestamp and b.timestamp >= a.timestamp - interval 30 day group by a.id
"""
STEPS["alert_f"] = """
select a.*, c.n as asset_alert_count, c.s as asset_distinct_alert_sources, coalesce(r.n, 0) as asset_recent_alert_count,
 cast(datesub('minute', a.timestamp, a.acknowledged_at) as double) as acknowledgement_minutes,
 cast(datesub('minute', a.timestamp, a.closed_at) as double) as alert_lifetime_minutes,
 a.case_id is not null as has_case, a.status = 'Closed' or a.closed_at is not null as is_closed,
 cast(case a.severity when 'Low' then 1 when 'Medium' then 2 when 'High' then 3 when 'Critical' then 4 end as bigint) as severity_rank,
 a.severity in ('High', 'Critical') as is_high_or_critical, a.severity = 'Critical' as is_critical
from alerts a
left join (select asset_id, count(*) as n, count(distinct source) as s from alerts group by asset_id) c on a.asset_id = c.asset_id
left join recent r on a.id = r.id
"""
STEPS["case_f"] = """
select c.*, cast(datesub('minute', c.opened_at, c.closed_at) as double) as investigation_minutes,
 cast(datesub('minute', c.opened_at, c.closed_at) as double) as case_age_at_close_minutes,
 c.closed_at is not null as is_closed,
 cast(datesub('minute', c.opened_at, e.first_at) as double) as escalation_delay_minutes,
 c.escalated as is_escalated, c.remediation_recorded as is_remediated,
 cast(length(coalesce(c.investigation_text, '')) as bigint) as investigation_text_length,
 cast(len(list_filter(string_split(coalesce(c.investigation_text, ''), ' '), lambda x : x <> '')) as bigint) as investigation_word_count,
 length(coalesce(c.investigation_text, '')) > 0 as has_investigation_text, a.severity
from cases c left join (select case_id, min(created_at) as first_at from escalations group by case_id) e on c.id = e.case_id
left join alerts a on a.id = c.alert_id
"""
STEPS["asset_f"] = """
select s.*, coalesce(x.n, 0) as alert_count, coalesce(x.c, 0) as case_count, x.last_alert_at,
 coalesce(x.n, 0) > 0 as has_alert_activity, coalesce(x.c, 0) > 0 as has_case_activity,
 s.expected_monitoring and coalesce(x.n, 0) = 0 as expected_monitoring_no_activity,
 cast(datesub('day', x.last_alert_at, (select max(timestamp) from alerts)) as double) as days_since_last_alert,
 case when sum(coalesce(x.n, 0)) over (partition by s.entity_id) > 0
  then cast(coalesce(x.n, 0) as double) / sum(coalesce(x.n, 0)) over (partition by s.entity_id) end as asset_alert_rate_relative_to_entity
from assets s left join (select asset_id, count(*) as n, count(case_id) as c, max(timestamp) as last_alert_at from alerts group by asset_id) x
 on x.asset_id = s.id
"""
STEPS["entity_a"] = """
select entity_id, count(*) as alert_count, count(case_id) as alerts_with_cases, count(*) filter (not is_closed) as open_alert_count,
 count(*) filter (is_closed) as closed_alert_count, count(*) filter (severity = 'Low') as low_alert_count,
 count(*) filter (severity = 'Medium') as medium_alert_count, count(*) filter (severity = 'High') as high_alert_count,
 count(*) filter (severity = 'Critical') as critical_alert_count, avg(cast(is_critical as int)) as critical_alert_rate,
 avg(cast(is_high_or_critical as int)) as high_critical_alert_rate, count(*) filter (asset_alert_count > 1) as repeat_alert_event_count
from alert_f group by entity_id
"""
STEPS["entity_c"] = """
select entity_id, count(*) as case_count, count(*) filter (is_closed) as closed_case_count,
 count(*) filter (is_escalated) as escalated_case_count, count(*) filter (not is_escalated) as non_escalated_case_count,
 count(*) filter (is_escalated and severity = 'Critical') as critical_escalated_case_count,
 count(*) filter (severity = 'Critical') as critical_case_count,
 count(*) filter (severity = 'Critical' and is_closed) as critical_closed_case_count,
 avg(investigation_minutes) filter (severity = 'Critical') as critical_mean_investigation_minutes,
 median(investigation_minutes) filter (severity = 'Critical') as critical_median_investigation_minutes,
 count(*) filter (is_remediated and is_closed) as remediated_case_count,
 count(*) filter (not is_remediated and is_closed) as non_remediated_case_count,
 avg(investigation_minutes) as mean_investigation_minutes, median(investigation_minutes) as median_investigation_minutes,
 count(*) filter (is_closed and investigation_minutes <= 10) as rapid_closure_count,
 count(*) filter (severity = 'Critical' and is_closed and investigation_minutes <= 10) as critical_rapid_closure_count
from case_f group by entity_id
"""
STEPS["entity_s"] = """
select entity_id, count(*) as total_assets, count(*) filter (expected_monitoring) as expected_monitored_assets,
 count(*) filter (has_alert_activity and expected_monitoring) as expected_monitored_assets_with_activity,
 count(*) filter (expected_monitoring and not has_alert_activity) as expected_monitored_assets_without_activity,
 count(*) filter (has_alert_activity) as assets_with_alert_activity,
 count(*) filter (criticality in ('High', 'Critical')) as critical_assets,
 count(*) filter (criticality in ('High', 'Critical') and has_alert_activity) as critical_assets_with_activity,
 count(*) filter (alert_count > 1) as repeat_alert_asset_count
from asset_f group by entity_id
"""
_COUNTS = (
    "alert_count alerts_with_cases open_alert_count closed_alert_count low_alert_count medium_alert_count high_alert_count "
    "critical_alert_count repeat_alert_event_count case_count closed_case_count escalated_case_count non_escalated_case_count "
    "critical_escalated_case_count critical_case_count critical_closed_case_count remediated_case_count "
    "non_remediated_case_count rapid_closure_count critical_rapid_closure_count total_assets expected_monitored_assets "
    "expected_monitored_assets_with_activity expected_monitored_assets_without_activity assets_with_alert_activity "
    "critical_assets critical_assets_with_activity repeat_alert_asset_count"
).split()
_RATES = {
    "case_rate": ("case_count", "alert_count"), "escalation_rate": ("escalated_case_count", "case_count"),
    "critical_escalation_rate": ("critical_escalated_case_count", "critical_case_count"),
    "critical_rapid_closure_rate": ("critical_rapid_closure_count", "critical_closed_case_count"),
    "remediation_rate": ("remediated_case_count", "closed_case_count"),
    "rapid_closure_rate": ("rapid_closure_count", "closed_case_count"),
    "repeat_alert_event_rate": ("repeat_alert_event_count", "alert_count"),
    "repeat_alert_asset_rate": ("repeat_alert_asset_count", "assets_with_alert_activity"),
    "cases_per_asset": ("case_count", "total_assets"), "alerts_per_asset": ("alert_count", "total_assets"),
    "monitoring_coverage_rate": ("expected_monitored_assets_with_activity", "expected_monitored_assets"),
    "critical_asset_activity_rate": ("critical_assets_with_activity", "critical_assets"),
}
STEPS["entity_j"] = (
    "select e.id as entity_id, e.name, e.sector, e.size, e.criticality, e.created_at, "
    + ", ".join(f"cast(coalesce({name}, 0) as bigint) as {name}" for name in _COUNTS)
    + ", critical_alert_rate, high_critical_alert_rate, critical_mean_investigation_minutes, "
    "critical_median_investigation_minutes, mean_investigation_minutes, median_investigation_minutes "
    "from entities e left join entity_a a on a.entity_id = e.id left join entity_c c on c.entity_id = e.id "
    "left join entity_s s on s.entity_id = e.id"
)
STEPS["entity_f"] = (
    "select *, "
    + ", ".join(f"case when {b} > 0 then cast({a} as double) / {b} end as {name}" for name, (a, b) in _RATES.items())
    + ", assets_with_alert_activity as distinct_active_assets from entity_j"
)
STEPS["month_a"] = """
select entity_id, cast(year(timestamp) as bigint) as year, cast(month(timestamp) as bigint) as month, count(*) as alert_count,
 count(*) filter (severity = 'Critical') as critical_alert_count from alerts group by all
"""
STEPS["month_c"] = """
select entity_id, cast(year(opened_at) as bigint) as year, cast(month(opened_at) as bigint) as month, count(*) as case_count,
 count(*) filter (is_escalated) as escalated_case_count, count(*) filter (is_closed) as investigated_case_count,
 count(*) filter (is_remediated) as remediated_case_count, avg(investigation_minutes) as mean_investigation_minutes,
 median(investigation_minutes) as median_investigation_minutes from case_f group by all
"""
STEPS["month_f"] = """
select entity_id, year, month, coalesce(alert_count, 0) as alert_count, coalesce(critical_alert_count, 0) as critical_alert_count,
 coalesce(case_count, 0) as case_count, coalesce(escalated_case_count, 0) as escalated_case_count,
 coalesce(investigated_case_count, 0) as investigated_case_count, coalesce(remediated_case_count, 0) as remediated_case_count,
 mean_investigation_minutes, median_investigation_minutes
from month_a full join month_c using (entity_id, year, month)
"""

# --- findings -------------------------------------------------------------------------------------------------

FINDING_COLUMNS = (
    "id", "rule_id", "entity_id", "finding_type", "severity", "confidence", "evidence_strength", "title", "summary",
    "rationale", "metric_name", "observed_value", "expected_value", "threshold", "population_size", "absolute_gap",
    "relative_gap", "baseline_method", "baseline_type", "baseline_value", "reference_value", "gap_value",
    "gap_direction", "source_phase",
)
EVIDENCE_COLUMNS = ("id", "finding_id", "source_type", "source_id", "entity_id", "field", "value", "reason")
_DOUBLES = (
    "observed_value", "expected_value", "threshold", "absolute_gap", "relative_gap", "baseline_value", "reference_value",
    "gap_value",
)


def finding(rule: str, source: str, origin: str, strength: str, text: dict[str, str], key: str | None = None, **values: str) -> str:
    item, key = catalog.DETECTORS[rule], key or rule
    columns = {
        "id": digest("F", quote(rule), "entity_id", source), "rule_id": quote(rule), "entity_id": "entity_id",
        "finding_type": quote(item["finding_type"]), "severity": quote(item["severity"]), "confidence": strength,
        "evidence_strength": strength, "title": fill(catalog.TITLES[key], **text),
        "summary": fill(catalog.SUMMARIES[key], **text), "rationale": fill(catalog.RATIONALES[key], **text),
        "source_phase": quote(item["phase"]), **values,
    }

    def column(name: str) -> str:
        kind = "double" if name in _DOUBLES else "bigint" if name == "population_size" else "varchar"
        return f"cast({columns.get(name, 'null')} as {kind}) as {name}"

    return f"select {', '.join(column(name) for name in FINDING_COLUMNS)} from {origin}"


def evidence_rows(rule: str, source: str, origin: str, items: list[tuple[str, str, str, str, str]]) -> str:
    """Union of evidence rows; items are (source type, source id, field, value, reason) in SQL or plain text."""
    parent = digest("F", quote(rule), "entity_id", source)
    return " union all ".join(
        f"select {digest('E', parent, quote(kind), where, quote(field))} as id, {parent} as finding_id, {quote(kind)} as source_type, "
        f"cast({where} as varchar) as source_id, entity_id, {quote(field)} as field, {value} as value, {reason} as reason from {origin}"
        for kind, where, field, value, reason in items
    )


R = catalog.EVIDENCE_REASONS


def plain(column: str) -> str:
    return f"cast({column} as varchar)"


_ALERT_ITEM = ("alert_feature", "alert_id", "id", "alert_id", quote(R["case_alert"]))

STEPS["hit_r001"] = "select * from case_f where severity = 'Critical' and is_closed and investigation_minutes <= 10"
STEPS["R001"] = finding(
    "R001", "id", "hit_r001", "'High'", {"id": "id", "minutes": "investigation_minutes"},
    metric_name="'investigation_minutes'", observed_value="investigation_minutes", threshold="10",
)
STEPS["R001_e"] = evidence_rows("R001", "id", "hit_r001", [
    ("case_feature", "id", "investigation_minutes", plain("investigation_minutes"), quote(R["R001_minutes"])),
    ("case_feature", "id", "severity", "severity", quote(R["R001_severity"])), _ALERT_ITEM,
])
STEPS["hit_r002"] = "select * from case_f where severity = 'Critical' and not is_escalated"
STEPS["R002"] = finding(
    "R002", "id", "hit_r002", "'High'", {"id": "id"}, metric_name="'is_escalated'", observed_value="0", expected_value="1",
)
STEPS["R002_e"] = evidence_rows("R002", "id", "hit_r002", [
    ("case_feature", "id", "severity", "severity", quote(R["R002_severity"])),
    ("case_feature", "id", "is_escalated", flag("is_escalated"), quote(R["R002_escalated"])), _ALERT_ITEM,
])
STEPS["asset_case"] = """
select a.asset_id, a.entity_id, c.id as case_id, c.is_remediated from alert_f a join case_f c on c.alert_id = a.id
"""
STEPS["hit_r003"] = """
select f.id, f.entity_id, f.alert_count, f.case_count, cast(0 as bigint) as remediated_case_count from asset_f f
 join (select asset_id, entity_id from asset_case group by 1, 2 having count(*) filter (is_remediated) = 0) s
 on s.asset_id = f.id and s.entity_id = f.entity_id where f.alert_count >= 3 and f.case_count > 0
"""
STEPS["hit_r003_case"] = """
select h.id, h.entity_id, c.case_id from hit_r003 h join asset_case c on c.asset_id = h.id and c.entity_id = h.entity_id
"""
STEPS["R003"] = finding(
    "R003", "id", "hit_r003", "'High'", {"id": "id", "alert_count": "alert_count", "case_count": "case_count"},
    metric_name="'alert_count'", observed_value="alert_count", threshold="3", population_size="case_count",
)
STEPS["R003_e"] = evidence_rows("R003", "id", "hit_r003", [
    ("asset_feature", "id", "alert_count", plain("alert_count"), quote(R["R003_alerts"])),
    ("asset_feature", "id", "case_count", plain("case_count"), quote(R["R003_cases"])),
    ("asset_feature", "id", "remediated_case_count", plain("remediated_case_count"), quote(R["R003_remediated"])),
]) + " union all " + evidence_rows("R003", "id", "hit_r003_case", [
    ("case_feature", "case_id", "is_remediated", "'False'", quote(R["R003_case"])),
])
STEPS["hit_r004"] = "select * from case_f where severity in ('High', 'Critical') and investigation_minutes < 10"
STEPS["R004"] = finding(
    "R004", "id", "hit_r004", "'Medium'", {"id": "id", "severity": "severity", "minutes": "investigation_minutes"},
    metric_name="'investigation_minutes'", observed_value="investigation_minutes", threshold="10",
)
STEPS["R004_e"] = evidence_rows("R004", "id", "hit_r004", [
    ("case_feature", "id", "severity", "severity", quote(R["R004_severity"])),
    ("case_feature", "id", "investigation_minutes", plain("investigation_minutes"), quote(R["R004_minutes"])), _ALERT_ITEM,
])
STEPS["hit_r005"] = """
select * from entity_f where expected_monitored_assets >= 10 and expected_monitored_assets_without_activity >= 5
 and monitoring_coverage_rate < cast(0.9 as double)
"""
STEPS["R005"] = finding(
    "R005", "entity_id", "hit_r005", "'High'",
    {"entity_id": "entity_id", "coverage": "monitoring_coverage_rate", "without_activity": "expected_monitored_assets_without_activity"},
    metric_name="'monitoring_coverage_rate'", observed_value="monitoring_coverage_rate", expected_value="0.9",
    threshold="0.9", population_size="expected_monitored_assets",
)
_R005_FIELDS = (
    "expected_monitored_assets", "assets_with_alert_activity", "expected_monitored_assets_with_activity",
    "expected_monitored_assets_without_activity", "monitoring_coverage_rate",
)
STEPS["R005_e"] = evidence_rows("R005", "entity_id", "hit_r005", [
    ("entity_feature", "entity_id", name, plain(name), quote(R["R005"].format(field=name))) for name in _R005_FIELDS
])

# --- execution gaps -------------------------------------------------------------------------------------------


def gap_strength(population: str, gap: str) -> str:
    return (
        f"case when {population} >= 20 and {gap} >= cast(0.25 as double) then 'High' "
        f"when {population} >= 10 or {gap} >= cast(0.2 as double) then 'Medium' else 'Low' end"
    )


def gap_finding(rule: str, origin: str, metric: str, population: str, expected: str, gap: str, strength_gap: str, relative: str, reference: str | None = None, **text: str) -> str:
    item = catalog.DETECTORS[rule]
    values = {"reference_value": reference} if reference else {}
    return finding(
        rule, "entity_id", origin, gap_strength(population, strength_gap),
        {"entity_id": "entity_id", "expected": expected, "observed": metric, "gap": gap, "population": population,
         "reference": reference or "null", **text},
        metric_name=quote(metric), observed_value=metric, expected_value=expected, population_size=population,
        absolute_gap=gap, relative_gap=relative, baseline_method=quote(item["baseline_method"]),
        baseline_type="'configured_expectation'", baseline_value=expected, gap_value=gap,
        gap_direction=quote(item["direction"]), **values,
    )


def gap_evidence(rule: str, origin: str, fields: tuple[str, ...]) -> str:
    return evidence_rows(rule, "entity_id", origin, [
        ("entity_feature", "entity_id", name, plain(name), quote(R["EG_feature"].format(field=name, rule=rule))) for name in fields
    ])


_E60, _E75, _E10 = "cast(0.6 as double)", "cast(0.75 as double)", "cast(0.1 as double)"
_G15 = "cast(0.15 as double)"
STEPS["hit_eg001"] = f"select * from entity_f where critical_case_count >= 5 and critical_escalation_rate <= {_E60} - {_G15}"
STEPS["EG001"] = gap_finding(
    "EG001", "hit_eg001", "critical_escalation_rate", "critical_case_count", _E60, f"({_E60} - critical_escalation_rate)",
    f"({_E60} - critical_escalation_rate)", f"(({_E60} - critical_escalation_rate) / {_E60})",
)
STEPS["hit_eg001_case"] = """
select h.entity_id, c.id, c.severity, c.is_escalated from hit_eg001 h join
 (select *, row_number() over (partition by entity_id order by id) as place from case_f where severity = 'Critical') c
 on c.entity_id = h.entity_id where c.place <= 10
"""
_EGC = quote(R["EG_case"].format(rule="EG001"))
STEPS["EG001_e"] = gap_evidence(
    "EG001", "hit_eg001", ("critical_case_count", "critical_escalated_case_count", "critical_escalation_rate")
) + " union all " + evidence_rows("EG001", "entity_id", "hit_eg001_case", [
    ("case_feature", "id", "id", "id", _EGC), ("case_feature", "id", "severity", "severity", _EGC),
    ("case_feature", "id", "is_escalated", flag("is_escalated"), _EGC),
])
STEPS["ref_eg002"] = f"""
select {middle('l')} as reference_value, cast(len(l) as bigint) as reference_population from (select list_sort(list(critical_median_investigation_minutes)) as l
 from entity_f where critical_case_count >= 5 and critical_median_investigation_minutes is not null)
"""
STEPS["hit_eg002"] = """
select *, (select reference_value from ref_eg002) as reference_value from entity_f
 where critical_case_count >= 5 and critical_median_investigation_minutes < cast(20 as double) * cast(0.6 as double)
"""
_CM = "critical_median_investigation_minutes"
STEPS["EG002"] = gap_finding(
    "EG002", "hit_eg002", _CM, "critical_case_count", "cast(20 as double)", f"(20 - {_CM})", f"((20 - {_CM}) / cast(20 as double))",
    f"((20 - {_CM}) / cast(20 as double))", "reference_value", ratio=f"({_CM} / cast(20 as double))",
)
STEPS["EG002_e"] = gap_evidence("EG002", "hit_eg002", ("critical_case_count", _CM))
STEPS["ref_eg003"] = f"""
select {middle('l')} as reference_value, cast(len(l) as bigint) as reference_population from (select list_sort(list(remediation_rate)) as l
 from entity_f where closed_case_count >= 10 and remediation_rate is not null)
"""
STEPS["hit_eg003"] = f"""
select *, (select reference_value from ref_eg003) as reference_value from entity_f
 where closed_case_count >= 10 and remediation_rate <= {_E75} - {_G15}
"""
STEPS["EG003"] = gap_finding(
    "EG003", "hit_eg003", "remediation_rate", "closed_case_count", _E75, f"({_E75} - remediation_rate)",
    f"({_E75} - remediation_rate)", f"(({_E75} - remediation_rate) / {_E75})", "reference_value",
)
STEPS["EG003_e"] = gap_evidence("EG003", "hit_eg003", ("closed_case_count", "remediated_case_count", "remediation_rate"))
STEPS["hit_eg004"] = f"select * from entity_f where closed_case_count >= 10 and rapid_closure_rate >= {_E10} + {_G15}"
STEPS["EG004"] = gap_finding(
    "EG004", "hit_eg004", "rapid_closure_rate", "closed_case_count", _E10, f"(rapid_closure_rate - {_E10})",
    f"(rapid_closure_rate - {_E10})", f"((rapid_closure_rate - {_E10}) / {_E10})",
)
STEPS["EG004_e"] = gap_evidence("EG004", "hit_eg004", ("closed_case_count", "rapid_closure_count", "rapid_closure_rate"))

# --- negative space -------------------------------------------------------------------------------------------

STEPS["obs"] = """
select min(t) as start, max(t) as "end", coalesce(min(t) < max(t), false) as sufficient,
 case when min(t) is null then 'INSUFFICIENT_OBSERVATION_WINDOW' end as reason
from (select timestamp as t from alerts union all select opened_at from cases)
"""


def absence_strength(population: str, magnitude: str, explicit: bool = True) -> str:
    high = f"when {population} >= 20 and {magnitude} >= cast(0.25 as double) then 'High' " if explicit else ""
    return f"case {high}when {population} >= 5 and {magnitude} >= cast(0.1 as double) then 'Medium' else 'Low' end"


def absence_finding(rule: str, source: str, origin: str, strength: str, text: dict[str, str], **values: str) -> str:
    window = {"start": iso("w_start"), "end": iso("w_end")}
    return finding(rule, source, origin, strength, {**text, **window}, gap_direction="'absence'", **values)


_WIN = '(select start as w_start, "end" as w_end from obs where sufficient) w'
STEPS["hit_ns001"] = f"""
select e.*, x.n as inactive, w.* from entity_f e join (select entity_id, count(*) as n from asset_f where expected_monitoring and alert_count = 0 group by 1) x
 using (entity_id), {_WIN}
where x.n >= 5 and expected_monitored_assets >= 5 and monitoring_coverage_rate < cast(0.9 as double)
"""
_NS1G = "(1 - monitoring_coverage_rate)"
STEPS["NS001"] = absence_finding(
    "NS001", "entity_id", "hit_ns001", absence_strength("expected_monitored_assets", _NS1G),
    {"expected": "expected_monitored_assets", "active": "expected_monitored_assets_with_activity", "inactive": "inactive",
     "coverage": "monitoring_coverage_rate"},
    observed_value="assets_with_alert_activity", expected_value="expected_monitored_assets",
    population_size="expected_monitored_assets", baseline_method="'expected_monitoring'",
    baseline_type="'configured_expectation'", baseline_value="1", gap_value=_NS1G,
)
STEPS["hit_ns001_asset"] = """
select h.entity_id, a.* exclude (entity_id) from hit_ns001 h join
 (select *, row_number() over (partition by entity_id order by id) as place from asset_f where expected_monitoring and alert_count = 0) a
 on a.entity_id = h.entity_id where a.place <= 20
"""
STEPS["NS001_e"] = evidence_rows("NS001", "entity_id", "hit_ns001", [
    ("entity_feature", "entity_id", name, plain(name), quote(R["NS001_entity"])) for name in _R005_FIELDS
]) + " union all " + evidence_rows("NS001", "entity_id", "hit_ns001_asset", [
    ("asset_feature", "id", "id", "id", quote(R["NS001_asset"])),
    ("asset_feature", "id", "expected_monitoring", flag("expected_monitoring"), quote(R["NS001_asset"])),
    ("asset_feature", "id", "alert_count", plain("alert_count"), quote(R["NS001_asset"])),
    ("asset_feature", "id", "expected_monitoring_no_activity", flag("expected_monitoring_no_activity"), quote(R["NS001_asset"])),
])
STEPS["hit_ns002"] = f"""
select e.*, x.n as inactive, w.* from entity_f e join (select entity_id, count(*) as n from asset_f where criticality = 'Critical' and alert_count = 0 group by 1) x
 using (entity_id), {_WIN} where critical_assets >= 3 and x.n >= 2
"""
_NS2G = "(cast(inactive as double) / critical_assets)"
STEPS["NS002"] = absence_finding(
    "NS002", "entity_id", "hit_ns002", absence_strength("critical_assets", _NS2G),
    {"expected": "critical_assets", "active": "critical_assets_with_activity", "inactive": "inactive"},
    observed_value="critical_assets_with_activity", expected_value="critical_assets", population_size="critical_assets",
    baseline_method="'expected_monitoring'", baseline_type="'configured_expectation'", baseline_value="1", gap_value=_NS2G,
)
STEPS["hit_ns002_asset"] = """
select h.entity_id, a.* exclude (entity_id) from hit_ns002 h join
 (select *, row_number() over (partition by entity_id order by id) as place from asset_f where criticality = 'Critical' and alert_count = 0) a
 on a.entity_id = h.entity_id where a.place <= 20
"""
STEPS["NS002_e"] = evidence_rows("NS002", "entity_id", "hit_ns002_asset", [
    ("asset_feature", "id", "id", "id", quote(R["NS002_asset"])),
    ("asset_feature", "id", "criticality", "criticality", quote(R["NS002_asset"])),
    ("asset_feature", "id", "expected_monitoring", flag("expected_monitoring"), quote(R["NS002_asset"])),
    ("asset_feature", "id", "alert_count", plain("alert_count"), quote(R["NS002_asset"])),
])
STEPS["active"] = "select entity_id, count(*) as total_alerts from alerts group by 1 having count(*) >= 20"
STEPS["prevalence"] = """
select source, count(distinct entity_id) as entity_count, (select count(*) from active) as active_entities,
 cast(count(distinct entity_id) as double) / (select count(*) from active) as prevalence
from alerts where entity_id in (select entity_id from active) group by source
"""
STEPS["expected_source"] = "select source from prevalence where prevalence >= cast(0.6 as double) and active_entities >= 2"
STEPS["missing_source"] = """
select a.entity_id, s.source from active a, expected_source s
where not exists (select 1 from alerts x where x.entity_id = a.entity_id and x.source = s.source)
"""
STEPS["hit_ns003"] = f"""
select a.entity_id, a.total_alerts, m.missing, m.n as missing_count, o.observed, o.n as observed_count,
 (select count(*) from expected_source) as expected_count, w.*
from active a join (select entity_id, string_agg(source, ', ' order by source) as missing, count(*) as n from missing_source group by 1) m using (entity_id)
join (select entity_id, string_agg(distinct source, ', ' order by source) as observed, count(distinct source) as n from alerts group by 1) o using (entity_id), {_WIN}
"""
_NS3G = "(cast(missing_count as double) / expected_count)"
STEPS["NS003"] = absence_finding(
    "NS003", "entity_id", "hit_ns003", absence_strength("total_alerts", _NS3G),
    {"missing": "missing", "observed": "observed", "total": "total_alerts", "expected_count": "expected_count"},
    observed_value="observed_count", expected_value="expected_count", population_size="total_alerts",
    baseline_method="'cohort_telemetry_presence'", baseline_type="'cohort_expectation'", baseline_value="expected_count",
    gap_value=_NS3G,
)
_NS3R = fill(R["NS003"], missing="missing")
STEPS["NS003_e"] = evidence_rows("NS003", "entity_id", "hit_ns003", [
    ("alert_feature", "entity_id", "entity_id", "entity_id", _NS3R),
    ("alert_feature", "entity_id", "total_alerts", plain("total_alerts"), _NS3R),
    ("alert_feature", "entity_id", "observed_sources", "observed", _NS3R),
    ("alert_feature", "entity_id", "missing_categories", "missing", _NS3R),
])
STEPS["month_rank"] = """
select *, row_number() over (partition by entity_id order by year desc, month desc) as place from month_f
"""
STEPS["hit_ns004"] = f"""
select c.entity_id, c.year, c.month, cast(c.alert_count as double) as observed, h.baseline, w.*
from month_rank c join (select entity_id, median(alert_count) as baseline from month_rank where place between 2 and 4 group by 1 having count(*) = 3) h
 using (entity_id), {_WIN} where c.place = 1 and h.baseline >= 1 and c.alert_count < h.baseline * cast(0.3 as double)
"""
_NS4S = "entity_id || '-' || year || '-' || month"
_NS4H = "entity_id || '-' || hit_year || '-' || hit_month"
STEPS["NS004"] = absence_finding(
    "NS004", _NS4S, "hit_ns004", absence_strength("3", "((baseline - observed) / baseline)", False),
    {"baseline": "baseline", "observed": "observed"}, observed_value="observed", population_size="3",
    baseline_method="'historical_self_median'", baseline_type="'reference_statistic'", baseline_value="baseline",
    gap_value="(baseline - observed)",
)
STEPS["hit_ns004_month"] = """
select h.entity_id, h.year as hit_year, h.month as hit_month, m.year, m.month, m.alert_count, m.case_count
from hit_ns004 h join month_rank m using (entity_id) where m.place <= 4
"""
STEPS["NS004_e"] = evidence_rows("NS004", _NS4H, "hit_ns004_month", [
    ("entity_month_feature", f"({_NS4S})", name, plain(name), quote(R["NS004"])) for name in ("year", "month", "alert_count", "case_count")
])
STEPS["hit_ns005"] = f"""
select x.*, w.* from (select entity_id, count(*) as eligible, count(*) filter (not has_case) as missing from alert_f where severity = 'Critical' group by 1) x, {_WIN}
where eligible >= 3 and missing > 0
"""
STEPS["NS005"] = absence_finding(
    "NS005", "entity_id", "hit_ns005", absence_strength("eligible", "(cast(missing as double) / eligible)"),
    {"eligible": "eligible", "missing": "missing"}, observed_value="missing", expected_value="0", population_size="eligible",
    baseline_method="'configured_critical_investigation_expectation'", baseline_type="'configured_expectation'",
    baseline_value="0", gap_value="missing",
)
STEPS["hit_ns005_alert"] = """
select h.entity_id, a.id, a.severity, a.timestamp, a.has_case, a.case_id from hit_ns005 h join
 (select *, row_number() over (partition by entity_id order by severity, timestamp, id) as place from alert_f where severity = 'Critical' and not has_case) a
 on a.entity_id = h.entity_id where a.place <= 20
"""
STEPS["NS005_e"] = evidence_rows("NS005", "entity_id", "hit_ns005_alert", [
    ("alert_feature", "id", "id", "id", quote(R["NS005"])), ("alert_feature", "id", "severity", "severity", quote(R["NS005"])),
    ("alert_feature", "id", "timestamp", spaced("timestamp"), quote(R["NS005"])),
    ("alert_feature", "id", "has_case", flag("has_case"), quote(R["NS005"])),
    ("alert_feature", "id", "case_id", "case_id", quote(R["NS005"])),
])

# --- peers ----------------------------------------------------------------------------------------------------

STEPS["keyed"] = "select *, sector || '|' || size || '|' || criticality as cohort_key from entity_f"


def long_form(metrics: tuple[str, ...], keep: str = "") -> str:
    return " union all ".join(
        f"select entity_id, cohort_key, {keep}'{name}' as metric_name, cast({name} as double) as value from keyed where {name} is not null"
        for name in metrics
    )


STEPS["metric_long"] = long_form(catalog.BENCHMARK_METRICS)
STEPS["benchmark"] = f"""
select cohort_key, metric_name, cast(len(l) as bigint) as peer_count, {middle('l')} as peer_median, peer_mean, peer_std,
 l[cast(floor((len(l) - 1) * 0.25 + 0.5) as bigint) + 1] as peer_p25, l[cast(floor((len(l) - 1) * 0.75 + 0.5) as bigint) + 1] as peer_p75
from (select cohort_key, metric_name, list_sort(list(value)) as l, avg(value) as peer_mean, coalesce(stddev_pop(value), 0) as peer_std
 from metric_long group by 1, 2 having count(*) >= 3)
"""
_PB = {name: catalog.DETECTORS[name] for name in catalog.enabled("phase8") if name.startswith("PB")}
STEPS["peer_long"] = long_form(
    tuple(item["metric"] for item in _PB.values()), "critical_case_count, closed_case_count, total_assets, "
)
STEPS["peer_pair"] = f"""
select *, {middle('l')} as peer_median, len(l) as peer_count from (
 select x.*, (select list_sort(list(y.value)) from peer_long y where y.cohort_key = x.cohort_key and y.metric_name = x.metric_name and y.entity_id <> x.entity_id) as l
 from peer_long x) where len(l) >= 2
"""
_GATES = " or ".join(f"(metric_name = '{item['metric']}' and {item['population'][0]} >= {item['population'][1]})" for item in _PB.values())
STEPS["peer_hit"] = f"""
select *, abs(value - peer_median) as deviation from peer_pair where ({_GATES}) and case metric_name
 when 'critical_escalation_rate' then abs(value - peer_median) >= cast(0.15 as double)
 when 'remediation_rate' then abs(value - peer_median) >= cast(0.15 as double)
 when 'critical_median_investigation_minutes' then peer_median > 0 and (value <= peer_median * 0.5 or value >= peer_median * 1.5)
 else peer_median > 0 and (value <= peer_median * 0.5 or value >= peer_median * 2.0) end
"""
for _name, _item in _PB.items():
    STEPS[f"hit_{_name}"] = f"select * from peer_hit where metric_name = '{_item['metric']}'"
    _magnitude = "(deviation / greatest(abs(peer_median), 1e-9))"
    STEPS[_name] = finding(
        _name, "cohort_key || '|' || metric_name", f"hit_{_name}",
        f"case when peer_count >= 4 and {_magnitude} >= cast(0.25 as double) then 'High' when peer_count >= 2 and {_magnitude} >= cast(0.15 as double) then 'Medium' else 'Low' end",
        {"metric": "metric_name", "observed": "value", "median": "peer_median", "peers": "peer_count", "cohort": "cohort_key", "deviation": "deviation"},
        key="PB", metric_name="metric_name", observed_value="value", population_size="peer_count", absolute_gap="deviation",
        baseline_method="'peer_median'", baseline_type="'peer_reference'", baseline_value="peer_median",
        reference_value="peer_median", gap_value="deviation", gap_direction="'peer_deviation'",
    )
    STEPS[f"{_name}_e"] = evidence_rows(_name, "cohort_key || '|' || metric_name", f"hit_{_name}", [
        ("entity_feature", "entity_id", _item["metric"], plain("value"), quote(R["PB_entity"])),
        ("entity_feature", "entity_id", "cohort_key", "cohort_key", quote(R["PB_entity"])),
    ])

for _phase, _label in (("phase5", "rule"), ("phase6", "gap"), ("phase7", "absence"), ("phase8", "peer")):
    _names = catalog.enabled(_phase)
    STEPS[f"{_label}_findings"] = " union all ".join(f"select * from {name}" for name in _names)
    STEPS[f"{_label}_evidence"] = " union all ".join(f"select * from {name}_e" for name in _names)
STEPS["findings"] = " union all ".join(f"select * from {label}_findings" for label in ("rule", "gap", "absence", "peer"))
STEPS["evidence"] = " union all ".join(f"select * from {label}_evidence" for label in ("rule", "gap", "absence", "peer"))

# --- anomaly matrix -------------------------------------------------------------------------------------------

STEPS["anomaly_profile"] = " union all ".join(
    f"select '{name}' as feature, cast(count(*) - count({name}) as double) / count(*) as missing_share, "
    f"count(distinct {name}) + case when count({name}) < count(*) then 1 else 0 end as distinct_values, "
    f"(select {middle('l')} from (select list_sort(list(cast({name} as double))) as l from entity_f where {name} is not null)) as median, "
    f"cast(count(*) - count({name}) as double) / count(*) <= 0.5 and count(distinct {name}) + case when count({name}) < count(*) then 1 else 0 end > 1 as is_usable "
    f"from entity_f"
    for name in catalog.ANOMALY_FEATURES
)

# --- anomaly forest: every entity walks down every tree, level by level ------------------------------------------


def _drawn(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"(cast(cast('0x' || substr(md5({text}), 1, 13) as bigint) as double) / 4503599627370496.0)"


def _path(size: str) -> str:
    n = f"cast({size} as double)"
    return f"(case when {size} <= 1 then 0.0 when {size} = 2 then 1.0 else 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} end)"


_AF, _SEED = catalog.ANOMALY_FEATURES, f"'{catalog.FOREST_SEED}'"
STEPS["forest_matrix"] = "select entity_id, [" + ", ".join(
    f"coalesce(case when (select is_usable from anomaly_profile where feature = '{name}') then coalesce(cast({name} as double), (select median from anomaly_profile where feature = '{name}')) end, 0.0)"
    for name in _AF
) + "] as x from entity_f"
STEPS["forest_sample"] = f"""
select tree, entity_id from (
 select tree, entity_id, row_number() over (partition by tree order by {_drawn(_SEED, 'cast(tree as varchar)', 'entity_id')}, entity_id) as place
 from forest_matrix cross join (select unnest(range({catalog.FOREST_TREES})) as tree) t
) d where place <= {catalog.FOREST_SAMPLE}
"""
STEPS["forest_walk_0"] = f"""
select t.tree, m.entity_id, '' as turns, s.entity_id is not null as sampled, m.x
from forest_matrix m cross join (select unnest(range({catalog.FOREST_TREES})) as tree) t left join forest_sample s on s.tree = t.tree and s.entity_id = m.entity_id
"""
_LEVELS = 8  # a tree of at most 256 rows is at most this deep
STEPS["forest_limit"] = "select tree, cast(ceil(log2(greatest(count(*), 2))) as bigint) as depth_limit from forest_sample group by 1"
for _level in range(_LEVELS + 1):
    _lows = ", ".join(f"min(x[{place + 1}])" for place in range(len(_AF)))
    _highs = ", ".join(f"max(x[{place + 1}])" for place in range(len(_AF)))
    STEPS[f"forest_node_{_level}"] = f"""
select tree, turns, n, lows, highs, case when {_level} < depth_limit and n > 1 and len(open) > 0 then open[1 + cast(floor({_drawn(_SEED, 'cast(tree as varchar)', 'turns', "'feature'")} * len(open)) as bigint)] end as feature,
 {_drawn(_SEED, 'cast(tree as varchar)', 'turns', "'cut'")} as share
from (
 select tree, turns, n, lows, highs, [place for place in range(1, {len(_AF) + 1}) if highs[place] > lows[place]] as open
 from (select tree, turns, count(*) as n, [{_lows}] as lows, [{_highs}] as highs from forest_walk_{_level} where sampled group by all) g
) o join forest_limit using (tree)
"""
    STEPS[f"forest_leaf_{_level}"] = f"select entity_id, {_level} + {_path('n')} as depth from forest_walk_{_level} join forest_node_{_level} using (tree, turns) where feature is null"
    STEPS[f"forest_walk_{_level + 1}"] = f"""
select tree, entity_id, turns || case when x[feature] <= lows[feature] + share * (highs[feature] - lows[feature]) then '0' else '1' end as turns, sampled, x
from forest_walk_{_level} join forest_node_{_level} using (tree, turns) where feature is not null
"""
STEPS["forest_score"] = f"""
select entity_id, {rounded(f"-pow(2.0, -(sum(depth) / {catalog.FOREST_TREES}) / (select {_path('least(count(*), ' + str(catalog.FOREST_SAMPLE) + ')')} from forest_matrix))", 9)} as score
from ({" union all ".join(f"select * from forest_leaf_{level}" for level in range(_LEVELS + 1))}) l group by 1
"""
_AT = f"(select (count(*) - 1) * cast({catalog.FOREST_CONTAMINATION} as double) from forest_score)"
STEPS["forest_flag"] = f"""
select entity_id, {rounded('score - cut', 9)} as anomaly_score, row_number() over (order by {rounded('score - cut', 9)}, entity_id) as anomaly_rank from forest_score cross join (
 select low + (high - low) * ({_AT} - floor({_AT})) as cut from (
  select l[cast(floor({_AT}) as bigint) + 1] as low, l[least(cast(floor({_AT}) as bigint) + 2, len(l))] as high from (select list_sort(list(score)) as l from forest_score) a) b) c
where (select count(*) from forest_matrix) >= {catalog.FOREST_MIN_ENTITIES}
"""

STEPS["anomaly_deviation"] = " union all ".join(
    f"select entity_id, '{name}' as feature, cast({name} as double) as observed, (select median from anomaly_profile where feature = '{name}' and is_usable) as reference from entity_f where {name} is not null"
    for name in _AF
)
STEPS["anomaly_top"] = """
select *, row_number() over (partition by entity_id order by -relative, feature) as place from (
 select *, abs(observed - reference) / case when reference = 0 then 1.0 else abs(reference) end as relative from anomaly_deviation where reference is not null)
qualify place <= 3
"""
STEPS["hit_AN001"] = f"""
select f.entity_id, f.anomaly_score, f.anomaly_rank, count(t.feature) as parts, coalesce(avg(t.relative), 0) as mean_deviation,
 coalesce(list(t.feature order by t.place) filter (t.feature is not null), []) as features,
 coalesce(string_agg({fill(catalog.RATIONALES['AN001_ITEM'], feature='t.feature', observed='t.observed', reference='t.reference')}, '; ' order by t.place), '') as listed
from forest_flag f left join anomaly_top t using (entity_id) where f.anomaly_score < 0 group by all
"""
STEPS["AN001"] = finding(
    "AN001", "entity_id", "hit_AN001", "case when parts >= 3 then 'High' else 'Medium' end", {"deviations": "listed"}, metric_name="'anomaly_score'",
    observed_value="anomaly_score", baseline_method="'isolation_forest'", baseline_type="'model_relative_unusualness'",
)
_AP = digest("F", quote("AN001"), "entity_id", "entity_id")
STEPS["AN001_e"] = (
    f"select {digest('E', _AP, quote('entity_feature'), 'entity_id', 'feature')} as id, {_AP} as finding_id, 'entity_feature' as source_type, entity_id as source_id, "
    f"entity_id, feature as field, {plain('observed')} as value, {quote(R['AN001'])} as reason from anomaly_top where entity_id in (select entity_id from hit_AN001)"
)

# --- risk -----------------------------------------------------------------------------------------------------

STEPS["summary"] = """
select f.entity_id, f.rule_id as detector_id, count(*) as finding_count, arg_min(f.source_phase, f.id) as source_phase,
 arg_min(f.severity, f.id) as severity, arg_min(f.evidence_strength, f.id) as own_strength, arg_min(f.title, f.id) as title,
 arg_min(f.rationale, f.id) as finding_rationale, arg_min(f.observed_value, f.id) as observed_value,
 arg_min(f.population_size, f.id) as population_size, coalesce(arg_min(f.absolute_gap, f.id), 0) as absolute_gap,
 coalesce(arg_min(f.baseline_value, f.id), 1) as baseline_value, coalesce(arg_min(f.reference_value, f.id), 1) as reference_value,
 arg_min(f.gap_value, f.id) as gap_value
from findings f group by 1, 2
"""
STEPS["signal_base"] = """
select s.*, e.expected_monitored_assets, e.critical_assets, e.critical_alert_count, a.anomaly_score, a.anomaly_rank, a.mean_deviation, a.features,
 case detector_id when 'R001' then case when e.critical_closed_case_count > 0 then e.critical_closed_case_count else e.closed_case_count end
  when 'R002' then e.critical_case_count when 'R003' then e.total_assets when 'R004' then e.case_count when 'R005' then e.expected_monitored_assets end as denominator
from summary s join entity_f e using (entity_id) left join hit_AN001 a on a.entity_id = s.entity_id and s.detector_id = 'AN001'
"""
_SHARE = "least(1.0, cast(finding_count as double) / denominator)"
_NORMS = {
    "detector_id in ('R001', 'R002', 'R004')": rounded(f"{_SHARE} * 100"),
    "detector_id = 'R003'": rounded(f"{_SHARE} * 300"),
    "detector_id = 'R005'": rounded("observed_value / denominator * 100"),
    "detector_id = 'EG004'": rounded("gap_value / cast(0.4 as double) * 100"),
    "detector_id like 'EG%'": rounded("gap_value / case when baseline_value > 0 then baseline_value else 1 end * 100"),
    "detector_id = 'NS001'": rounded("observed_value / greatest(expected_monitored_assets, 1) * 100"),
    "detector_id = 'NS002'": rounded("observed_value / greatest(critical_assets, 1) * 100"),
    "detector_id = 'NS005'": rounded("observed_value / greatest(critical_alert_count, 1) * 100"),
    "detector_id in ('NS003', 'NS004')": rounded("coalesce(gap_value, 0.5) * 100"),
    "detector_id = 'AN001'": f"least(cast({catalog.ANOMALY_CEILING} as double), "
    + rounded(f"greatest(5.0, 18.0 - (anomaly_rank - 1) * 4.0) + least(7.0, {rounded('mean_deviation * 8.0')})") + ")",
    "detector_id like 'PB%'": rounded("absolute_gap / greatest(abs(reference_value), 1e-6) * 60"),
}
STEPS["signal_value"] = (
    "select *, coalesce(denominator, 1) <> 0 as is_assessable, case when coalesce(denominator, 1) = 0 then cast(0 as double) else least(cast(100 as double), case "
    + " ".join(f"when {test} then {value}" for test, value in _NORMS.items())
    + " end) end as normalized_value from signal_base"
)
_SIGNAL_NAME = "case detector_id " + " ".join(
    f"when '{name}' then {quote(text)}" for name, text in catalog.SIGNAL_NAMES.items()
) + " else title end"
_T = catalog.SIGNAL_RATIONALES
_SV = {"count": "finding_count", "denominator": "denominator", "norm": "normalized_value", "observed": "observed_value"}
STEPS["signal"] = f"""
select entity_id, detector_id, source_phase, {_SIGNAL_NAME} as signal_name,
 case when detector_id in ('R001', 'R002', 'R003', 'R004') then cast(finding_count as double) when detector_id like 'EG%' then gap_value
  when detector_id like 'PB%' then absolute_gap when detector_id = 'AN001' then anomaly_score else observed_value end as raw_value,
 normalized_value, severity, case when detector_id not like 'R0%' then own_strength end as evidence_strength,
 case when not is_assessable then 'Low' when detector_id not like 'R0%' then own_strength when denominator >= 10 then 'Medium' else 'Low' end as assessment_strength,
 finding_count,
 case when not is_assessable then '' when detector_id = 'R001' then {fill(_T['R001'], **_SV)} when detector_id = 'R002' then {fill(_T['R002'], **_SV)}
  when detector_id = 'R003' then {fill(_T['R003'], **_SV)} when detector_id = 'R004' then {fill(_T['R004'], **_SV)} when detector_id = 'R005' then {fill(_T['R005'], **_SV)}
  when detector_id like 'EG%' then {fill(_T['EG'], gap='gap_value', baseline='baseline_value', rationale='finding_rationale')}
  when detector_id = 'AN001' then {fill(_T['AN001'], rank='anomaly_rank', deviation='mean_deviation')} else finding_rationale end as rationale,
 is_assessable, features
from signal_value
"""
STEPS["membership"] = "select * from (values " + ", ".join(
    f"({quote(group)}, {place}, {quote(dimension)}, {quote(detector)}, {order}, cast([{', '.join(map(quote, names))}] as varchar[]))"
    for place, (group, dimension, detectors, names, _) in enumerate(catalog.CORRELATION_GROUPS)
    for order, detector in enumerate(detectors)
) + ") t(group_id, group_position, dimension, detector_id, detector_position, relevant)"
STEPS["member"] = """
select s.*, m.group_id, m.group_position, m.dimension, m.detector_position from signal s join membership m using (detector_id)
where is_assessable and normalized_value > 0 and (detector_id <> 'AN001' or list_contains(m.relevant, '*') or list_has_any(s.features, m.relevant))
"""
_RANKS = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}


def highest(column: str) -> str:
    rank = " ".join(f"when '{name}' then {place}" for name, place in _RANKS.items())
    back = " ".join(f"when {place} then '{name}'" for name, place in _RANKS.items())
    return f"case max(case {column} {rank} end) {back} end as {column}"


STEPS["grp"] = f"""
select *, {rounded('base_value * (cast(1 as double) + corroboration_boost)')} as unbounded_value from (
 select entity_id, group_id, group_position, dimension, max(normalized_value) as base_value,
  arg_min(detector_id, (-normalized_value, detector_position)) as primary_detector,
  string_agg(distinct source_phase, ', ' order by source_phase) as phases, count(distinct source_phase) as phase_count,
  string_agg(detector_id, ', ' order by detector_position) as detectors, arg_min(detector_id, detector_position) as first_detector, min(source_phase) as first_phase,
  string_agg({fill(catalog.GROUP_RATIONALE_DETAIL, detector='detector_id', phase='source_phase', norm='normalized_value')}, '; ' order by detector_position) as details,
  {highest('severity')}, {highest('assessment_strength')}, {highest('evidence_strength')}, cast(sum(finding_count) as bigint) as supporting_finding_count,
  least(cast(0.3 as double), (count(distinct source_phase) - 1) * cast(0.12 as double)) as corroboration_boost
 from member group by 1, 2, 3, 4)
"""
STEPS["groups"] = f"""
select *, case when phase_count >= 3 then 'Strong' when phase_count = 2 then 'Moderate' else 'Single Phase' end as corroboration_level, {fill(
    catalog.GROUP_RATIONALE, group='group_id', base='base_value', primary='primary_detector',
    phases="case when phase_count > 1 then " + fill(catalog.GROUP_RATIONALE_MANY, count='phase_count', phases='phases') + f" else '{catalog.GROUP_RATIONALE_ONE}' end",
    boost='corroboration_boost * 100', final='final_value', details='details')} as rationale
from (select *, least(cast(100 as double), unbounded_value) as final_value from grp)
"""
_WEIGHT = "case dimension " + " ".join(f"when '{name}' then cast({weight} as double)" for name, _, weight, _ in catalog.DIMENSIONS) + " end"
STEPS["contribution"] = f"""
select substr(sha256({fill('{e}:{g}:{d}:{f:.2f}', e='entity_id', g='group_id', d='dimension', f='final_value')}), 1, 16) as id, entity_id, dimension,
 first_phase as source_phase, first_detector as detector_id, group_id || ' (' || corroboration_level || ' Corroboration)' as signal_name,
 base_value as raw_value, final_value as normalized_value, {_WEIGHT} as weight, {rounded(f'final_value * ({_WEIGHT})')} as contribution, severity,
 evidence_strength, assessment_strength, group_id as corroboration_group, supporting_finding_count, rationale
from groups
"""
_EMPTY = {
    "Escalation": "critical_case_count = 0 and case_count = 0 and alert_count = 0",
    "Investigation": "closed_case_count = 0 and case_count = 0",
    "Remediation": "total_assets = 0 and expected_monitored_assets = 0",
    "Monitoring": "total_assets = 0 and expected_monitored_assets = 0",
    "Operational Discipline": "alert_count = 0 and case_count = 0",
    "Cyber Resilience": "false",
}
STEPS["dim_value"] = """
select entity_id, dimension, max(final_value) as top_value, sum(final_value) as all_values, count(*) as n from groups group by 1, 2
"""
STEPS["dims"] = "select e.entity_id, " + ", ".join(
    f"case when {_EMPTY[name]} then null when d{place}.n is null then cast(0 as double) when d{place}.n = 1 then {rounded(f'd{place}.top_value')} "
    f"else {rounded(f'least(cast(100 as double), d{place}.top_value + cast(0.2 as double) * (d{place}.all_values - d{place}.top_value))')} end as {field}"
    for place, (name, field, _, _) in enumerate(catalog.DIMENSIONS)
) + " from entity_f e " + " ".join(
    f"left join dim_value d{place} on d{place}.entity_id = e.entity_id and d{place}.dimension = '{name}'"
    for place, (name, _, _, _) in enumerate(catalog.DIMENSIONS)
)
_FIELDS = [(name, field, weight) for name, field, weight, _ in catalog.DIMENSIONS]
_WSUM = " + ".join(f"coalesce(cast({weight} as double) * {field}, 0)" for _, field, weight in _FIELDS)
_WALL = " + ".join(f"case when {field} is not null then cast({weight} as double) else 0 end" for _, field, weight in _FIELDS)
_NUM = " + ".join(f"case when {field} is not null then 1 else 0 end" for _, field, _ in _FIELDS)
STEPS["scored"] = f"""
select *, case when {_WALL} > 0 then least(cast(100 as double), greatest(cast(0 as double), {rounded(f'({_WSUM}) / ({_WALL})')})) else 0 end as overall_score,
 cast({_NUM} as bigint) as assessable_dimensions from dims
"""
STEPS["top_dim"] = "select entity_id, arg_min(name, (-score, place)) as name, max(score) as score from (" + " union all ".join(
    f"select entity_id, '{name}' as name, {place} as place, {field} as score from dims where {field} is not null"
    for place, (name, field, _) in enumerate(_FIELDS)
) + ") group by 1"
STEPS["driver"] = """
select g.entity_id, g.dimension, arg_min(g.group_id, (-g.final_value, g.group_position)) as group_id, max(g.final_value) as final_value,
 arg_min(g.corroboration_level, (-g.final_value, g.group_position)) as level, arg_min(g.detectors, (-g.final_value, g.group_position)) as detectors
from groups g group by 1, 2
"""
STEPS["histogram"] = """
select entity_id, string_agg(strength || ': ' || n, ', ' order by strength) as summary, cast(sum(n) as bigint) as n, bool_or(gap) as gap, bool_or(blind) as blind
from (select entity_id, coalesce(evidence_strength, 'Unannotated') as strength, count(*) as n, bool_or(source_phase = 'phase6') as gap,
 bool_or(source_phase = 'phase7') as blind from findings group by 1, 2) group by 1
"""
STEPS["agreement"] = """
select entity_id, string_agg(group_id || ' (' || corroboration_level || ')', ', ' order by group_position) as listed, bool_or(corroboration_level = 'Strong') as strong
from groups where corroboration_level in ('Moderate', 'Strong') group by 1
"""
_BAND = "case " + " ".join(f"when overall_score between {low} and {high} then '{name}'" for name, low, high in catalog.RISK_BANDS) + " when overall_score >= 75 then 'CRITICAL' else 'LOW' end"
STEPS["assessed"] = f"""
select s.*, {_BAND} as risk_band, {rounded('assessable_dimensions / cast(6 as double)')} as assessment_coverage, cast(6 as bigint) as total_dimensions,
 coalesce(h.summary, 'No findings') as evidence_strength_summary,
 coalesce('Corroborated groups: ' || a.listed, 'No multi-phase corroborated groups') as corroboration_summary,
 case when t.score > 0 then t.name else 'None' end as top_risk_dimension,
 case when t.score > 0 then {fill(catalog.TOP_REASON, dimension='t.name', group='d.group_id', final='d.final_value', level='d.level', detectors='d.detectors')} else {quote(catalog.NO_REASON)} end as top_reason,
 coalesce(h.n, 0) as supporting_finding_count, coalesce(h.gap, false) as gap, coalesce(h.blind, false) as blind,
 coalesce(a.strong, false) as strong, a.entity_id is not null and not coalesce(a.strong, false) as moderate
from scored s left join histogram h using (entity_id) left join agreement a using (entity_id) left join top_dim t using (entity_id)
left join driver d on d.entity_id = s.entity_id and d.dimension = t.name
"""
_Q = catalog.QUEUE_REASONS
_PRIORITY = "case when priority_score >= 70 then 'HIGH' when priority_score >= 40 then 'MEDIUM' else 'LOW' end"
STEPS["queue_entity"] = f"""
select entity_id, 'ENTITY' as record_type, entity_id as record_id,
 least(cast(100 as double), greatest(cast(0 as double), {rounded("(overall_score * cast(0.4 as double) + case when gap then 25 else 0 end + case when blind then 15 else 0 end + case when strong then 15 when moderate then 8 else 0 end) * case when contains(evidence_strength_summary, 'High') then cast(1.05 as double) when contains(evidence_strength_summary, 'Low') then cast(0.9 as double) else 1 end")})) as priority_score,
 {fill(_Q['ENTITY'], entity_id='entity_id', band='risk_band', score='overall_score', reason='top_reason', gap=f"case when gap then {quote(_Q['ENTITY_GAP'])} else '' end", blindspot=f"case when blind then {quote(_Q['ENTITY_BLINDSPOT'])} else '' end", corroboration='corroboration_summary')} as reason,
 (select string_agg(id, '|' order by place) from (select id, row_number() over (order by source_phase, rule_id, id) as place from findings f where f.entity_id = a.entity_id) where place <= 10) as supporting_finding_ids,
 case when contains(evidence_strength_summary, 'High') then 'High' else 'Medium' end as evidence_strength
from assessed a where supporting_finding_count > 0 or overall_score <> 0
"""
STEPS["queue_finding"] = f"""
select entity_id, 'FINDING' as record_type, id as record_id, least(cast(100 as double), {rounded('cast(65 as double) + abs(coalesce(gap_value, 0)) * cast(40 as double)')}) as priority_score,
 {fill(_Q['FINDING'], rule='rule_id', title='title', gap='gap_value', baseline='baseline_value')} as reason, id as supporting_finding_ids, evidence_strength
from findings where source_phase = 'phase6'
"""
STEPS["queue_asset"] = f"""
select f.entity_id, 'ASSET' as record_type, coalesce((select min(e.source_id) from evidence e where e.finding_id = f.id and e.source_type = 'asset_feature'), f.id) as record_id,
 case when rule_id = 'NS002' then cast(80 as double) else cast(65 as double) end as priority_score, {fill(_Q['ASSET'], rule='rule_id', title='title')} as reason,
 f.id as supporting_finding_ids, evidence_strength
from findings f where rule_id in ('NS001', 'NS002')
"""
STEPS["queue"] = f"""
select row_number() over (order by priority_score desc, entity_id, record_type, record_id) as rank, entity_id, record_type, record_id, {_PRIORITY} as priority,
 priority_score, reason, supporting_finding_ids, evidence_strength
from (select * from queue_entity union all select * from queue_finding union all select * from queue_asset)
"""
STEPS["enriched"] = "select a.*, e.name, e.sector, e.size, e.criticality from assessed a left join entity_f e using (entity_id)"
STEPS["links"] = """
select m.entity_id, m.group_id, m.detector_position, m.detector_id, f.id as finding_id from member m join findings f on f.entity_id = m.entity_id and f.rule_id = m.detector_id
"""

STEPS.update(FAULTS)


def compose(final: str) -> str:
    """WITH chain of the steps the final SELECT needs, in dependency order."""
    names = set(STEPS)

    def needs(text: str) -> list[str]:
        found = []
        for word in re.findall(r"(?:from|join|,)\s+\(?\s*([A-Za-z_0-9]+)", text):
            if word in names and word not in found:
                found.append(word)
        return found

    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in needs(STEPS[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in needs(final):
        visit(name)
    if not ordered:
        return final
    return "with " + ",\n".join(f"{name} as ({STEPS[name].strip()})" for name in ordered) + "\n" + final


# --- final statements -----------------------------------------------------------------------------------------

_F_COLUMNS = ", ".join(FINDING_COLUMNS)
_TIMES = {
    "entities": ("created_at",), "assets": (), "alerts": ("timestamp", "acknowledged_at", "closed_at"),
    "cases": ("opened_at", "closed_at"), "escalations": ("created_at",),
}


def _with_text_times(source: str, times: tuple[str, ...]) -> str:
    if not times:
        return f"select * from {source}"
    return f"select * replace ({', '.join(f'{stamp(name)} as {name}' for name in times)}) from {source}"


def _issue(count: str, origin: str, dataset: str, field: str, error: str, message: str) -> str:
    return (
        f"select {quote(dataset)} as dataset, {quote(field)} as field, {quote(error)} as error_type, "
        f"n || {quote(message)} as message, 'error' as severity from (select {count} as n from {origin}) where n > 0"
    )


def _frame_issues() -> str:
    parts = []
    for dataset in catalog.DATASETS:
        origin = f"bad_{dataset}"
        for name in catalog.REQUIRED_COLUMNS[dataset]:
            parts.append(_issue(f"count(*) filter ({name} is null)", origin, dataset, name, "REQUIRED_NULL", f" null value(s) in required field {name}"))
        parts.append(_issue("count(*) - count(distinct id)", origin, dataset, "id", "DUPLICATE_ID", f" duplicate {dataset} ID value(s)"))
        for name, allowed in catalog.CATEGORY_DOMAINS.items():
            if name in catalog.REQUIRED_COLUMNS[dataset]:
                listed = ", ".join(quote(value) for value in allowed)
                parts.append(
                    f"select {quote(dataset)} as dataset, {quote(name)} as field, 'INVALID_CATEGORY' as error_type, "
                    f"'Unknown {name} value(s): [' || string_agg('''' || v || '''', ', ' order by v) || ']' as message, 'error' as severity "
                    f"from (select distinct {name} as v from {origin} where {name} not in ({listed}) order by 1 limit 5) having count(*) > 0"
                )
    return " union all ".join(parts)


def _reference_issues() -> str:
    parts = [
        _issue("count(*)", f"bad_{name} x where not exists (select 1 from bad_entities e where e.id = x.entity_id)", name, "entity_id", "ORPHAN_ENTITY", " row(s) reference unknown entity IDs")
        for name in ("assets", "alerts", "cases", "escalations")
    ]
    for child, parent, key, error, noun, what in (
        ("alerts", "assets", "asset_id", "ORPHAN_ASSET", "alert", "asset"),
        ("cases", "alerts", "alert_id", "ORPHAN_ALERT", "case", "alert"),
        ("escalations", "cases", "case_id", "ORPHAN_CASE", "escalation", "case"),
    ):
        joined = f"bad_{child} x left join bad_{parent} y on y.id = x.{key}"
        parts.append(_issue("count(*) filter (y.entity_id is null)", joined, child, key, error, f" {noun}(s) reference unknown {what} IDs"))
        parts.append(_issue("count(*) filter (y.entity_id <> x.entity_id)", joined, child, key, "ENTITY_MISMATCH", f" {noun}(s) reference {what}s owned by another entity"))
    return " union all ".join(parts)


def _temporal_issues() -> str:
    kind = "IMPOSSIBLE_TIMESTAMP"
    case_join = "bad_cases x join bad_alerts y on y.id = x.alert_id"
    escalation_join = "bad_escalations x join bad_cases y on y.id = x.case_id"
    return " union all ".join([
        _issue("count(*) filter (acknowledged_at < timestamp)", "bad_alerts", "alerts", "acknowledged_at", kind, " acknowledgement timestamp(s) precede the alert"),
        _issue("count(*) filter (closed_at < timestamp)", "bad_alerts", "alerts", "closed_at", kind, " closure timestamp(s) precede the alert"),
        _issue("count(*) filter (closed_at < acknowledged_at)", "bad_alerts", "alerts", "closed_at", kind, " closure timestamp(s) precede acknowledgement"),
        _issue("count(*) filter (closed_at < opened_at)", "bad_cases", "cases", "closed_at", kind, " case closure timestamp(s) precede opening"),
        _issue("count(*) filter (x.opened_at < y.timestamp)", case_join, "cases", "opened_at", kind, " case(s) open before their alert"),
        _issue("count(*) filter (x.opened_at < y.acknowledged_at)", case_join, "cases", "opened_at", kind, " case(s) open before acknowledgement"),
        _issue("count(*) filter (x.created_at < y.opened_at)", escalation_join, "escalations", "created_at", kind, " escalation(s) precede case opening"),
        _issue("count(*) filter (x.created_at > y.closed_at)", escalation_join, "escalations", "created_at", kind, " escalation(s) occur after case closure"),
    ])


def _audit() -> str:
    def check(name: str, count: str, origin: str) -> str:
        return f"select {quote(name)} as \"check\", cast({count} as bigint) as violations from {origin}"

    duplicates = " + ".join(f"(select count(*) - count(distinct id) from bad_{name})" for name in catalog.DATASETS)
    categories = " + ".join(
        f"(select count(*) from bad_{dataset} where not coalesce({field} in ({', '.join(quote(value) for value in allowed)}), false))"
        for (dataset, field), allowed in catalog.AUDIT_DOMAINS.items()
    )
    cases = "bad_cases c left join bad_alerts a on a.id = c.alert_id"
    escalations = "bad_escalations e left join bad_cases c on c.id = e.case_id"
    return " union all ".join([
        check("duplicate_id", duplicates, "(select 1)"),
        check("invalid_category", categories, "(select 1)"),
        check("orphan_asset_entity", "count(*)", "bad_assets s where not exists (select 1 from bad_entities e where e.id = s.entity_id)"),
        check("alert_relationship", "count(*) filter (e.id is null or s.entity_id is distinct from a.entity_id)",
              "bad_alerts a left join bad_assets s on s.id = a.asset_id left join bad_entities e on e.id = a.entity_id"),
        check("alert_missing_case", "count(*)", "bad_alerts a where case_id is not null and not exists (select 1 from bad_cases c where c.id = a.case_id)"),
        check("alert_acknowledged_early", "count(*) filter (acknowledged_at < timestamp)", "bad_alerts"),
        check("alert_closed_early", "count(*) filter (closed_at < acknowledged_at)", "bad_alerts"),
        check("case_relationship", "count(*) filter (a.entity_id is distinct from c.entity_id or a.case_id is distinct from c.id or coalesce(c.opened_at < a.timestamp, false))", cases),
        check("case_closed_early", "count(*) filter (closed_at < opened_at)", "bad_cases"),
        check("escalation_relationship", "count(*) filter (c.entity_id is distinct from e.entity_id or coalesce(e.created_at < c.opened_at, false))", escalations),
        check("escalation_lifecycle", "count(*) filter (not coalesce(c.escalated, false) or coalesce(e.created_at > c.closed_at, false))", escalations),
        check("escalation_sets_differ",
              "(select count(*) from (select distinct id from bad_cases where escalated) c where not exists (select 1 from bad_escalations e where e.case_id = c.id)) "
              "+ (select count(*) from (select distinct case_id from bad_escalations) e where not exists (select 1 from bad_cases c where c.id = e.case_id and c.escalated))",
              "(select 1)"),
    ])


_DIMENSION_FIELDS = ", ".join(field for _, field, _ in _FIELDS)
_RISK_COLUMNS = (
    f"entity_id, {_DIMENSION_FIELDS}, cast(overall_score as double) as overall_score, risk_band, assessment_coverage, assessable_dimensions, "
    "total_dimensions, evidence_strength_summary, corroboration_summary, top_risk_dimension, top_reason, supporting_finding_count"
)
_BANDS = ", ".join(f"count(*) filter (risk_band = '{name}') as {name.lower()}_entities" for name, _, _ in catalog.RISK_BANDS)


def _json(columns: tuple[str, ...], numeric: tuple[str, ...], renamed: dict[str, str]) -> str:
    parts = []
    for place, name in enumerate(columns):
        column = renamed.get(name, name)
        text = f"coalesce(cast({column} as varchar), '{'null' if name in numeric else 'None'}')"
        if name not in numeric:
            text = f"""'"' || replace(replace({text}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""
        parts.append(f"""'{"{" if place == 0 else ","}"{name}":' || {text}""")
    return "sha256(" + " || ".join(parts) + " || '}')"


_FINDING_HASH = _json(catalog.FINDING_DIGEST_FIELDS, ("expected_value", "observed_value"), {"finding_id": "id"})
_EVIDENCE_HASH = _json(catalog.EVIDENCE_DIGEST_FIELDS, (), {})
STEPS["commitment"] = f"""
select id as record_id, 'FINDING' as record_type, entity_id, {_FINDING_HASH} as content_hash, cast(null as varchar) as manifest_hash,
 cast(null as varchar) as finding_id, source_phase, rule_id as detector_id, cast(null as varchar) as period, v.created_at, 'SUPERVISOR' as registered_by, v.version
from findings f join (values ('2024-07-01 00:00:00.000000', cast(1 as bigint)), ('2024-08-01 00:00:00.000000', cast(2 as bigint))) v(created_at, version)
 on f.source_phase <> 'phase8' and (v.version = 1 or f.source_phase = 'phase6')
"""
STEPS["tampered"] = "select * replace (case when rule_id = 'R002' then 'Low' else severity end as severity) from findings"
STEPS["why_top"] = """
select a.entity_id, a.top_risk_dimension, arg_min(g.group_id, g.group_position) as correlation_group, arg_min(g.description, g.group_position) as description
from assessed a join group_text g on g.dimension = a.top_risk_dimension group by 1, 2
"""
STEPS["group_text"] = "select * from (values " + ", ".join(
    f"({quote(group)}, {place}, {quote(dimension)}, {quote(text)})" for place, (group, dimension, _, _, text) in enumerate(catalog.CORRELATION_GROUPS)
) + ") t(group_id, group_position, dimension, description)"
STEPS["why_pick"] = """
select w.entity_id, w.top_risk_dimension, w.correlation_group, w.description,
 (select string_agg(distinct c.source_phase, '|' order by c.source_phase) from contribution c where c.entity_id = w.entity_id
   and c.detector_id in (select detector_id from membership m where m.group_id = w.correlation_group)) as phases,
 (select string_agg(distinct c.detector_id, '|' order by c.detector_id) from contribution c where c.entity_id = w.entity_id
   and c.detector_id in (select detector_id from membership m where m.group_id = w.correlation_group)) as detectors,
 (select arg_min(c.corroboration_group, (case when c.corroboration_group = w.correlation_group then 0 when c.dimension = w.top_risk_dimension then 1 else 2 end, c.dimension, c.id))
   from contribution c where c.entity_id = w.entity_id) as top_group
from why_top w
"""


def _finals() -> dict[str, str]:
    finals = {f"canonical_{name}": _with_text_times(name, _TIMES[name]) for name in catalog.DATASETS}
    n = "cast(right(trim(case_id), 9) as bigint)"
    finals["normalize_text_bool_datetime"] = f"""
select trim(case_id) as id, entity_id, alert_id, case when {n} % 31 = 0 then null else {stamp(f"case when {n} % 29 = 0 then cast(substr(opened_at, 1, 10) as timestamp) else cast(replace(replace(opened_at, 'T', ' '), 'Z', '') as timestamp) end")} end as opened_at,
 investigation_notes as investigation_text, trim(disposition) as disposition,
 case {n} % 7 when 1 then true when 2 then false when 3 then true when 4 then false when 5 then false end as escalated,
 remediation_recorded = '1' as remediation_recorded, {stamp("cast(replace(replace(closed_at, 'T', ' '), 'Z', '') as timestamp)")} as closed_at
from (select * replace (case when opened_at = 'not-a-date' then null else opened_at end as opened_at) from raw_cases) r
"""
    finals["normalize_alerts"] = (
        f"select id, entity_id, asset_id, case when cast(right(id, 9) as bigint) % 37 <> 0 then {stamp('timestamp')} end as timestamp, severity, source, cast(null as varchar) as acknowledged_at, cast(null as varchar) as closed_at, status, "
        "cast(null as varchar) as case_id from alerts"
    )
    finals["normalize_issues"] = " union all ".join([
        "select 'cases' as dataset, 'analyst' as field, 'UNKNOWN_COLUMN' as error_type, 'Unknown column retained but ignored: analyst' as message, 'warning' as severity",
        _issue("count(*) filter (opened_at = 'not-a-date')", "raw_cases", "cases", "opened_at", "INVALID_TIMESTAMP", " value(s) in opened_at are not parseable timestamps"),
        _issue("count(*) filter (escalated_flag = 'maybe')", "raw_cases", "cases", "escalated", "INVALID_BOOLEAN", " value(s) in escalated are not valid booleans"),
    ])
    frame, references, times = _frame_issues(), _reference_issues(), _temporal_issues()
    finals.update({"validate_frame_issues": frame, "validate_references": references, "validate_temporal": times})
    rows = " + ".join(f"(select count(*) from bad_{name})" for name in catalog.DATASETS)
    finals["quality_report"] = f"""
select 'failed' as status, cast(5 as bigint) as files, {rows} as total_rows, count(*) as errors, cast(0 as bigint) as warnings,
 'Validation failed: ' || count(*) || ' error(s), 0 warning(s), ' || ({rows}) || ' row(s) across 5 file(s).' as summary
from ({frame} union all {references} union all {times}) issues
"""
    finals["report_lines"] = (
        f"select cast(1 as bigint) as block, summary as line from ({finals['quality_report']}) q union all "
        + " union all ".join(f"select 2, '- {name}: ' || count(*) || ' rows' from bad_{name}" for name in catalog.DATASETS)
        + " union all select 3, '- ' || upper(severity) || ' [' || dataset || coalesce(' ' || field, '') || '] ' || message "
        f"from ({frame} union all {references} union all {times}) issues"
    )
    finals["integrity_audit"] = _audit()
    finals["alert_features"] = _with_text_times("alert_f", _TIMES["alerts"])
    finals["case_features"] = _with_text_times("case_f", _TIMES["cases"])
    finals["asset_features"] = _with_text_times("asset_f", ("last_alert_at",))
    finals["entity_features"] = _with_text_times("entity_f", ("created_at",))
    finals["entity_month_features"] = "select * from month_f"
    finals["recent_alert_count"] = f"select asset_id, {stamp('a.timestamp')} as timestamp, max(r.n) as asset_recent_alert_count from alerts a join recent r on r.id = a.id group by asset_id, a.timestamp"
    finals["time_features"] = f"""
select id, {stamp('timestamp')} as timestamp, cast(year(timestamp) as bigint) as year, cast(month(timestamp) as bigint) as month, cast(week(timestamp) as bigint) as week,
 cast(isodow(timestamp) as bigint) as day_of_week, cast(hour(timestamp) as bigint) as hour, strftime(timestamp, '%Y-%m-%d') as date from alerts
"""
    for phase, label in (("phase5", "rule"), ("phase6", "gap"), ("phase7", "absence"), ("phase8", "peer")):
        finals[f"{label}_findings_all"] = f"select {_F_COLUMNS} from {label}_findings"
        finals[f"{label}_evidence_all"] = f"select {', '.join(EVIDENCE_COLUMNS)} from {label}_evidence"
        for name in catalog.enabled(phase):
            if name != "AN001":
                finals[f"{label}_{name.lower()}"] = f"select {_F_COLUMNS} from {name}"
    finals["population_median"] = "select *, 'EG002' as detector_id from ref_eg002 union all select *, 'EG003' from ref_eg003"
    finals["observation_window"] = f'select {stamp("start")} as start, {stamp(chr(34) + "end" + chr(34))} as "end", sufficient, reason from obs'
    finals["source_prevalence"] = "select * from prevalence"
    finals["cohorts"] = "select cohort_key, sector, size, criticality, count(*) as entity_count from keyed group by all having count(*) >= 3"
    finals["cohort_members"] = "select cohort_key, entity_id from keyed where cohort_key in (select cohort_key from keyed group by 1 having count(*) >= 3)"
    finals["benchmark_table"] = f"select * replace ({rounded('peer_mean', 6)} as peer_mean, {rounded('peer_std', 6)} as peer_std) from benchmark"
    finals["peer_reference_values"] = "select entity_id, cohort_key, metric_name, value from peer_long"
    finals["anomaly_profile"] = "select feature, missing_share, cast(distinct_values as bigint) as distinct_values, median, is_usable from anomaly_profile"
    finals["anomaly_matrix"] = "select entity_id, " + ", ".join(
        f"case when (select is_usable from anomaly_profile where feature = '{name}') then coalesce(cast({name} as double), (select median from anomaly_profile where feature = '{name}')) end as {name}"
        for name in catalog.ANOMALY_FEATURES
    ) + " from entity_f"
    finals["anomaly_sample"] = "select cast(tree as bigint) as tree, entity_id from forest_sample"
    finals["anomaly_scores"] = f"select entity_id, {rounded('score', 9)} as score from forest_score"
    finals["anomaly_flags"] = f"select entity_id, {rounded('anomaly_score', 9)} as anomaly_score, anomaly_rank from forest_flag where anomaly_score < 0"
    finals["anomaly_an001"] = f"select {', '.join('f.' + name for name in FINDING_COLUMNS)}, a.anomaly_score, a.anomaly_rank from AN001 f join hit_AN001 a using (entity_id)"
    finals["signals"] = "select * exclude (features) from signal"
    finals["correlation_groups"] = (
        "select entity_id, group_id, dimension, base_value, primary_detector, replace(phases, ', ', '|') as corroborating_phases, severity, assessment_strength, "
        "evidence_strength, supporting_finding_count, corroboration_boost, final_value, corroboration_level, replace(detectors, ', ', '|') as participating_detectors, rationale from groups"
    )
    finals["risk_contributions"] = "select * from contribution"
    finals["contribution_findings"] = "select entity_id, group_id, cast(detector_position as bigint) as detector_position, detector_id, finding_id from links"
    finals["dimension_scores"] = "select * from dims"
    finals["entity_risk"] = f"select {_RISK_COLUMNS} from assessed"
    finals["review_queue"] = "select * from queue"
    finals["portfolio_kpis"] = (
        f"select count(*) as entities, {_BANDS}, {rounded('avg(assessment_coverage)', 6)} as average_coverage, count(*) filter (assessment_coverage = 1) as fully_assessable, "
        "count(*) filter (assessment_coverage <> 1) as partially_assessable from assessed"
    )
    finals["sector_averages"] = f"select sector, {rounded('avg(overall_score)')} as average_score, count(*) as entities from enriched group by sector"
    finals["dimension_averages"] = " union all ".join(
        f"select '{name}' as dimension, {rounded(f'avg(coalesce({field}, 0))', 1)} as average_score from assessed" for name, field, _ in _FIELDS
    )
    finals["distinct_sectors"] = "select distinct sector from enriched"
    finals["elevated_dimensions"] = "select entity_id, row_number() over (partition by entity_id order by score desc, place) as position, dimension, score from (" + " union all ".join(
        f"select entity_id, '{name}' as dimension, {field} as score, {place} as place from assessed where {field} >= 25" for place, (name, field, _) in enumerate(_FIELDS)
    ) + ") d"
    finals["entity_search"] = (
        "select entity_id, name, sector, size, criticality, cast(overall_score as double) as overall_score, risk_band from enriched "
        "where criticality = 'Medium' and (contains(lower(entity_id), 'build') or contains(lower(name), 'build') or contains(lower(sector), 'build'))"
    )
    finals["queue_by_priority"] = " union all ".join(
        f"select '{name}' as priority, count(*) as items from queue where priority = '{name}'" for name, _ in catalog.PRIORITY_LIMITS
    )
    finals["queue_search"] = (
        "select * from queue where priority = 'HIGH' and record_type = 'FINDING' and (contains(lower(record_id), 'remediation') "
        "or contains(lower(entity_id), 'remediation') or contains(lower(reason), 'remediation'))"
    )
    finals["queue_headings"] = """
select rank, record_id, regexp_replace(trim(split_part(reason, ':', 1)), '^([^(]*?)\\s*\\(([^)]+)\\)', '\\1 · \\2') as category,
 trim(substr(reason, strpos(reason, ':') + 1)) as title from queue
"""
    finals["top_queue_item"] = "select entity_id, rank, record_type, record_id, priority, priority_score from queue q where rank = (select min(rank) from queue x where x.entity_id = q.entity_id)"
    finals["why_flagged"] = """
select entity_id, top_risk_dimension, correlation_group, description, coalesce(phases, '') as phases, coalesce(detectors, '') as detectors,
 (select arg_min(l.finding_id, (l.detector_position, l.finding_id)) from links l where l.entity_id = w.entity_id and l.group_id = w.top_group) as primary_finding_id
from why_pick w where top_group is not null
"""
    finals["finding_detail"] = (
        "select f.id as finding_id, f.rule_id, f.entity_id, f.source_phase, f.severity, f.title, e.id as evidence_id, e.source_type, e.source_id, e.field, e.value, e.reason "
        "from findings f left join evidence e on e.finding_id = f.id"
    )
    finals["finding_lookup"] = f"select * from ({finals['finding_detail']}) d where finding_id = (select min(id) from findings)"
    finals["entity_contributions"] = "select * from contribution where entity_id = (select min(entity_id) from contribution)"
    finals["finalized_findings"] = f"select {_F_COLUMNS} from (select * replace (title || ' (again)' as title) from findings) f"
    finals["finalized_evidence"] = f"select {', '.join(EVIDENCE_COLUMNS)} from evidence"
    listed = ", ".join(
        f"({quote(name)}, {quote(item['phase'])}, {quote(item['name'])}, {quote(item['finding_type'])}, {quote(item['severity'])}, {str(item.get('enabled', True)).lower()})"
        for name, item in catalog.DETECTORS.items()
    )
    finals["detector_report"] = (
        f"select d.*, (select count(*) from findings f where f.rule_id = d.detector_id) as findings from (values {listed}) d(detector_id, phase, name, finding_type, severity, enabled)"
    )
    finals["run_report"] = "select source_phase, rule_id, severity, baseline_method, count(*) as findings from findings group by all"
    finals["run_summary"] = (
        "select f.source_phase, count(*) as findings, count(distinct rule_id) as detectors, count(distinct f.entity_id) as entities, "
        "max(x.n) as evidence from findings f join (select g.source_phase, count(*) as n from evidence e join findings g on g.id = e.finding_id group by 1) x "
        "on x.source_phase = f.source_phase group by 1"
    )
    finals["entities_benchmarked"] = "select count(distinct entity_id) as entities_benchmarked from peer_findings where rule_id <> 'AN001'"
    finals["dossier_inventory"] = (
        "select entity_id, id, rule_id, source_phase, finding_type, severity, evidence_strength, title, summary, rationale, observed_value, baseline_value, gap_value from findings"
    )
    finals["dossier_dimensions"] = " union all ".join(
        f"select entity_id, '{name}' as dimension, {field} as score, cast({weight} as double) as weight, coalesce({rounded(f'{field} * {weight}')}, 0.0) as weighted_contribution, "
        f"{field} is not null as is_assessable, case when {field} is null then 'Not Assessable (Missing Telemetry Denominator)' else 'Assessable' end as status from assessed"
        for name, field, weight in _FIELDS
    )
    finals["dossier_summary"] = """
select 'SED-' || r.entity_id || '-20240101' as dossier_id, r.entity_id, 'Supervisory Examination Dossier — ' || r.entity_id as title, coalesce(e.name, r.entity_id) as name,
 e.sector, e.size, e.criticality, e.total_assets, e.alert_count as total_alerts, e.case_count as total_cases, r.overall_score, r.risk_band, r.top_risk_dimension,
 q.rank as review_queue_rank, q.priority_score as review_priority_score, coalesce(q.priority, 'LOW') as review_urgency,
 (select count(*) from findings f where f.entity_id = r.entity_id) as finding_count,
 nullif((select count(*) from contribution c where c.entity_id = r.entity_id), 0) as contribution_count
from assessed r left join entity_f e on e.entity_id = r.entity_id
left join (select * from queue x where rank = (select min(rank) from queue y where y.entity_id = x.entity_id)) q on q.entity_id = r.entity_id
"""
    finals["finding_digest"] = f"select id as record_id, 'FINDING' as record_type, entity_id, {_FINDING_HASH} as content_hash, source_phase, rule_id as detector_id from findings"
    finals["evidence_digest"] = f"select id as record_id, 'EVIDENCE' as record_type, entity_id, {_EVIDENCE_HASH} as content_hash, finding_id from evidence"
    finals["commitment_history"] = "select * from commitment"
    finals["commitment_latest"] = "select * from commitment c where version = (select max(version) from commitment x where x.record_id = c.record_id)"
    finals["commitment_verify"] = f"""
select t.id as record_id, case when c.version is null then 'NOT_REGISTERED' when c.content_hash = t.local_hash then 'VERIFIED' else 'MISMATCH' end as status,
 t.local_hash, c.content_hash as registered_hash, c.version, case when c.version is null then 'Record ' || t.id || ' has no registered commitment'
  when c.content_hash = t.local_hash then 'Local SHA-256 matches the registered commitment' else 'Integrity mismatch: local record differs from the registered commitment' end as message
from (select *, {_FINDING_HASH} as local_hash from tampered) t
left join (select * from commitment x where version = (select max(version) from commitment y where y.record_id = x.record_id)) c on c.record_id = t.id
"""
    return finals


TABLE_DIGESTS = """
with parts as (select lang as file, cast(doc_id as varchar) as part, sha256(text) as digest from documents),
buckets as (
  select file, substr(sha256(part), 1, 3) as bucket, count(*) as parts, max(digest) as one, sha256(string_agg(digest, '' order by part)) as digest
  from parts group by all
)
select file, case when sum(parts) = 1 then max(one) else sha256(string_agg(digest, '' order by bucket)) end as sha256 from buckets group by file
"""


def oracle_queries() -> dict[str, str]:
    return {name: compose(text) for name, text in _finals().items()} | {"table_digests": TABLE_DIGESTS}
