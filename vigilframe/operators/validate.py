"""Data-quality checks on canonical tables; every offence becomes an issue row with its count.

All keys of all tables, what refers to them and what single rows fail are counted in one fold over (kind, key); only
checks that compare timestamps of two rows join tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilframe import catalog
from vigilframe.operators.findings import first_rows, union_all
from vigilframe.operators.normalize import issue, issue_frame, issues_from_counts

Bundle = dict[str, DataFrame]


def _type_issues(frame: DataFrame, dataset: str) -> DataFrame:
    """Ids must be text, flags boolean, times timestamps; known from the schema."""
    kinds = {field.name: field.dataType for field in frame.schema}
    checks = (
        (catalog.ID_COLUMNS, (T.StringType,), "strings"),
        (catalog.BOOLEAN_COLUMNS, (T.BooleanType,), "booleans"),
        (catalog.DATETIME_COLUMNS, (T.TimestampType, T.TimestampNTZType, T.NullType), "datetimes"),
    )
    rows = [
        issue(dataset, "INVALID_TYPE", f"Field {name} must contain {label}", name)
        for columns, allowed, label in checks
        for name in columns[dataset]
        if name in kinds and not isinstance(kinds[name], allowed)
    ]
    return issue_frame(frame.sparkSession, rows)


Check = tuple[str, Column, tuple[str, str, str, str]]


def _null_checks(frame: DataFrame, dataset: str) -> list[Check]:
    return [
        (
            f"null_{name}", F.col(name).isNull(),
            (dataset, name, "REQUIRED_NULL", f"{{count}} null value(s) in required field {name}"),
        )
        for name in catalog.REQUIRED_COLUMNS[dataset]
        if name in frame.columns
    ]


def _time_checks(dataset: str) -> list[Check]:
    """Order of the timestamps inside one row."""
    kind = "IMPOSSIBLE_TIMESTAMP"
    closed = F.col("closed_at")
    if dataset == "alerts":
        at, acknowledged = F.col("timestamp"), F.col("acknowledged_at")
        return [
            ("acknowledged_early", acknowledged < at,
             ("alerts", "acknowledged_at", kind, "{count} acknowledgement timestamp(s) precede the alert")),
            ("closed_early", closed < at, ("alerts", "closed_at", kind, "{count} closure timestamp(s) precede the alert")),
            ("closed_unacknowledged", closed < acknowledged,
             ("alerts", "closed_at", kind, "{count} closure timestamp(s) precede acknowledgement")),
        ]
    if dataset == "cases":
        return [
            ("closed_early", closed < F.col("opened_at"),
             ("cases", "closed_at", kind, "{count} case closure timestamp(s) precede opening")),
        ]
    return []


#: What a row of the fold counts: rows of the table the key is of, or references to it from a table.
OWN = "own"
REFERRING = ("assets", "alerts", "cases", "escalations")
FOLDED = (OWN, *REFERRING)


def _events(bundle: Bundle, rows: dict[str, list[Check]], references: bool) -> list[DataFrame]:
    """(kind, key, entity, role) of everything that is counted by key, from one scan of each table.

    A row gives its own key, the keys it refers to, and one event for each check that it fails.
    """
    found = []
    for name, frame in bundle.items():
        def event(kind: str, key: Column, entity: Column, role: str) -> Column:
            return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), entity.cast("string").alias("entity"), F.lit(role).alias("role"))

        nothing, events = F.lit(None), []
        entity = F.col("entity_id") if "entity_id" in frame.columns else nothing
        if "id" in frame.columns:
            events.append(event(name, F.col("id"), entity if name == "assets" else nothing, OWN))
        if references and name in REFERRING and "entities" in bundle and len(bundle) > 1:
            events.append(event("entities", F.col("entity_id"), nothing, name))
        if references and name == "alerts" and "assets" in bundle:
            events.append(event("assets", F.col("asset_id"), entity, name))
        if name in rows:
            events += [F.when(test, event(f"check {name} {check}", nothing, nothing, OWN)) for check, test, _ in rows[name]]
            events += [
                F.when(F.col(field).isNotNull() & ~F.col(field).cast("string").isin(*allowed), event(f"category {name} {field}", F.col(field), nothing, OWN))
                for field, allowed in catalog.CATEGORY_DOMAINS.items() if field in frame.columns
            ]
        if events:
            found.append(frame.select(F.inline(F.array_compact(F.array(*events)))))
    return found


def _folded(bundle: Bundle, rows: dict[str, list[Check]], references: bool) -> DataFrame:
    """One row per (kind, key): rows that have the key, references to it, and pairs of both with the same entity.

    Everything is counted per (kind, key, entity) before it is shuffled, so a key that holds a large share of the rows
    costs a row per task.
    """
    counted = union_all(_events(bundle, rows, references)).groupBy("kind", "key", "entity").agg(
        *[F.count_if(F.col("role") == role).alias(role) for role in FOLDED]
    )
    known = F.col("entity").isNotNull()
    return counted.groupBy("kind", "key").agg(
        *[F.sum(role).alias(role) for role in FOLDED],
        F.sum(F.when(known, F.col(OWN)).otherwise(0)).alias("owned"), F.sum(F.when(known, F.col("alerts")).otherwise(0)).alias("claimed"),
        F.sum(F.when(known, F.col(OWN) * F.col("alerts")).otherwise(0)).alias("agreeing"),
    )


def _fold_issues(bundle: Bundle, rows: dict[str, list[Check]], references: bool = True, own: bool = True) -> DataFrame:
    """Duplicates, unknown references, owners that differ, failed row checks and categories, from one fold of all keys."""
    folded = _folded(bundle, rows, references)
    unknown = F.col("key").isNull() | (F.col(OWN) == 0)
    sums = folded.groupBy("kind").agg(
        F.sum(OWN).alias("rows"), F.sum(F.greatest(F.col(OWN) - 1, F.lit(0))).alias("duplicates"),
        *[F.sum(F.when(unknown, F.col(name)).otherwise(0)).alias(f"unknown_{name}") for name in REFERRING],
        F.sum(F.when(unknown, F.col("alerts")).otherwise(F.col("alerts") * (F.col(OWN) - F.col("owned")))).alias("unowned"),
        F.sum(F.when(unknown, F.lit(0)).otherwise(F.col("owned") * F.col("claimed") - F.col("agreeing"))).alias("foreign"),
    )

    def issue_of(kind: str, count: str, dataset: str, field: str | None, error_type: str, template: str) -> Column:
        return F.struct(
            F.when(F.col("kind") == kind, F.col(count)).alias("count"), F.lit(dataset).alias("dataset"), F.lit(field).cast("string").alias("field"),
            F.lit(error_type).alias("error_type"), F.lit(template).alias("template"),
        )

    found = []
    if own:
        found += [issue_of(name, "duplicates", name, "id", "DUPLICATE_ID", f"{{count}} duplicate {name} ID value(s)") for name, frame in bundle.items() if "id" in frame.columns]
    found += [issue_of(f"check {name} {check}", "rows", *spec) for name, checks in rows.items() for check, _, spec in checks]
    if references:
        found += [
            issue_of("entities", f"unknown_{name}", name, "entity_id", "ORPHAN_ENTITY", "{count} row(s) reference unknown entity IDs")
            for name in REFERRING if name in bundle and "entities" in bundle
        ]
        if _has(bundle, "assets", "alerts"):
            found.append(issue_of("assets", "unowned", "alerts", "asset_id", "ORPHAN_ASSET", "{count} alert(s) reference unknown asset IDs"))
            found.append(issue_of("assets", "foreign", "alerts", "asset_id", "ENTITY_MISMATCH", "{count} alert(s) reference assets owned by another entity"))
    named = sums.select(F.inline(F.array(*found))).where(F.col("count") > 0) if found else None
    parts = [named.select(
        "dataset", "field", "error_type", F.replace("template", F.lit("{count}"), F.col("count").cast("string")).alias("message"),
        F.lit("error").alias("severity"),
    )] if named is not None else []
    if any(name in frame.columns for table, frame in bundle.items() if table in rows for name in catalog.CATEGORY_DOMAINS):
        parts.append(_category_issues(folded.where(F.startswith("kind", F.lit("category ")))))
    return union_all(parts) if parts else issue_frame(folded.sparkSession, [])


def _category_issues(values: DataFrame) -> DataFrame:
    """Values outside a closed domain, up to five of each field named in the message."""
    sample = first_rows(values, ["kind"], ["key"], 5).groupBy("kind").agg(F.array_sort(F.collect_list("key")).alias("values"))
    listed = F.array_join(F.transform("values", lambda item: F.concat(F.lit("'"), item, F.lit("'"))), ", ")
    part = F.split("kind", " ")
    return sample.select(
        part[1].alias("dataset"), part[2].alias("field"), F.lit("INVALID_CATEGORY").alias("error_type"),
        F.concat(F.lit("Unknown "), part[2], F.lit(" value(s): ["), listed, F.lit("]")).alias("message"), F.lit("error").alias("severity"),
    )


def _row_checks(frame: DataFrame, dataset: str, times: bool) -> list[Check]:
    return _null_checks(frame, dataset) + (_time_checks(dataset) if times else [])


def frames_issues(bundle: Bundle, times: bool = False) -> DataFrame:
    """Nulls, types, uniqueness and categories of each table; with ``times`` also the order of a row's timestamps."""
    types = [_type_issues(frame, name) for name, frame in bundle.items()]
    return union_all([_fold_issues(bundle, {name: _row_checks(frame, name, times) for name, frame in bundle.items()}, references=False), *types])


def frame_issues(frame: DataFrame, dataset: str, times: bool = False) -> DataFrame:
    """``frames_issues`` of one table."""
    return frames_issues({dataset: frame}, times)


def _case_alert_join(bundle: Bundle) -> DataFrame:
    """Counts of all case checks that look at the alert behind the case, from one join."""
    alerts = bundle["alerts"].select(
        F.col("id").alias("alert_id"), F.col("entity_id").alias("owner"), F.col("timestamp").alias("alerted"),
        F.col("acknowledged_at").alias("acknowledged"),
    )
    joined = bundle["cases"].select("alert_id", "entity_id", "opened_at").join(alerts, "alert_id", "left")
    return joined.agg(
        F.count_if(F.col("owner").isNull()).alias("orphans"),
        F.count_if(F.col("owner") != F.col("entity_id")).alias("foreign"),
        F.count_if(F.col("opened_at") < F.col("alerted")).alias("early"),
        F.count_if(F.col("opened_at") < F.col("acknowledged")).alias("unacknowledged"),
    )


def _escalation_case_join(bundle: Bundle) -> DataFrame:
    cases = bundle["cases"].select(
        F.col("id").alias("case_id"), F.col("entity_id").alias("owner"), "opened_at", "closed_at"
    )
    joined = bundle["escalations"].select("case_id", "entity_id", "created_at").join(cases, "case_id", "left")
    return joined.agg(
        F.count_if(F.col("owner").isNull()).alias("orphans"),
        F.count_if(F.col("owner") != F.col("entity_id")).alias("foreign"),
        F.count_if(F.col("created_at") < F.col("opened_at")).alias("early"),
        F.count_if(F.col("created_at") > F.col("closed_at")).alias("late"),
    )


CASE_REFERENCES = [
    ("orphans", "cases", "alert_id", "ORPHAN_ALERT", "{count} case(s) reference unknown alert IDs"),
    ("foreign", "cases", "alert_id", "ENTITY_MISMATCH", "{count} case(s) reference alerts owned by another entity"),
]
CASE_TIMES = [
    ("early", "cases", "opened_at", "IMPOSSIBLE_TIMESTAMP", "{count} case(s) open before their alert"),
    ("unacknowledged", "cases", "opened_at", "IMPOSSIBLE_TIMESTAMP", "{count} case(s) open before acknowledgement"),
]
ESCALATION_REFERENCES = [
    ("orphans", "escalations", "case_id", "ORPHAN_CASE", "{count} escalation(s) reference unknown case IDs"),
    ("foreign", "escalations", "case_id", "ENTITY_MISMATCH",
     "{count} escalation(s) reference cases owned by another entity"),
]
ESCALATION_TIMES = [
    ("early", "escalations", "created_at", "IMPOSSIBLE_TIMESTAMP", "{count} escalation(s) precede case opening"),
    ("late", "escalations", "created_at", "IMPOSSIBLE_TIMESTAMP", "{count} escalation(s) occur after case closure"),
]


def _has(bundle: Bundle, *names: str) -> bool:
    return all(name in bundle for name in names)


def _join_issues(bundle: Bundle, references: bool, times: bool) -> list[DataFrame]:
    """Checks that compare a row with the one it refers to, from one join per pair of tables."""
    parts = []
    if _has(bundle, "alerts", "cases"):
        parts.append(issues_from_counts(_case_alert_join(bundle), CASE_REFERENCES * references + CASE_TIMES * times))
    if _has(bundle, "cases", "escalations"):
        parts.append(issues_from_counts(_escalation_case_join(bundle), ESCALATION_REFERENCES * references + ESCALATION_TIMES * times))
    return parts


def reference_issues(bundle: Bundle) -> DataFrame:
    """Foreign keys, for the tables that are present."""
    return union_all([_fold_issues(bundle, {}, own=False), *_join_issues(bundle, references=True, times=False)])


def temporal_issues(bundle: Bundle) -> DataFrame:
    """Order of the lifecycle timestamps, within a table and across tables."""
    within = {name: bundle[name] for name in ("alerts", "cases") if name in bundle}
    parts = [issue_frame(next(iter(bundle.values())).sparkSession, [])]
    for name, frame in within.items():
        checks = _time_checks(name)
        counts = frame.agg(*[F.count_if(test).alias(check) for check, test, _ in checks])
        parts.append(issues_from_counts(counts, [(check, *spec) for check, _, spec in checks]))
    return union_all([*parts, *_join_issues(bundle, references=False, times=True)])


def bundle_issues(bundle: Bundle) -> DataFrame:
    """Every check on whatever tables are present: one fold of all keys and row checks, and one join per pair of tables."""
    rows = {name: _row_checks(frame, name, times=True) for name, frame in bundle.items()}
    types = [_type_issues(frame, name) for name, frame in bundle.items()]
    return union_all([_fold_issues(bundle, rows), *types, *_join_issues(bundle, references=True, times=True)])


def quality_report(issues: DataFrame, bundle: Bundle, files: int, counts: dict[str, int] | None = None) -> DataFrame:
    """One row: status, error and warning counts, rows per table and the summary line.

    ``counts`` are the rows per table where writing the tables has counted them.
    """
    severity = issues.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    if counts is None:
        counted = [
            frame.agg(F.count(F.lit(1)).alias("row_count")).withColumn("dataset", F.lit(name))
            for name, frame in bundle.items()
        ]
    else:
        counted = [issues.sparkSession.createDataFrame(sorted(counts.items()), "dataset string, row_count long")] if counts else []
    totals = union_all(counted).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "row_count")))).alias("rows"),
        F.sum("row_count").alias("total_rows"),
    ) if counted else severity.select(
        F.lit(None).cast("map<string,bigint>").alias("rows"), F.lit(0).cast("long").alias("total_rows")
    )
    status = F.when(F.col("errors") == 0, "passed").otherwise("failed")
    summary = F.concat(
        F.lit("Validation "), F.col("status"), F.lit(": "), F.col("errors"), F.lit(" error(s), "), F.col("warnings"),
        F.lit(" warning(s), "), F.col("total_rows"), F.lit(f" row(s) across {files} file(s)."),
    )
    return (
        severity.withColumn("_totals", totals.select(F.struct("rows", "total_rows")).scalar())
        .select("errors", "warnings", "_totals.*")
        .withColumn("status", status)
        .withColumn("files", F.lit(files))
        .withColumn("summary", summary)
        .select("status", "files", "rows", "total_rows", "errors", "warnings", "summary")
    )


def report_lines(report: DataFrame, issues: DataFrame) -> DataFrame:
    """Human-readable lines in three blocks: summary, rows per table, issues."""
    tables = report.select(F.explode("rows").alias("dataset", "row_count")).select(
        F.lit(2).alias("block"),
        F.concat(F.lit("- "), "dataset", F.lit(": "), F.col("row_count").cast("string"), F.lit(" rows")).alias("line"),
    )
    place = F.concat("dataset", F.coalesce(F.concat(F.lit(" "), "field"), F.lit("")))
    found = issues.select(
        F.lit(3).alias("block"),
        F.concat(F.lit("- "), F.upper("severity"), F.lit(" ["), place, F.lit("] "), "message").alias("line"),
    )
    return report.select(F.lit(1).alias("block"), F.col("summary").alias("line")).unionByName(tables).unionByName(found)


