"""Mapping a raw submission table to its canonical columns and types."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from vigilframe import catalog, schemas

TIME_PATTERNS = ("yyyy-M-d H:m:s[.SSSSSSSSS]", "yyyy-M-d")
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


class Normalized(NamedTuple):
    frame: DataFrame
    issues: DataFrame


class Staged(NamedTuple):
    """A normalised table that was written, its number of rows and its issue rows, all from one pass."""

    frame: DataFrame
    rows: int
    issues: list[tuple]


class _Plan(NamedTuple):
    frame: DataFrame
    selected: list[Column]
    counters: list[Column]
    specs: list[tuple[str, str, str | None, str, str]]
    issues: list[tuple]


def issue(dataset: str, error_type: str, message: str, field: str | None = None, severity: str = "error") -> tuple:
    return (dataset, field, error_type, message, severity)


def issue_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.ISSUES)


def issues_from_counts(counts: DataFrame, specs: list[tuple[str, str, str | None, str, str]]) -> DataFrame:
    """Issue rows from one row of counts.

    Each spec is (count column, dataset, field, error type, message with {count}); a zero count gives no row.
    """
    rows = F.array(
        *[
            F.struct(
                F.col(column).cast("long").alias("count"), F.lit(dataset).alias("dataset"),
                F.lit(field).cast("string").alias("field"), F.lit(error_type).alias("error_type"),
                F.lit(message).alias("template"),
            )
            for column, dataset, field, error_type, message in specs
        ]
    )
    return (
        counts.select(F.inline(rows))
        .filter(F.col("count") > 0)
        .select(
            "dataset", "field", "error_type",
            F.replace("template", F.lit("{count}"), F.col("count").cast("string")).alias("message"),
            F.lit("error").alias("severity"),
        )
    )


def trim_text(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def parse_flag(value: Column) -> Column:
    word = F.lower(trim_text(value.cast("string")))
    return F.when(word.isin(*catalog.TRUE_WORDS), True).when(word.isin(*catalog.FALSE_WORDS), False)


def parse_time(value: Column) -> Column:
    """ISO-like text to a naive timestamp; the first T becomes a space and trailing Zs are dropped."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"^([^T]*)T", "$1 "), "Z+$", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(pattern)) for pattern in TIME_PATTERNS]).cast("timestamp_ntz")


def _unique_columns(frame: DataFrame) -> tuple[DataFrame, bool]:
    names = frame.columns
    if len(names) == len(set(names)):
        return frame, False
    numbered = frame.toDF(*[f"_{place}" for place in range(len(names))])
    first = {name: place for place, name in reversed(list(enumerate(names)))}
    return numbered.select(*[F.col(f"_{first[name]}").alias(name) for name in dict.fromkeys(names)]), True


def normalize(frame: DataFrame, dataset: str) -> Normalized:
    """Canonical columns in canonical order plus the issues met on the way.

    Column-level issues are known from the schema alone; values that cannot be converted are counted in one pass
    and become null.
    """
    plan = _plan(frame, dataset)
    issues = issue_frame(frame.sparkSession, plan.issues)
    if plan.counters:
        issues = issues.unionByName(issues_from_counts(plan.frame.agg(*plan.counters), plan.specs))
    return Normalized(plan.frame.select(*plan.selected), issues)


def normalize_staged(frame: DataFrame, dataset: str, stage: Callable[[DataFrame], DataFrame]) -> Staged:
    """As ``normalize``; rows and values that can't be converted are counted while ``stage`` writes the table."""
    plan = _plan(frame, dataset)
    seen = Observation()
    observed = plan.frame.observe(seen, F.count(F.lit(1)).alias("rows"), *plan.counters)
    written = stage(observed.select(*plan.selected))
    counts = seen.get
    found = [
        issue(dataset, error_type, message.replace("{count}", str(counts[name])), field)
        for name, dataset, field, error_type, message in plan.specs if counts[name]
    ]
    return Staged(written, counts["rows"], plan.issues + found)


def _plan(frame: DataFrame, dataset: str) -> _Plan:
    if dataset not in catalog.REQUIRED_COLUMNS:
        raise ValueError(f"Unsupported dataset type: {dataset}")
    known_issues = []
    frame, repeated = _unique_columns(frame)
    if repeated:
        known_issues.append(issue(dataset, "DUPLICATE_COLUMN", "Input contains duplicate column names"))

    aliases = catalog.COLUMN_ALIASES.get(dataset, {})
    for alias, canonical in aliases.items():
        if alias in frame.columns and canonical in frame.columns:
            known_issues.append(
                issue(dataset, "AMBIGUOUS_ALIAS", f"Both {alias} and {canonical} are present", canonical)
            )
        elif alias in frame.columns:
            frame = frame.withColumnRenamed(alias, canonical)

    required, optional = catalog.REQUIRED_COLUMNS[dataset], catalog.OPTIONAL_COLUMNS[dataset]
    for name in frame.columns:
        if name not in (*required, *optional) and name not in aliases:
            known_issues.append(
                issue(dataset, "UNKNOWN_COLUMN", f"Unknown column retained but ignored: {name}", name, "warning")
            )
    for name in required:
        if name not in frame.columns:
            known_issues.append(
                issue(dataset, "MISSING_REQUIRED_COLUMN", f"Required column is missing: {name}", name)
            )
    for name in optional:
        if name not in frame.columns:
            known_issues.append(
                issue(dataset, "MISSING_OPTIONAL_COLUMN", f"Optional column is missing: {name}", name, "warning")
            )

    selected, counters, specs = [], [], []
    for field in schemas.CANONICAL[dataset]:
        name = field.name
        if name not in frame.columns:
            selected.append(F.lit(None).cast(field.dataType).alias(name))
            continue
        kind, source = frame.schema[name].dataType, F.col(name)
        converted, message, error = None, "", ""
        if name in catalog.DATETIME_COLUMNS[dataset]:
            if isinstance(kind, TIMESTAMPS):
                source = source.cast("timestamp_ntz")
            else:
                text = trim_text(source) if dataset == "entities" and isinstance(kind, T.StringType) else source
                converted, error = parse_time(text), "INVALID_TIMESTAMP"
                message = f"{{count}} value(s) in {name} are not parseable timestamps"
        elif name in catalog.BOOLEAN_COLUMNS[dataset]:
            if not isinstance(kind, T.BooleanType):
                converted, error = parse_flag(source), "INVALID_BOOLEAN"
                message = f"{{count}} value(s) in {name} are not valid booleans"
        elif isinstance(kind, T.StringType):
            source = trim_text(source)
        if converted is not None:
            counters.append(F.count_if(F.col(name).isNotNull() & converted.isNull()).alias(name))
            specs.append((name, dataset, name, error, message))
            source = converted
        selected.append(source.alias(name))

    return _Plan(frame, selected, counters, specs, known_issues)
