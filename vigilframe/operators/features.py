"""Alert, case, asset, entity and entity-month features from the canonical tables.

Every aggregation combines on the map side before it shuffles, so an entity, asset or source that holds a large
share of all rows never lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from vigilframe import catalog
from vigilframe.functions.measures import lookup, safe_rate, whole_days, whole_minutes, zero_if_null

# The trailing window is cut into this many equal slices; a slice of one asset is the unit of work of one task.
WINDOW_SLICES = 720
# Stands for a missing time where a join needs a value.
NO_MOMENT = -(1 << 63)


# --- alerts ---------------------------------------------------------------------------------------------------


def alert_flags(alerts: DataFrame) -> DataFrame:
    """Row-level alert features; needs no shuffle."""
    return alerts.withColumns(
        {
            "acknowledgement_minutes": whole_minutes(F.col("acknowledged_at"), F.col("timestamp")),
            "alert_lifetime_minutes": whole_minutes(F.col("closed_at"), F.col("timestamp")),
            "has_case": F.col("case_id").isNotNull(),
            "is_closed": (F.col("status") == "Closed") | F.col("closed_at").isNotNull(),
            "severity_rank": lookup(catalog.SEVERITY_RANK, F.col("severity")).cast("long"),
            "is_high_or_critical": F.col("severity").isin("High", "Critical"),
            "is_critical": F.col("severity") == "Critical",
        }
    )


def asset_alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts and distinct sources per asset; a null source counts as one value."""
    return alerts.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("asset_alert_count"),
        (F.count_distinct("source") + F.max(F.col("source").isNull().cast("long"))).alias(
            "asset_distinct_alert_sources"
        ),
    )


def trailing_sum(value: Column, window: WindowSpec, back: int, ahead: int = 0) -> Column:
    """Sum over the range from ``back`` before to ``ahead`` after the current order value.

    Taken as the difference of two sums from the start: Spark extends such a frame row by row, while it adds up a
    frame with a moving start anew for every row.
    """
    upto = F.sum(value).over(window.rangeBetween(Window.unboundedPreceding, ahead))
    before = F.sum(value).over(window.rangeBetween(Window.unboundedPreceding, -back - 1))
    return F.coalesce(upto, F.lit(0)) - F.coalesce(before, F.lit(0))


def sliced_alert_counts(alerts: DataFrame, days: int = catalog.RECENT_WINDOW_DAYS) -> DataFrame:
    """Alerts of the same asset within the ``days`` before each (asset_id, timestamp), both ends included.

    No task sorts an asset's whole history, as a range window over assets would need. Time is cut into slices and the trailing count is put together from three parts: the own slice up to the alert, the whole
    slices in between, and the end of the slice the window starts in. The first and last part are windows over
    one slice, the middle one is a window over slice totals, whose number is bounded by the length of the
    history.
    """
    window_micros = days * 86_400_000_000
    width = window_micros // WINDOW_SLICES
    moments = (
        alerts.filter(F.col("asset_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("asset_id", "timestamp")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .withColumn("micros", F.unix_micros(F.col("timestamp").cast("timestamp")))
        .withColumn("position", F.pmod(F.col("micros"), F.lit(width)))
        .withColumn("slice", F.floor((F.col("micros") - F.col("position")) / F.lit(width)).cast("long"))
    )
    by_slice = Window.partitionBy("asset_id").orderBy("slice")
    whole_slices = (
        moments.groupBy("asset_id", "slice")
        .agg(F.sum("alerts").alias("total"))
        .select("asset_id", "slice", trailing_sum(F.col("total"), by_slice, WINDOW_SLICES - 1, -1).alias("whole"))
    )
    own = F.struct(F.col("slice"), F.col("alerts").alias("weight"), F.lit(True).alias("is_own"))
    edge = F.struct(
        (F.col("slice") - WINDOW_SLICES).alias("slice"), F.lit(0).cast("long").alias("weight"),
        F.lit(False).alias("is_own"),
    )
    points = moments.select("asset_id", "timestamp", "position", F.inline(F.array(own, edge)))
    in_slice = Window.partitionBy("asset_id", "slice").orderBy("position")
    upto = F.sum("weight").over(in_slice.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(F.sum("weight").over(in_slice.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Total minus what lies before: a frame up to the end of the partition would rescan it for every row.
    onward = F.sum("weight").over(Window.partitionBy("asset_id", "slice")) - before
    return (
        points.withColumn("part", F.when(F.col("is_own"), upto).otherwise(onward))
        .join(whole_slices, ["asset_id", "slice"], "left")
        .groupBy("asset_id", "timestamp")
        .agg(
            F.sum(F.col("part") + F.when(F.col("is_own"), F.col("whole")).otherwise(F.lit(0))).alias(
                "asset_recent_alert_count"
            )
        )
    )


def alert_features(alerts: DataFrame, days: int = catalog.RECENT_WINDOW_DAYS) -> DataFrame:
    """One row per alert, with the asset's total, distinct sources and trailing count.

    What an alert needs to know of its asset is put together per (asset, moment) from counts, and joined to the wide
    rows once, by both: a busy asset's alerts are spread by their times. Alerts without an asset take no part in any
    shuffle.
    """
    flagged = alert_flags(alerts)
    per_asset = asset_alert_counts(alerts).filter(F.col("asset_id").isNotNull())
    moment = F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(NO_MOMENT).cast("long"))
    counts = sliced_alert_counts(alerts, days).select("asset_id", moment.alias("_moment"), "asset_recent_alert_count")
    undated = per_asset.select("asset_id", F.lit(NO_MOMENT).cast("long").alias("_moment"), F.lit(0).cast("long").alias("asset_recent_alert_count"))
    facts = counts.unionByName(undated).join(per_asset, "asset_id")
    columns = [
        *alerts.columns, "asset_alert_count", "asset_distinct_alert_sources", "asset_recent_alert_count",
        "acknowledgement_minutes", "alert_lifetime_minutes", "has_case", "is_closed", "severity_rank",
        "is_high_or_critical", "is_critical",
    ]
    assigned = flagged.filter(F.col("asset_id").isNotNull()).withColumn("_moment", moment).join(facts, ["asset_id", "_moment"])
    unassigned = flagged.filter(F.col("asset_id").isNull()).withColumns({
        "asset_alert_count": F.lit(None).cast("long"), "asset_distinct_alert_sources": F.lit(None).cast("long"),
        "asset_recent_alert_count": F.lit(0).cast("long"),
    })
    return assigned.select(*columns).unionByName(unassigned.select(*columns))


# --- cases ----------------------------------------------------------------------------------------------------


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda word: word != "")).cast("long")


def case_features(cases: DataFrame, escalations: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """One row per case; with ``alerts`` also the severity of the alert behind the case."""
    first_escalation = escalations.groupBy("case_id").agg(F.min("created_at").alias("escalated_at"))
    text = F.coalesce(F.col("investigation_text"), F.lit(""))
    minutes = whole_minutes(F.col("closed_at"), F.col("opened_at"))
    result = (
        cases.join(first_escalation, cases["id"] == first_escalation["case_id"], "left")
        .drop("case_id")
        .withColumns(
            {
                "investigation_minutes": minutes,
                "case_age_at_close_minutes": minutes,
                "is_closed": F.col("closed_at").isNotNull(),
                "escalation_delay_minutes": whole_minutes(F.col("escalated_at"), F.col("opened_at")),
                "is_escalated": F.col("escalated").cast("boolean"),
                "is_remediated": F.col("remediation_recorded").cast("boolean"),
                "investigation_text_length": F.char_length(text).cast("long"),
                "investigation_word_count": _word_count(text),
                "has_investigation_text": F.char_length(text) > 0,
            }
        )
        .drop("escalated_at")
    )
    if alerts is None:
        return result
    severities = alerts.select(F.col("id").alias("alert_id"), "severity")
    return result.join(severities, "alert_id", "left").select(*result.columns, "severity")


# --- assets ---------------------------------------------------------------------------------------------------


def asset_activity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if(F.col("case_id").isNotNull()).alias("case_count"),
        F.max("timestamp").alias("last_alert_at"),
    )


def asset_features(assets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per asset; assets without alerts keep explicit zeros and nulls."""
    activity = asset_activity(alerts).filter(F.col("asset_id").isNotNull()).withColumnRenamed("asset_id", "id")
    reference_time = alerts.agg(F.max("timestamp")).scalar()
    result = (
        assets.join(activity, "id", "left")
        .withColumns({name: zero_if_null(F.col(name)) for name in ("alert_count", "case_count")})
        .withColumns(
            {
                "has_alert_activity": F.col("alert_count") > 0,
                "has_case_activity": F.col("case_count") > 0,
                "expected_monitoring_no_activity": F.col("expected_monitoring") & (F.col("alert_count") == 0),
                "days_since_last_alert": whole_days(reference_time, F.col("last_alert_at")),
            }
        )
    )
    totals = result.groupBy("entity_id").agg(F.sum("alert_count").alias("entity_alert_count"))
    share = safe_rate(F.col("alert_count"), F.col("entity_alert_count"))
    return result.join(totals, "entity_id", "left").select(
        *result.columns, share.alias("asset_alert_rate_relative_to_entity")
    )


# --- entities -------------------------------------------------------------------------------------------------

ALERT_COUNTS = (
    "alert_count", "alerts_with_cases", "open_alert_count", "closed_alert_count", "low_alert_count",
    "medium_alert_count", "high_alert_count", "critical_alert_count",
)
CASE_COUNTS = (
    "case_count", "closed_case_count", "escalated_case_count", "non_escalated_case_count",
    "critical_escalated_case_count", "critical_case_count", "critical_closed_case_count", "remediated_case_count",
    "non_remediated_case_count", "rapid_closure_count", "critical_rapid_closure_count",
)
ASSET_COUNTS = (
    "total_assets", "expected_monitored_assets", "expected_monitored_assets_with_activity",
    "expected_monitored_assets_without_activity", "assets_with_alert_activity", "critical_assets",
    "critical_assets_with_activity", "repeat_alert_asset_count",
)
ENTITY_RATES = (
    ("case_rate", "case_count", "alert_count"),
    ("escalation_rate", "escalated_case_count", "case_count"),
    ("critical_escalation_rate", "critical_escalated_case_count", "critical_case_count"),
    ("critical_rapid_closure_rate", "critical_rapid_closure_count", "critical_closed_case_count"),
    ("remediation_rate", "remediated_case_count", "closed_case_count"),
    ("rapid_closure_rate", "rapid_closure_count", "closed_case_count"),
    ("repeat_alert_event_rate", "repeat_alert_event_count", "alert_count"),
    ("repeat_alert_asset_rate", "repeat_alert_asset_count", "assets_with_alert_activity"),
    ("cases_per_asset", "case_count", "total_assets"),
    ("alerts_per_asset", "alert_count", "total_assets"),
    ("monitoring_coverage_rate", "expected_monitored_assets_with_activity", "expected_monitored_assets"),
    ("critical_asset_activity_rate", "critical_assets_with_activity", "critical_assets"),
)


def _alert_metrics(alerts: DataFrame) -> DataFrame:
    severity = F.col("severity")
    return alerts.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if(F.col("case_id").isNotNull()).alias("alerts_with_cases"),
        F.count_if(~F.col("is_closed")).alias("open_alert_count"),
        F.count_if(F.col("is_closed")).alias("closed_alert_count"),
        *[F.count_if(severity == name).alias(f"{name.lower()}_alert_count") for name in catalog.SEVERITY_RANK],
        F.avg(F.col("is_critical").cast("int")).alias("critical_alert_rate"),
        F.avg(F.col("is_high_or_critical").cast("int")).alias("high_critical_alert_rate"),
    )


def _repeat_events(alerts: DataFrame) -> DataFrame:
    """Alerts on assets with more than one alert, per entity, from pre-aggregated (entity, asset) counts."""
    pairs = alerts.groupBy("entity_id", "asset_id").agg(F.count(F.lit(1)).alias("alerts"))
    totals = pairs.groupBy("asset_id").agg(F.sum("alerts").alias("asset_alert_count"))
    return (
        pairs.join(totals.filter(F.col("asset_alert_count") > 1), "asset_id", "left_semi")
        .groupBy("entity_id")
        .agg(F.sum("alerts").alias("repeat_alert_event_count"))
    )


def _case_metrics(cases: DataFrame) -> DataFrame:
    critical = F.col("severity") == "Critical"
    closed, escalated, remediated = F.col("is_closed"), F.col("is_escalated"), F.col("is_remediated")
    minutes = F.col("investigation_minutes")
    rapid = closed & (minutes <= catalog.RAPID_CLOSURE_MINUTES)
    return cases.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(closed).alias("closed_case_count"),
        F.count_if(escalated).alias("escalated_case_count"),
        F.count_if(~escalated).alias("non_escalated_case_count"),
        F.count_if(escalated & critical).alias("critical_escalated_case_count"),
        F.count_if(critical).alias("critical_case_count"),
        F.count_if(critical & closed).alias("critical_closed_case_count"),
        F.avg(F.when(critical, minutes)).alias("critical_mean_investigation_minutes"),
        F.median(F.when(critical, minutes)).alias("critical_median_investigation_minutes"),
        F.count_if(remediated & closed).alias("remediated_case_count"),
        F.count_if(~remediated & closed).alias("non_remediated_case_count"),
        F.avg(minutes).alias("mean_investigation_minutes"),
        F.median(minutes).alias("median_investigation_minutes"),
        F.count_if(rapid).alias("rapid_closure_count"),
        F.count_if(critical & rapid).alias("critical_rapid_closure_count"),
    )


def _asset_metrics(assets: DataFrame) -> DataFrame:
    active, expected = F.col("has_alert_activity"), F.col("expected_monitoring")
    important = F.col("criticality").isin("High", "Critical")
    return assets.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.count_if(expected).alias("expected_monitored_assets"),
        F.count_if(active & expected).alias("expected_monitored_assets_with_activity"),
        F.count_if(expected & ~active).alias("expected_monitored_assets_without_activity"),
        F.count_if(active).alias("assets_with_alert_activity"),
        F.count_if(important).alias("critical_assets"),
        F.count_if(important & active).alias("critical_assets_with_activity"),
        F.count_if(F.col("alert_count") > 1).alias("repeat_alert_asset_count"),
    )


def entity_features(entities: DataFrame, alerts: DataFrame, cases: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per entity. ``alerts`` needs the row-level flags only, not the per-asset counts."""
    counts = (*ALERT_COUNTS, "repeat_alert_event_count", *CASE_COUNTS, *ASSET_COUNTS)
    joined = (
        entities.withColumnRenamed("id", "entity_id")
        .join(_alert_metrics(alerts), "entity_id", "left")
        .join(_repeat_events(alerts), "entity_id", "left")
        .join(_case_metrics(cases), "entity_id", "left")
        .join(_asset_metrics(assets), "entity_id", "left")
        .withColumns({name: zero_if_null(F.col(name)) for name in counts})
    )
    return joined.withColumns(
        {
            **{name: safe_rate(F.col(top), F.col(bottom)) for name, top, bottom in ENTITY_RATES},
            "distinct_active_assets": F.col("assets_with_alert_activity"),
        }
    )


# --- calendar -------------------------------------------------------------------------------------------------


def time_features(frame: DataFrame, column: str) -> DataFrame:
    """Year, month, ISO week, ISO weekday (Monday = 1), hour and date of a timestamp column."""
    stamp = F.col(column)
    return frame.withColumns(
        {
            "year": F.year(stamp),
            "month": F.month(stamp),
            "week": F.weekofyear(stamp),
            "day_of_week": F.weekday(stamp) + 1,
            "hour": F.hour(stamp),
            "date": F.to_date(stamp),
        }
    )


def entity_month_features(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Alert and case activity per entity and calendar month; only observed months have a row."""
    keys = ["entity_id", "year", "month"]
    minutes = F.col("investigation_minutes")
    alert_months = (
        time_features(alerts, "timestamp")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("alert_count"), F.count_if(F.col("is_critical")).alias("critical_alert_count")
        )
    )
    case_months = (
        time_features(cases, "opened_at")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("case_count"),
            F.count_if(F.col("is_escalated")).alias("escalated_case_count"),
            F.count_if(F.col("is_closed")).alias("investigated_case_count"),
            F.count_if(F.col("is_remediated")).alias("remediated_case_count"),
            F.avg(minutes).alias("mean_investigation_minutes"),
            F.median(minutes).alias("median_investigation_minutes"),
        )
    )
    counts = (
        "alert_count", "critical_alert_count", "case_count", "escalated_case_count", "investigated_case_count",
        "remediated_case_count",
    )
    return alert_months.join(case_months, keys, "full").withColumns(
        {name: zero_if_null(F.col(name)) for name in counts}
    )


def feature_tables(canonical: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> dict[str, DataFrame]:
    """All five feature tables. Entity and month features skip the per-asset alert counts.

    Entity and month features start from the case and asset features. With ``keep`` (``session.stage``) these are
    written once and read from there; without it all tables are lazy.
    """
    flags = alert_flags(canonical["alerts"])
    cases = keep(case_features(canonical["cases"], canonical["escalations"], canonical["alerts"]))
    assets = keep(asset_features(canonical["assets"], canonical["alerts"]))
    return {
        "alert_features": alert_features(canonical["alerts"]),
        "case_features": cases,
        "asset_features": assets,
        "entity_features": entity_features(canonical["entities"], flags, cases, assets),
        "entity_month_features": entity_month_features(flags, cases),
    }
