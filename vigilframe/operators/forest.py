"""Anomaly detector AN001: an isolation forest (Liu, Ting and Zhou, 2008) over entity profiles.

Trees are grown in grouped Python tasks from at most ``FOREST_SAMPLE`` rows each, so the forest has a fixed upper
size whatever the number of entities; the entities are scored in one distributed pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigilframe import catalog, session
from vigilframe.functions.text import render, round_half_even
from vigilframe.operators.findings import Detection, EvidenceItem, first_rows, identify, make_evidence, make_findings
from vigilframe.operators.ordering import exact_medians, global_rank, order_statistics

FEATURES = catalog.ANOMALY_FEATURES
NODE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, depth double"
EULER = 0.5772156649015329
TREES_PER_TASK = 8
SCORE_DIGITS = 9


def column_profile(entities: DataFrame) -> DataFrame:
    """Per feature: null share, distinct values, median, and whether the forest may use it."""
    values = _long(entities)
    rows = entities.agg(F.count(F.lit(1)))
    counts = (
        values.groupBy("feature")
        .agg(F.count("value").alias("present"), F.count_distinct("value").alias("distinct_values"))
        .withColumn("rows", rows.scalar())
    )
    medians = exact_medians(values, ["feature"], "value").select("feature", "median")
    missing = (F.col("rows") - F.col("present")).cast("double") / F.col("rows")
    # A null counts as one more distinct value.
    distinct = F.col("distinct_values") + (F.col("present") < F.col("rows")).cast("int")
    return counts.join(medians, "feature", "left").select(
        "feature", missing.alias("missing_share"), distinct.alias("distinct_values"), "median",
        ((missing <= 0.5) & (distinct > 1)).alias("is_usable"),
    )


def _long(entities: DataFrame) -> DataFrame:
    present = [name for name in FEATURES if name in entities.columns]
    typed = entities.select("entity_id", *[F.col(name).cast("double").alias(name) for name in present])
    return typed.unpivot(["entity_id"], present, "feature", "value")


def anomaly_matrix(entities: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row per entity; usable features with nulls set to the median, unusable features null."""
    profile = column_profile(entities) if profile is None else profile
    medians = profile.filter("is_usable").agg(
        F.struct(
            *[F.max(F.when(F.col("feature") == name, F.col("median"))).alias(name) for name in FEATURES]
        ).alias("medians")
    )
    present = [name for name in FEATURES if name in entities.columns]
    imputed = [
        F.when(
            F.col(f"_medians.{name}").isNotNull(), F.coalesce(F.col(name).cast("double"), F.col(f"_medians.{name}"))
        ).alias(name)
        if name in present
        else F.lit(None).cast("double").alias(name)
        for name in FEATURES
    ]
    return entities.withColumn("_medians", medians.scalar()).select("entity_id", *imputed)


# Draws are the first hex digits of a digest of what they are for, so that any engine can repeat them.
DRAW_DIGITS = 13


def _uniform(*parts: object) -> Column:
    """Reproducible number in [0, 1) from the given parts."""
    text = F.concat_ws("|", *[part.cast("string") if isinstance(part, Column) else F.lit(str(part)) for part in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(16.0**DRAW_DIGITS)


def _draw(*parts: object) -> float:
    """The same number outside Spark."""
    text = "|".join(str(part) for part in parts)
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:DRAW_DIGITS], 16) / 16.0**DRAW_DIGITS


def sample_trees(matrix: DataFrame, trees: int, size: int, seed: int) -> DataFrame:
    """Up to ``size`` rows per tree, chosen by hash order of (seed, tree, entity).

    A hash threshold thins the rows before they are ranked. It leaves four times the sample on average, so that
    fewer than ``size`` rows pass only if the population itself is smaller.
    """
    population = matrix.agg(F.count(F.lit(1)).cast("double"))
    chance = F.lit(4.0 * size) / population.scalar()
    drawn = (
        matrix.withColumn("_chance", chance)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_draw", _uniform(seed, F.col("tree"), F.col("entity_id")))
        .filter(F.col("_draw") < F.col("_chance"))
        # A stated number of partitions, because growing trees is work that data sizes do not show.
        .repartition(max(1, trees // TREES_PER_TASK), "tree")
    )
    return first_rows(drawn, ["tree"], ["_draw", "entity_id"], size).drop("_chance", "_draw")


def _expected_path(size: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among ``size`` rows."""
    n = np.asarray(size, dtype=float)
    safe = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe))


def grow_tree(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One isolation tree as node rows; leaves carry their depth plus the expected remaining path.

    Feature and cut of a node are drawn from seed, tree and the turns that lead to the node.
    """
    tree = int(rows["tree"].iloc[0])
    values = rows.sort_values("entity_id")[list(FEATURES)].to_numpy(dtype=float)
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    nodes: list[list[float]] = []
    pending = [(np.arange(len(values)), "", -1, 0)]
    while pending:
        index, turns, parent, side = pending.pop()
        depth = len(turns)
        number = len(nodes)
        nodes.append([tree, number, -1, 0.0, -1, -1, depth + float(_expected_path(len(index)))])
        if parent >= 0:
            nodes[parent][4 + side] = number
        if depth >= limit or len(index) <= 1:
            continue
        block = values[index]
        low, high = block.min(axis=0), block.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if not len(splittable):
            continue
        feature = int(splittable[int(_draw(seed, tree, turns, "feature") * len(splittable))])
        cut = float(low[feature] + _draw(seed, tree, turns, "cut") * (high[feature] - low[feature]))
        below = block[:, feature] <= cut
        nodes[number][2:4] = [feature, cut]
        pending.append((index[~below], turns + "1", number, 1))
        pending.append((index[below], turns + "0", number, 0))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "depth"]).astype(
        {"tree": "int32", "node": "int32", "feature": "int32", "low": "int32", "high": "int32"}
    )


def isolation_scores(
    matrix: DataFrame, trees: int = catalog.FOREST_TREES, size: int = catalog.FOREST_SAMPLE,
    seed: int = catalog.FOREST_SEED,
) -> DataFrame:
    """Score per entity, -2^(-mean path / expected path); lower is more unusual.

    The forest is collected and broadcast: at most ``trees * (2 * size - 1)`` nodes, about 100,000 small rows with
    the default settings.
    """
    filled = matrix.select("entity_id", *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in FEATURES])
    nodes = (
        sample_trees(filled, trees, size, seed)
        .groupBy("tree")
        .applyInPandas(lambda rows: grow_tree(rows, seed), schema=NODE_SCHEMA)
        .toArrow()
        .to_pandas()
        .sort_values(["tree", "node"])
    )
    spark = matrix.sparkSession
    plan = {int(tree): part for tree, part in nodes.groupby("tree")}
    forest = spark.sparkContext.broadcast(
        [
            tuple(part[name].to_numpy() for name in ("feature", "cut", "low", "high", "depth"))
            for _, part in sorted(plan.items())
        ]
    )
    population = F.least(matrix.agg(F.count(F.lit(1))).scalar(), F.lit(size)).cast("double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[list(FEATURES)].to_numpy(dtype=float)
            total = np.zeros(len(values))
            for feature, cut, low, high, depth in forest.value:
                at = np.zeros(len(values), dtype=np.int64)
                active = np.arange(len(values))
                while len(active):
                    node = at[active]
                    inner = feature[node] >= 0
                    active, node = active[inner], node[inner]
                    below = values[active, feature[node]] <= cut[node]
                    at[active] = np.where(below, low[node], high[node])
                total += depth[at]
            norm = _expected_path(batch["_size"].to_numpy())
            mean = total / max(len(forest.value), 1)
            yield pd.DataFrame(
                {"entity_id": batch["entity_id"], "score": -np.power(2.0, -mean / np.where(norm > 0, norm, 1.0))}
            )

    return filled.withColumn("_size", population).mapInPandas(score, schema="entity_id string, score double")


def detect_anomalies(entities: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Flagged entities with ``anomaly_score`` and ``anomaly_rank``; empty below the minimum population.

    The score is shifted so that the contaminated share of the entities falls below zero. Scores are kept to
    SCORE_DIGITS places, so that ranks and digests do not hang on the last bits of a sum.
    """
    matrix = anomaly_matrix(entities, profile)
    population = entities.agg(F.count(F.lit(1)))
    scores = session.stage(
        isolation_scores(matrix).filter(population.scalar() >= catalog.FOREST_MIN_ENTITIES)
        .withColumn("score", round_half_even(F.col("score"), SCORE_DIGITS))
    )
    # Linear interpolation between the two order statistics around (n-1) * contamination.
    share = catalog.FOREST_CONTAMINATION
    bounds = order_statistics(
        scores, [], "score",
        lambda n: {
            "_low": F.floor((n - 1) * share) + 1, "_high": F.least(F.floor((n - 1) * share) + 2, n),
        },
    )
    weight = (F.col("n") - 1) * share - F.floor((F.col("n") - 1) * share)
    offset = bounds.select(F.col("_low") + (F.col("_high") - F.col("_low")) * weight)
    shifted = scores.withColumn("anomaly_score", round_half_even(F.col("score") - offset.scalar(), SCORE_DIGITS)).drop("score")
    ranked = global_rank(shifted, [F.col("anomaly_score"), F.col("entity_id")], "anomaly_rank")
    return ranked.filter(F.col("anomaly_score") < 0)


def anomaly_detection(entities: DataFrame) -> Detection:
    """AN001 findings with the three largest deviations from the population medians."""
    profile = session.stage(column_profile(entities))
    flagged = detect_anomalies(entities, profile)
    medians = profile.filter("is_usable").agg(
        F.struct(
            *[F.max(F.when(F.col("feature") == name, F.col("median"))).alias(name) for name in FEATURES]
        )
    )

    def contribution(name: str) -> Column:
        observed, reference = F.col(name).cast("double"), F.col(f"_medians.{name}")
        distance = F.abs(observed - reference)
        return F.when(
            observed.isNotNull() & reference.isNotNull(),
            F.struct(
                F.when(reference == 0, -distance).otherwise(-distance / F.abs(reference)).alias("order"),
                F.lit(name).alias("feature"), observed.alias("observed_value"), reference.alias("reference_value"),
            ),
        )

    present = [name for name in FEATURES if name in entities.columns]
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*[contribution(name) for name in present]))), 1, 3)
    hits = (
        entities.select("entity_id", *present)
        .join(flagged, "entity_id")
        .withColumn("_medians", medians.scalar())
        .withColumn(
            "deviations",
            F.transform(
                ranked,
                lambda item: F.struct(
                    item["feature"].alias("feature"), item["observed_value"].alias("observed_value"),
                    item["reference_value"].alias("reference_value"), (-item["order"]).alias("relative_deviation"),
                ),
            ),
        )
    )
    hits = identify(hits, "AN001", F.col("entity_id"))
    text = F.array_join(
        F.transform(
            "deviations",
            lambda item: render(
                catalog.RATIONALES["AN001_ITEM"], feature=item["feature"], observed=item["observed_value"],
                reference=item["reference_value"],
            ),
        ),
        "; ",
    )
    strength = F.when(F.size("deviations") >= 3, "High").otherwise("Medium")
    findings = make_findings(
        hits, "AN001", confidence=strength, text={"deviations": text}, metric_name="anomaly_score",
        observed_value=F.col("anomaly_score"), baseline_method="isolation_forest",
        baseline_type="model_relative_unusualness", anomaly_score=F.col("anomaly_score"),
        anomaly_rank=F.col("anomaly_rank"), contributing_deviations=F.col("deviations"),
    )
    items = hits.select("finding_id", "entity_id", F.explode("deviations").alias("item"))
    evidence = make_evidence(
        items.select("finding_id", "entity_id", F.col("item.feature"), F.col("item.observed_value").alias("value")),
        [EvidenceItem("entity_feature", F.col("entity_id"), F.col("feature"), F.col("value"), "real",
                      catalog.EVIDENCE_REASONS["AN001"])],
    )
    return Detection(findings, evidence)
