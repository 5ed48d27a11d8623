"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.llm.common import WORD, free_names
from vigilframe.session import stage

#: 52 bits of a digest, the most that a double holds without rounding.
DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): one row per source.

    Sources in code point order, null last, take ``weights`` in turn and divide ``share`` times all sizes; no target
    is above ``most`` times its source's size, and what that leaves over is divided among the others by weight. That
    is a common level: each target is the lesser of cap and weight times level. With sources ordered by cap over
    weight, the capped ones come first, and the level follows from two running sums over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(weight)) for weight in weights])
    weighed = totals.withColumn("weight", F.get(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = capped.select(
        "*", (F.sum("source_size").over(whole) * F.lit(float(share))).alias("pool"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"),
        F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.col("pool") - F.col("spent")) / F.col("open_weight"))
    # the first source whose cap lies above the level that is left: from there on the level holds
    level = levels.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(whole)["level"])
    return level.select(
        "source", "source_size", "weight",
        F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("found"))).alias("target"),
    )


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, text_hash) of every row, written once: the texts are read for it a single time."""
    return stage(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"), text_hash(F.col(text_column)).alias("text_hash"),
    ))


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def source_rates(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) per source, written once; a source of size 0 has target and rate 0."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stage(source_targets(rows.select("source", "size"), weights, share, most).drop("weight").withColumn("rate", rate))


def copies(rate: Column, seed: str, doc_id: Column, hashed: Column) -> Column:
    """floor(rate) copies, and one more with the fraction as probability, drawn from seed, id and text alone."""
    fraction = rate - F.floor(rate)
    return (F.floor(rate) + (unit_draw(seed, doc_id, hashed) < fraction).cast("int")).cast("int")


def plan_mix(rows: DataFrame, rates: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (of ``measured``) with source_size, target, rate and copies; reruns and retries agree.

    Null texts have size 0 and null sources are a source; repeated rows are decided alike; an empty table gives an
    empty result. The join is left to the planner, who knows the size of the written rates: with few sources they
    are broadcast, with very many adaptive execution splits the large ones.
    """
    joined = rows.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("copies", copies(F.col("rate"), seed, F.col("doc_id"), F.col("text_hash")))


def emit(docs: DataFrame, rates: DataFrame, seed: str = "mix", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as the mix takes it; decisions equal those of ``plan_mix``."""
    source, rate, number, copy = free_names(docs.columns, "mix_source", "mix_rate", "mix_copies", "mix_copy")
    named = rates.select(F.col("source").alias(source), F.col("rate").alias(rate))
    joined = docs.join(named, F.col(source_column).cast("string").eqNullSafe(F.col(source)))
    counted = joined.withColumn(number, copies(F.col(rate), seed, F.col(id_column).cast("long"), text_hash(F.col(text_column))))
    repeated = counted.where(F.col(number) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number))))
    return repeated.select(*[F.col(f"`{name}`") for name in docs.columns])
