"""Exact order statistics and global ranks that never put a whole group into one task."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe import session

# Values are binned on a signed logarithmic grid of this many cells per power of two. The grid is a monotone
# function of the value alone, so every evaluation of the plan bins alike.
CELLS_PER_OCTAVE = 1024
_SIGN_OFFSET = 2_000_000

Picks = Callable[[Column], dict[str, Column]]


def _cell(value: Column) -> Column:
    finite = F.least(F.abs(value), F.lit(sys.float_info.max))  # infinite values share the last cell
    magnitude = F.floor(F.log2(finite) * CELLS_PER_OCTAVE).cast("long") + _SIGN_OFFSET
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0).cast("long"))


def order_statistics(df: DataFrame, groups: list[str], value: str, picks: Picks) -> DataFrame:
    """Values at chosen 1-based positions of the sorted non-null values of each group.

    ``picks`` maps the group size (a Column) to named positions; a position outside 1..n gives null. Returns the
    group columns, ``n`` and one column per pick; groups without a value have no row.

    Equal values are counted together first. The few cells that hold a wanted position are found from cell
    totals; only their values are then sorted, one cell per task.
    """
    keys = [*groups, "_whole"]
    counted = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .withColumn("_whole", F.lit(0))
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_cell", _cell(F.col("_value")))
    )
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    cells = (
        counted.groupBy(*keys, "_cell")
        .agg(F.sum("_count").alias("_size"))
        .withColumn("_upto", F.sum("_size").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_size").over(Window.partitionBy(*keys)))
    )
    wanted = picks(F.col("n"))
    choices = F.array(
        *[F.struct(F.lit(name).alias("_pick"), where.cast("long").alias("_at")) for name, where in wanted.items()]
    )
    before = F.col("_upto") - F.col("_size")
    targets = (
        cells.withColumn("_choice", F.explode(choices))
        .filter((F.col("_choice._at") > before) & (F.col("_choice._at") <= F.col("_upto")))
        .select(*keys, "_cell", "n", "_choice._pick", (F.col("_choice._at") - before).alias("_offset"))
    )
    in_cell = Window.partitionBy(*keys, "_cell", "_pick").orderBy("_value")
    found = (
        counted.join(targets, [*keys, "_cell"])
        .withColumn("_running", F.sum("_count").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_running") >= F.col("_offset")) & (F.col("_running") - F.col("_count") < F.col("_offset")))
    )
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_pick") == name, F.col("_value"))).alias(name) for name in wanted],
    ).drop("_whole")


def midpoint(low: Column, high: Column) -> Column:
    """Linear interpolation half way, in the form low + (high - low) / 2."""
    return (high - low) * 0.5 + low


def exact_medians(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Exact interpolated median per group: the group columns, ``n`` and ``median``."""
    middle = order_statistics(
        df, groups, value,
        lambda n: {"_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1},
    )
    return middle.select(*groups, "n", midpoint(F.col("_low"), F.col("_high")).alias("median"))


def nearest_rank(n: Column, fraction: float) -> Column:
    """1-based position of the nearest-rank quantile: index (n-1)*q rounded half up."""
    return F.floor((n - 1) * F.lit(fraction) + 0.5) + 1


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense 1..N row numbers in total order, without a single-partition window.

    Rows are range-partitioned and sorted, and staged with their partition number and index; ranks follow from the
    partition sizes. Staging matters: the range bounds come from a sample, so both uses must see one evaluation.
    The broadcast side holds one row per partition.
    """
    placed = session.stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_index") + 1)
        .drop("_part", "_index", "_start")
    )
