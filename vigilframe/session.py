"""Session settings and reliable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Without call-site capture every Column call saves a round trip to the JVM; plans here have thousands of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

RUNTIME_SETTINGS = (
    "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
)


def build_session(app_name: str = "vigilframe", master: str | None = None, **extra: str) -> SparkSession:
    """Create a session; cluster sizing (executors, shuffle partitions) stays with spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session somebody else built."""
    for key in RUNTIME_SETTINGS:
        spark.conf.set(key, SESSION_SETTINGS[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of the driver gets a scratch folder; on a cluster a
    folder of one machine would lose what the others wrote, so there the setting is required.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_single_process(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vigilframe-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def is_single_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it from there.

    Used where a result feeds several later jobs, or where two parts of a plan must see the very same rows. The
    lineage is cut, so a lost executor costs no recomputation, and unlike a row-wise checkpoint the table keeps
    column pruning, filter pushdown and the file sizes that join planning goes by.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
