"""Session set-up, tables and lineage cuts shared by every operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, name: str = "loomdex") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMDEX_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; only where that is unset in local mode (tests) one of our own."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = os.path.abspath(os.path.join("spark-warehouse", "checkpoints"))
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that a lost executor costs no recomputation and lineage stays short."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Task slots now at hand; at least two."""
    return max(2, spark.sparkContext.defaultParallelism)


#: Nodes of plans that are parted anew by a shuffle already.
_SHUFFLING = ("Aggregate ", "Join ", "Window ", "Sort ", "Repartition", "RebalancePartitions", "Deduplicate", "Distinct", "GlobalLimit", "Intersect", "Except")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Even out a scan that has fewer partitions than the cluster has slots, before work that is heavy per row.

    A large table is read in many more splits than there are slots and passes through unchanged, without a shuffle.
    """
    want = slots(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(node in plan for node in _SHUFFLING):
        return df  # counting its partitions would run it
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(2 * want, key) if key else df.repartition(2 * want)
