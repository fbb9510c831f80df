"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Broadcasts are only asked for below this many fixed-width rows (about 25 MB
# once hashed). Anything larger goes through a shuffle.
BROADCAST_MAX_ROWS = 200_000


def recommended_conf(cores: int, checkpoint_folder: str, input_bytes: int = 0) -> dict[str, str]:
    """Settings for a cluster with `cores` task slots and an input of `input_bytes`.

    Shuffles start finely cut, one partition per 128 MB of input and at least
    four per core; adaptive execution merges small ones. `checkpoint_folder` is
    one that driver and executors share.
    """
    partitions = max(8, 4 * cores, input_bytes >> 27)
    return {
        "spark.checkpoint.dir": checkpoint_folder,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.sql.parquet.filterPushdown": "true",
        # A join may keep rows where a part of its keys has put them already.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cores: int = 8, app_name: str = "ionsieve") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="ionsieve-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for tables of a run."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and continue from there.

    For small results that several later steps read, so that the peak scan
    behind them runs once. The folder is the shared one that the cluster names
    in `spark.checkpoint.dir`; only a local session may fall back to a folder
    of its own.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def detached(df: DataFrame) -> DataFrame:
    """`materialize` without what Spark estimates and infers from the plan behind `df`.

    For loops that make each table from the last one: a join's estimated size is the product of both sides' sizes, so its digits
    multiply from round to round, until planning takes longer than running.
    """
    kept, session = materialize(df), df.sparkSession
    return type(df)(session._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), session)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has no more than `rows` rows: a count, for tables and materialised frames."""
    return df.count() <= rows
