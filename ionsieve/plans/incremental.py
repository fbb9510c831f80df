"""Results that are kept per sample and replaced when samples are added or loaded again.

The state is a table with all result rows of every loaded sample, in folders by a hash of the sample. An update computes
the given samples only and rewrites the folders they fall into, so its cost follows what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.targets import Targets
from ..session import BROADCAST_MAX_ROWS, at_most, materialize
from .screening import max_frame

# Folders of a state.
FOLDERS = 256


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("file_id"), F.lit(folders)).cast("int")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The results of all loaded samples."""
    return spark.read.parquet(path).drop("_folder")


def update_state(
    path: str, peaks: DataFrame, manifest: DataFrame, results: Callable[[DataFrame, DataFrame], DataFrame], folders: int = FOLDERS
) -> DataFrame:
    """Load the samples of `manifest` into the state at `path` and return it whole.

    `results` makes result rows with a file_id from (peaks, manifest). Rows that a sample had before go. Samples without a
    result row are known to the state only if `results` makes a row for them, as a full grid does. `peaks` may hold
    other samples too; they are left out. Folders are replaced together at the end: an update that fails
    leaves the old state.
    """
    spark = peaks.sparkSession
    samples = manifest.select("file_id").distinct()
    few = at_most(samples, BROADCAST_MAX_ROWS)
    loaded = F.broadcast(samples) if few else samples
    new = results(peaks.join(loaded, "file_id", "left_semi"), manifest).withColumn("_folder", _folder(folders))
    if _exists(spark, path):
        touched = [row[0] for row in samples.select(_folder(folders)).distinct().collect()]  # no more than there are folders
        old = spark.read.parquet(path).where(F.col("_folder").isin(touched)).join(loaded, "file_id", "left_anti")
        # What stays is written elsewhere first, as its own folders are about to be replaced.
        new = new.unionByName(materialize(old).select(*new.columns))
    rows = new.repartition("_folder").sortWithinPartitions("_folder", "file_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_folder").parquet(path)
    return read_state(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def update_max_frame(path: str, peaks: DataFrame, manifest: DataFrame, targets: Targets, folders: int = FOLDERS, **limits) -> DataFrame:
    """The max frame of all samples loaded so far, after those of `manifest` have been computed (again)."""
    return update_state(path, peaks, manifest, lambda p, m: max_frame(p, m, targets, **limits), folders)
