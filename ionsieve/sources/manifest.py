"""Which samples there are, in which order, and which of them are still new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..schemas import MANIFEST, require_columns


# Sample files by name, in any case.
PARQUET_FILES = "*.[pP][aA][rR][qQ][uU][eE][tT]"


def manifest_from_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Manifest of an explicit list of paths, in list order.

    Paths outside the local disk need their full URI, as that is how the peaks
    of a file are keyed.
    """
    listed = spark.createDataFrame(list(zip(paths, range(len(paths)))), "path string, pos long")
    path = F.col("path")
    keyed = listed.withColumns({"file_id": names.sample_key(path), "file": names.base_name(path)})
    return keyed.select(*MANIFEST.fieldNames())


def manifest_from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of every Parquet file below `folder`, in path order.

    Only names are listed; no file content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", PARQUET_FILES)
        .load(folder)
        .select("path")
    )
    path = F.col("path")
    return (
        files.select(names.sample_key(path).alias("file_id"), names.base_name(path).alias("file"), path)
        # A position only has to sort like the path; it need not be dense.
        .sort("path")
        .withColumn("pos", F.monotonically_increasing_id())
    )


def manifest_from_listing(listing: DataFrame) -> DataFrame:
    """Parquet files of a listing (name, path, is_folder, url), one row per path.

    The sample key is that of the peaks reader for the file's `url`; without one it is `folder/name`, files at the
    root having the folder ".". `pos` follows the paths (rising, not dense).
    """
    require_columns(listing, ["name", "path", "is_folder", "url"])
    folder = names.folder_name(F.col("path"))
    return (
        listing.where(~F.col("is_folder") & names.is_parquet(F.col("name")))
        .dropDuplicates(["path"])
        .select(
            F.coalesce(names.sample_key(F.col("url")), names.join_path(folder, F.col("name"))).alias("file_id"),
            F.col("name").alias("file"),
            F.trim("path").alias("path"),
            folder.alias("folder"),
            "url",
        )
        .sort("path")
        .withColumn("pos", F.monotonically_increasing_id())
    )


def new_samples(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Samples of `manifest` whose key is not in `loaded` yet."""
    return manifest.join(loaded.select("file_id").distinct(), "file_id", "left_anti")


def files_without_peaks(manifest: DataFrame, peaks_or_results: DataFrame) -> DataFrame:
    """Samples for which no row exists: empty, lost or without a hit."""
    return new_samples(manifest, peaks_or_results)


def only_samples(df: DataFrame, samples: Sequence[str] | DataFrame | None) -> DataFrame:
    """Restrict to given sample keys; None keeps all."""
    if samples is None:
        return df
    if isinstance(samples, DataFrame):
        return df.join(samples.select("file_id"), "file_id", "left_semi")
    return df.where(F.col("file_id").isin(list(samples)))
