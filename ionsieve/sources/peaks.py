"""Reading and writing peak tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name, matches_any, sample_key, url_decoded
from ..schemas import PEAK_FILE, PEAKS, require_columns
from .manifest import PARQUET_FILES


def read_samples(
    spark: SparkSession,
    paths: str | Sequence[str],
    skip_damaged: bool = False,
    exclude_patterns: Sequence[str] = (),
) -> DataFrame:
    """Peaks of one Parquet file per sample, all read as one dataset.

    `paths` are files, or folders that are searched to any depth.

    `file_id` is the full path (without a scheme for local files), so two files with one base name stay apart.
    `exclude_patterns` leave out samples whose file name matches; their files are not opened.
    `skip_damaged` reads past unreadable files instead of failing;
    `files_without_peaks` then tells which samples gave nothing.
    """
    reader = spark.read.schema(PEAK_FILE).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", PARQUET_FILES)
    if skip_damaged:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = reader.parquet(*paths)
    if exclude_patterns:
        rows = rows.where(~matches_any(base_name(url_decoded(F.col("_metadata.file_path"))), exclude_patterns))
    # The metadata path is percent-encoded on top of the real name: decode once.
    file_id = sample_key(url_decoded(F.col("_metadata.file_path")))
    return clean_points(rows.withColumn("file_id", file_id))


def clean_points(peaks: DataFrame) -> DataFrame:
    """Peak columns only, without NaN numbers (a NaN intensity would pass any floor)."""
    require_columns(peaks, PEAKS.fieldNames())
    numbers = ~F.isnan("intensity") & ~F.isnan("mz") & ~F.isnan("rt")
    return peaks.where(F.coalesce(numbers, F.lit(True))).select(*PEAKS.fieldNames())


def write_peaks(peaks: DataFrame, path: str, partitions: int, mode: str = "errorifexists") -> None:
    """Lay peaks out for mass windows: one folder per MS level, sorted by m/z.

    Range partitioning gives each output file a narrow m/z band, so a window
    skips nearly all files and row groups from their footers. Retention time
    and sample take part in the range keys, which splits a mass that holds a
    large share of all peaks over many files.
    """
    (
        peaks.select(*PEAKS.fieldNames())
        .repartitionByRange(partitions, "mslevel", "mz", "rt", "file_id")
        .sortWithinPartitions("mslevel", "mz", "rt")
        .write.mode(mode)
        .partitionBy("mslevel")
        .parquet(path)
    )


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks written by `write_peaks`."""
    return clean_points(spark.read.schema(PEAKS).parquet(path))


def write_by_file(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per sample: `sample` is its name and a hash of its path, so that samples of one name stay apart.

    Rows of a sample are brought together; adaptive execution splits a sample
    that is too large for one writer and merges small ones.
    """
    place = F.concat_ws("-", base_name(F.col("file_id")), F.lower(F.hex(F.xxhash64("file_id"))))
    df.withColumn("sample", place).hint("rebalance", "sample").write.mode(mode).partitionBy("sample").parquet(path)
