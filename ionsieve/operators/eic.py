"""Extracted ion chromatograms, hits and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name
from .filters import in_any_range, points
from .ranges import crowded_bins, join_ranges, seen_bins, tasks_for
from .targets import Targets

# Sums are taken in decimals of this kind up to this size of a single intensity.
EXACT = "decimal(38, 15)"
EXACT_BELOW = 1e15


def summed_intensity() -> Column:
    """The sum of `intensity`, the same in whatever order its points come.

    Sums of doubles hang on their order, and equal chromatograms would be tied on one run and not on the next one. Only
    a group with larger or non-finite values, or too large a sum, is summed as doubles.
    """
    small = F.abs("intensity") < EXACT_BELOW
    exact = F.try_sum(F.when(small, F.col("intensity").cast(EXACT))).cast("double")
    return F.coalesce(F.when(F.bool_and(small), exact), F.sum("intensity"))


def eic_one_target(
    peaks: DataFrame,
    target_mz: float,
    mz_tolerance: float = 0.01,
    rt_range: tuple[float, float] | None = None,
    mslevel: str = "1",
    min_intensity: float = 0.0,
) -> DataFrame:
    """Summed intensity per sample and retention time around one mass."""
    window = F.col("mz").between(target_mz - mz_tolerance, target_mz + mz_tolerance)
    return (
        points(peaks, mslevel, rt_range, min_intensity)
        .where(window)
        .groupBy("file_id", "rt")
        .agg(summed_intensity().alias("intensity"))
        .select(
            "file_id",
            base_name(F.col("file_id")).alias("file"),
            "rt",
            "intensity",
            F.lit(float(target_mz)).alias("target_mz"),
        )
    )


def matched_points(
    peaks: DataFrame,
    targets: Targets,
    rt_range: tuple[float, float] | None = None,
    mslevel: str = "1",
    min_intensity: float | None = 0.0,
    broadcast: bool | None = None,
) -> DataFrame:
    """Peaks with every target whose mass window holds them, in one scan; a long list has one mass column scanned before."""
    near = (
        points(peaks, mslevel, rt_range, min_intensity)
        .where(in_any_range("mz", targets.scan_ranges))
        .select("file_id", "rt", "scanid", "mz", "intensity")
    )
    width, broadcast = 2 * targets.tolerance, targets.few if broadcast is None else broadcast
    if broadcast:
        return join_ranges(near, targets.windows, value="mz", width=width, broadcast=True)
    seen = seen_bins(near, "mz", width)
    crowded, tasks = crowded_bins(near, "mz", width, seen=seen), tasks_for(seen)
    return join_ranges(near, targets.windows, value="mz", width=width, crowded=crowded, tasks=tasks)


def eic(
    peaks: DataFrame,
    targets: Targets,
    rt_range: tuple[float, float] | None = None,
    mslevel: str = "1",
    min_intensity: float | None = 0.0,
    per_scan: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """Chromatograms of all targets in all samples: target_id, file_id, rt, intensity.

    `per_scan` keeps scans with equal retention time apart. Each partition
    sums first, so the shuffle carries one row per chromatogram point and task.
    """
    keys = ["target_id", "file_id", "rt"] + (["scanid"] if per_scan else [])
    matched = matched_points(peaks, targets, rt_range, mslevel, min_intensity, broadcast)
    return matched.groupBy(*keys).agg(summed_intensity().alias("intensity"))


def labelled(frame: DataFrame, targets: Targets) -> DataFrame:
    """Add `molecule`, `target_mz` and the sample's `file` name to keyed rows."""
    named = frame.join(targets.labels, "target_id")
    return named.withColumn("file", base_name(F.col("file_id")))


def hits(
    peaks: DataFrame,
    targets: Targets,
    rt_range: tuple[float, float] | None = (0.0, 30.0),
    mslevel: str = "1",
    min_intensity: float = 1000.0,
) -> DataFrame:
    """Per target, sample and scan: highest intensity, mean m/z, number of points."""
    matched = matched_points(peaks, targets, rt_range, mslevel, min_intensity)
    return matched.groupBy("target_id", "file_id", "rt", "scanid").agg(
        F.max("intensity").alias("max_intensity"),
        F.avg("mz").alias("mean_mz"),
        F.count("*").alias("n_points"),
    )


def spectrum(
    peaks: DataFrame, mslevel: str, rt_range: tuple[float, float]
) -> DataFrame:
    """Summed intensity per exact m/z and sample inside a retention time range."""
    kept = points(peaks, mslevel, rt_range, min_intensity=None)
    return kept.groupBy("file_id", "mz").agg(summed_intensity().alias("intensity"))
