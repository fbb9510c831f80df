"""Mass spectra around the apex of a chromatogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS, at_most
from .eic import summed_intensity
from .filters import points
from .ranges import join_ranges

# Fixed values, in minutes: where points count as near the apex, how many rows
# make a width measurable, and the tolerances used around it.
NEAR_APEX = 0.5
ROWS_TO_MEASURE = 3
LEAST_TOLERANCE = 0.05
DEFAULT_TOLERANCE = 0.1

# Width of an RT bin when spectra are looked up.
RT_BIN = 0.25


def apex_windows(scans: DataFrame, given_rt: DataFrame | None = None) -> DataFrame:
    """Retention time window of each chromatogram's spectrum.

    `scans` are per-scan chromatograms. The window is centred on the apex, or
    on `rt` of `given_rt` (target_id, file_id, rt), and is as wide as the part
    above half maximum, where enough points allow to measure it. Each given time is a
    window of its own, also without any point near it.
    """
    keys = ["target_id", "file_id"]
    # The join below implies these tests. Stated here they hold for both of its
    # sides, which then share one chromatogram exchange and one peak scan.
    scans = scans.where("target_id is not null and file_id is not null and rt is not null")
    if given_rt is None:
        earliest_top = F.min_by("rt", F.struct((-F.col("intensity")).alias("high"), F.col("rt")))
        centres = scans.groupBy(*keys).agg(earliest_top.alias("apex_rt"))
    else:
        centres = given_rt.select(*keys, F.col("rt").alias("apex_rt")).distinct()
    near = scans.join(centres, keys).where(
        F.col("rt").between(F.col("apex_rt") - NEAR_APEX, F.col("apex_rt") + NEAR_APEX)
    )
    # One minute of one chromatogram per group.
    top = F.max("intensity").over(Window.partitionBy(*keys, "apex_rt"))
    high_rt = F.when(F.col("intensity") > F.col("_top") / 2, F.col("rt"))
    measured = near.withColumn("_top", top).groupBy(*keys, "apex_rt").agg(
        F.count("*").alias("n_near"),
        (F.max(high_rt) - F.min(high_rt)).alias("fwhm"),
    )
    width = F.greatest(F.lit(LEAST_TOLERANCE), F.col("fwhm"))
    tolerance = F.when(
        (F.col("n_near") > ROWS_TO_MEASURE) & F.col("fwhm").isNotNull(), width
    ).otherwise(F.lit(DEFAULT_TOLERANCE))
    if given_rt is not None:
        measured = centres.join(measured, [*keys, "apex_rt"], "left")
    n_near = F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")
    return measured.select(*keys, "apex_rt", n_near, tolerance.alias("rt_tolerance"))


def spectra_in_windows(peaks: DataFrame, windows: DataFrame, mslevel: str) -> DataFrame:
    """Summed intensity per exact m/z in each sample's windows, with the base peak.

    `windows` comes from `apex_windows` and is read several times: pass it
    materialised. MS2 peaks are chosen by time alone; there is no precursor.
    """
    bounds = windows.select(
        "target_id",
        "file_id",
        "apex_rt",
        (F.col("apex_rt") - F.col("rt_tolerance")).alias("lo"),
        (F.col("apex_rt") + F.col("rt_tolerance")).alias("hi"),
    )
    # A window spans at most one minute on either side, so a bounded number of bins.
    bins = int(2 * (2 * NEAR_APEX) / RT_BIN) + 1
    few = at_most(windows, BROADCAST_MAX_ROWS // bins)
    inside = join_ranges(
        points(peaks, mslevel, min_intensity=None).select("file_id", "rt", "mz", "intensity"),
        bounds,
        value="rt",
        width=RT_BIN,
        on=["file_id"],
        broadcast=few,
    )
    keys = ["target_id", "file_id", "apex_rt"]
    lines = inside.groupBy(*keys, "mz").agg(summed_intensity().alias("intensity"))
    base = lines.groupBy(*keys).agg(F.max("intensity").alias("base_peak"))
    return lines.join(base, keys)
