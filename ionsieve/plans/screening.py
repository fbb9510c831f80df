"""What a user calls: batch screening, summaries, suspect screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scoring
from ..operators.eic import eic, eic_one_target, hits, labelled
from ..operators.filters import keep_samples, with_signal
from ..operators.normalize import normalise
from ..operators.samples import dated_frame, in_date_order
from ..operators.summary import complete, max_intensities, screening_aggregate, summarize
from ..operators.targets import Targets


def screen_one_mass(
    peaks: DataFrame,
    manifest: DataFrame,
    target_mz: float,
    mz_tolerance: float = 0.01,
    rt_range: tuple[float, float] | None = None,
    mslevel: str = "1",
    min_intensity: float = 0.0,
) -> DataFrame:
    """Chromatogram of one mass in every sample; a sample without a hit is one row of nulls."""
    found = eic_one_target(peaks, target_mz, mz_tolerance, rt_range, mslevel, min_intensity)
    return manifest.select("file_id", "file", "pos").join(found.drop("file"), "file_id", "left")


def screen_molecules(
    peaks: DataFrame,
    targets: Targets,
    rt_range: tuple[float, float] | None = None,
    mslevel: str = "1",
    min_intensity: float = 0.0,
    broadcast: bool | None = None,
) -> DataFrame:
    """Chromatograms of all molecules in all samples, from one scan."""
    found = eic(peaks, targets, rt_range, mslevel, min_intensity, broadcast=broadcast)
    return labelled(found, targets)


def max_frame(peaks: DataFrame, manifest: DataFrame, targets: Targets, **limits) -> DataFrame:
    """Maximum and apex of every molecule in every sample."""
    return max_intensities(eic(peaks, targets, **limits), manifest, targets)


def summary_frame(peaks: DataFrame, manifest: DataFrame, targets: Targets, **limits) -> DataFrame:
    """Detection, maximum, apex, points and area of every molecule in every sample."""
    return summarize(eic(peaks, targets, **limits), manifest, targets)


def process_screening_results(
    max_values: DataFrame,
    metadata: DataFrame | None = None,
    exclude_patterns: Sequence[str] = names.EXCLUDED_SAMPLES,
    reorder: bool = True,
) -> DataFrame:
    """Field samples with a signal, numbered by date within each molecule.

    Without metadata (or with `reorder=False`) the input order is kept and
    there are no date columns. `max_values` is read twice: pass it materialised.
    """
    kept = with_signal(keep_samples(max_values, exclude_patterns))
    if metadata is None or not reorder:
        return kept
    return in_date_order(dated_frame(kept, metadata), ["target_id"], "sample_idx")


def suspect_screening(
    peaks: DataFrame,
    manifest: DataFrame,
    targets: Targets,
    mslevel: str = "1",
    rt_range: tuple[float, float] | None = (0.0, 30.0),
    min_intensity: float = 1000.0,
    rounded: bool = True,
    mass_digits: int | None = None,
) -> DataFrame:
    """One row per sample and suspect: score, mass error, status. One scan for all.

    Values are rounded half to even for display unless `rounded` is off; exact masses half up to `mass_digits`, if given.
    There are many more pairs than hits, so what hangs on a hit or on a suspect alone is worked out before they meet.
    """
    found = screening_aggregate(hits(peaks, targets, rt_range, mslevel, min_intensity))
    shown = F.bround if rounded else (lambda value, digits: value)
    n = F.coalesce("n_hits", F.lit(0).cast("long"))
    score = scoring.detection_score(n)
    scored = found.select(
        "file_id",
        "target_id",
        "mean_mz",
        shown(score, 1).alias("score"),
        shown(F.coalesce("max_intensity", F.lit(0.0)), 0).alias("highest"),
        n.alias("n"),
        scoring.detection_status(score).alias("status"),
    )
    mass = F.col("target_mz") if mass_digits is None else F.round("target_mz", mass_digits)
    full = complete(scored, manifest, targets, exact_mass=mass)
    observed, error = F.col("mean_mz"), scoring.ppm_error(F.col("mean_mz"), F.col("target_mz"))
    return full.select(
        F.col("file").alias("Sample"),
        F.col("molecule").alias("Compound"),
        F.col("exact_mass").alias("Exact_Mass"),
        shown(observed, 4).alias("Observed_MZ"),
        shown(error, 2).alias("MZ_Error_ppm"),
        F.coalesce("score", F.lit(0.0)).alias("Detection_Score"),
        F.coalesce("highest", F.lit(0.0)).alias("Max_Intensity"),
        F.coalesce("n", F.lit(0).cast("long")).alias("N_Detections"),
        F.coalesce("status", scoring.detection_status(F.lit(0.0))).alias("Status"),
    )


def run_counters(
    max_values: DataFrame,
    standard: DataFrame,
    metadata: DataFrame,
    exclude_patterns: Sequence[str] = names.EXCLUDED_SAMPLES,
) -> DataFrame:
    """Counts that the steps report, per molecule.

    kept and excluded samples, kept samples without a date, kept samples
    without a signal, and samples with a usable ratio to the standard.
    """
    excluded = names.matches_any(F.col("file"), exclude_patterns)
    dated = dated_frame(max_values, metadata)
    ratio = F.col("ratio")
    ratios = normalise(max_values, standard).select(
        "file_id", "target_id", F.col("max_intensity").alias("ratio")
    )
    return dated.join(ratios, ["file_id", "target_id"]).groupBy("target_id", "molecule").agg(
        F.count_if(~excluded).alias("n_kept"),
        F.count_if(excluded).alias("n_excluded"),
        F.count_if(~excluded & F.col("date_order").isNull()).alias("n_unmatched"),
        F.count_if(~excluded & (F.col("max_intensity") <= 0)).alias("n_zero"),
        F.count_if(ratio.isNotNull()).alias("n_normalised"),
        F.count("*").alias("n_samples"),
    )
