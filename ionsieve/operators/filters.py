"""Row filters on peaks and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names


def at_level(peaks: DataFrame, mslevel: str) -> Column:
    """MS level test; the literal takes the column's type, so it pushes down."""
    kind = peaks.schema["mslevel"].dataType
    level = F.lit(mslevel) if isinstance(kind, T.StringType) else F.lit(int(mslevel)).cast(kind)
    return F.col("mslevel") == level


def points(
    peaks: DataFrame,
    mslevel: str = "1",
    rt_range: tuple[float, float] | None = None,
    min_intensity: float | None = 0.0,
) -> DataFrame:
    """Peaks of one MS level inside a closed RT range, at or above a floor.

    The floor applies to single points, before anything is summed. None turns
    a limit off.
    """
    kept = peaks.where(at_level(peaks, mslevel))
    if rt_range is not None:
        kept = kept.where(F.col("rt").between(float(rt_range[0]), float(rt_range[1])))
    if min_intensity is not None:
        kept = kept.where(F.col("intensity") >= float(min_intensity))
    return kept


def in_any_range(column: str, ranges: Sequence[tuple[float, float]]) -> Column:
    """Closed intervals as one predicate that file statistics can prune by."""
    test = F.lit(False)
    for low, high in ranges:
        test = test | F.col(column).between(low, high)
    return test


def keep_samples(
    samples: DataFrame, exclude_patterns: Sequence[str] = names.EXCLUDED_SAMPLES
) -> DataFrame:
    """Drop samples whose name matches a pattern anywhere, in any case."""
    return samples.where(~names.matches_any(F.col("file"), exclude_patterns))


def keep_paths(
    manifest: DataFrame, exclude_patterns: Sequence[str] = names.EXCLUDED_PATHS
) -> DataFrame:
    """The same on a manifest's base names, so that no excluded file is opened."""
    file = names.base_name(F.col("path")) if "path" in manifest.columns else F.col("file")
    return manifest.where(~names.matches_any(file, exclude_patterns))


def with_signal(max_frame: DataFrame) -> DataFrame:
    return max_frame.where("max_intensity > 0")


def normalised_only(frame: DataFrame) -> DataFrame:
    return frame.where("max_intensity is not null and max_intensity <> 0")


def detected_compounds(results: DataFrame) -> DataFrame:
    """Names with a positive score in any sample."""
    return results.where("Detection_Score > 0").select("Compound").distinct()


def named(suspects: DataFrame, name: str) -> DataFrame:
    """Suspects of exactly this name; there may be several."""
    return suspects.where(F.col("name") == name)
