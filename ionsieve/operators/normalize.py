"""Internal-standard ratios and stacking of molecules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require_columns
from .filters import normalised_only


def normalise(
    molecule: DataFrame,
    standard: DataFrame,
    molecule_name: str = "Molecule",
    standard_name: str = "ISTD",
) -> DataFrame:
    """Every molecule row with its ratio to the standard in the same sample.

    All other columns of the molecule frame stay: keys, names, positions and dates. The ratio is null where the standard
    is missing or zero. Several standard rows of one sample: the one with the lowest `pos` counts, among equal ones
    that with the lowest target and the highest intensity.
    """
    row = F.struct(
        F.col("max_intensity").alias("intensity"),
        F.col("rt_at_max").alias("rt"),
        F.col("target_mz").alias("mz"),
    )
    first = [F.col(c) for c in ("pos", "target_id") if c in standard.columns]
    order = F.struct(*first, (-F.col("max_intensity")).alias("highest"), F.col("rt_at_max").alias("earliest"))
    reference = standard.groupBy("file_id").agg(F.min_by(row, order).alias("_istd"))
    both = molecule.join(reference, "file_id", "left")
    made = {
        "max_intensity_mol": F.col("max_intensity"),
        "max_intensity_istd": F.col("_istd.intensity"),
        "rt_at_max_istd": F.col("_istd.rt"),
        "target_mz_istd": F.col("_istd.mz"),
        "molecule": F.lit(molecule_name),
        "istd": F.lit(standard_name),
        "max_intensity": F.try_divide("max_intensity", F.col("_istd.intensity")),
    }
    kept = [c for c in molecule.columns if c not in made]
    return both.select(*kept, *(value.alias(name) for name, value in made.items()))


def normalize_by_istd(
    molecule: DataFrame,
    standard: DataFrame,
    molecule_name: str = "Molecule",
    standard_name: str = "ISTD",
) -> DataFrame:
    """`normalise`, without the samples whose ratio is missing or zero."""
    return normalised_only(normalise(molecule, standard, molecule_name, standard_name))


def combine_results(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column one of them lacks becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine_molecules(**frames: DataFrame) -> DataFrame:
    """Stack max frames, each under its keyword as `molecule`; `molecule_ord` keeps the order.

    Each frame is a target of its own afterwards, even where two came from one: `target_id` becomes the place of the
    frame, `source_target_id` keeps what it was.
    """
    if not frames:
        raise ValueError("name at least one max frame, e.g. Caffeine=frame")
    stacked = []
    for place, (name, frame) in enumerate(frames.items()):
        require_columns(frame, ["file", "max_intensity"])
        if "target_id" in frame.columns:
            frame = frame.withColumn("source_target_id", F.col("target_id"))
        own = {"molecule": F.lit(name), "molecule_ord": F.lit(place), "target_id": F.lit(place).cast("long")}
        stacked.append(frame.withColumns(own))
    return combine_results(*stacked)
