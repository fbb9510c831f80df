"""Counts of a run's steps, taken from the rows as they pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import names
from ..operators.filters import with_signal
from ..operators.normalize import normalise
from ..operators.samples import dated_frame
from ..session import materialize

# Targets that a run counts apart: each takes six numbers of the plan's metrics.
MOST_COUNTED = 64

COUNTERS = ("n_kept", "n_excluded", "n_unmatched", "n_zero", "n_normalised", "n_samples")


def _counts(excluded: Column, ratio: Column) -> dict[str, Column]:
    """What counts towards each of COUNTERS."""
    return {
        "n_kept": ~excluded,
        "n_excluded": excluded,
        "n_unmatched": ~excluded & F.col("date_order").isNull(),
        "n_zero": ~excluded & (F.col("max_intensity") <= 0),
        "n_normalised": ratio.isNotNull(),
        "n_samples": F.lit(True),
    }


def processed_with_counters(
    max_values: DataFrame,
    standard: DataFrame,
    metadata: DataFrame,
    target_ids: Sequence[int],
    exclude_patterns: Sequence[str] = names.EXCLUDED_SAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """(kept, counters): the dated field samples with a signal and their `ratio` to the standard, and what the steps counted.

    counters: target_id and COUNTERS, one row for each of `target_ids`, as screening.run_counters has them. They are metrics
    of the one job that makes `kept`, which is written out here; no other pass reads the rows. Tasks that Spark
    repeats because an executor was lost may be counted again.
    """
    if len(target_ids) > MOST_COUNTED:
        raise ValueError(f"at most {MOST_COUNTED} targets can be counted apart")
    dated = dated_frame(max_values, metadata)
    ratios = normalise(dated.withColumn("_name", F.col("molecule")), standard)
    rows = ratios.withColumns({"ratio": F.col("max_intensity"), "max_intensity": F.col("max_intensity_mol"), "molecule": F.col("_name")})
    rows = rows.select(*dated.columns, "ratio")
    excluded = names.matches_any(F.col("file"), exclude_patterns)
    metrics = Observation()
    counts = [
        F.count_if((F.col("target_id") == target) & F.coalesce(test, F.lit(False))).alias(f"{name}_{i}")
        for i, target in enumerate(target_ids)
        for name, test in _counts(excluded, F.col("ratio")).items()
    ]
    observed = rows.observe(metrics, F.count("*").alias("rows"), *counts)
    kept = materialize(with_signal(observed.where(~excluded)))
    found = metrics.get
    table = [(target, *(found[f"{name}_{i}"] for name in COUNTERS)) for i, target in enumerate(target_ids)]
    kinds = ", ".join(f"{name} long" for name in ("target_id", *COUNTERS))
    return kept, max_values.sparkSession.createDataFrame(table, kinds)
