"""Frames that are ready to plot: overlays, heatmaps, stripes, trends, boxes.

Frames built on a max frame read it more than once: pass it materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scoring
from ..operators import clustering, distance
from ..operators.eic import eic, labelled
from ..operators.ordering import evenly_spaced, quantiles, with_index
from ..operators.samples import in_date_order, labelled_frame
from ..operators.stats import box_statistics, compare
from ..operators.targets import Targets
from ..session import BROADCAST_MAX_ROWS, materialize

X_LABELS = ("file", "date", "year", "none")


def eic_overlay(
    peaks: DataFrame,
    manifest: DataFrame,
    targets: Targets,
    max_samples: int | None = None,
    per_scan: bool = False,
    **limits,
) -> DataFrame:
    """Chromatogram points of all samples, or of `max_samples` evenly spaced ones.

    The samples are chosen first, so the points of the others are never summed.
    """
    if max_samples is not None:
        chosen = evenly_spaced(manifest, max_samples).select("file_id")
        if max_samples <= BROADCAST_MAX_ROWS:
            chosen = F.broadcast(chosen)
        peaks = peaks.join(chosen, "file_id", "left_semi")
    return labelled(eic(peaks, targets, per_scan=per_scan, **limits), targets)


def eic_compare(
    peaks: DataFrame,
    manifest: DataFrame,
    targets: Targets,
    max_samples: int | None = None,
    shown_rt: tuple[float, float] | None = None,
    **limits,
) -> DataFrame:
    """Chromatograms of several molecules with one trace per molecule and sample.

    `shown_rt` crops the time axis only; nothing is summed differently.
    """
    points = eic_overlay(peaks, manifest, targets, max_samples, **limits)
    if shown_rt is not None:
        points = points.where(F.col("rt").between(*shown_rt))
    return points.withColumn("trace", F.concat_ws("_", "molecule", "file"))


def eic_faceted(peaks: DataFrame, manifest: DataFrame, targets: Targets, **limits) -> DataFrame:
    """Chromatogram points with the facet they belong to: one per sample with points."""
    return eic_overlay(peaks, manifest, targets, **limits).withColumn("facet", F.col("file"))


def heatmap(summary: DataFrame, metric: str = "max_intensity") -> DataFrame:
    """Cell values of molecule against sample, for every pair."""
    return summary.select("molecule", "file_id", "file", scoring.heat_value(metric).alias("value"))


def sample_axis(
    max_values: DataFrame, x_labels: str = "file", metadata: DataFrame | None = None
) -> DataFrame:
    """Add `sample_idx`, `date_label` and `tick` (the label where it is drawn, else null).

    Samples keep their order: by date if the frame was reordered, else by
    `pos`. A date or year is drawn where it first occurs.
    """
    if x_labels not in X_LABELS:
        raise ValueError(f"x_labels must be one of {', '.join(X_LABELS)}")
    if "sample_idx" in max_values.columns:
        placed = max_values
    elif "date_order" in max_values.columns:
        placed = in_date_order(max_values, ["target_id"], "sample_idx")
    else:
        placed = with_index(max_values, ["target_id"], [F.col("pos"), F.col("file_id")], "sample_idx")
    # A frame ordered by date shows, and is labelled by, its display names.
    name = "display_name" if "display_name" in placed.columns else "file"
    if x_labels in ("file", "none"):
        label = F.col(name) if x_labels == "file" else F.lit(None).cast("string")
        return placed.withColumn("date_label", F.lit(None).cast("string")).withColumn("tick", label)
    dated = labelled_frame(placed, metadata, name)
    if x_labels == "year":
        dated = dated.withColumn("date_label", names.year_part(F.col("date_label")))
    firsts = (
        dated.groupBy("target_id", "date_label")
        .agg(F.min("sample_idx").alias("sample_idx"))
        .select("target_id", "sample_idx", F.col("date_label").alias("tick"))
    )
    return dated.join(firsts, ["target_id", "sample_idx"], "left")


def intensity_line(
    max_values: DataFrame,
    log_scale: bool = True,
    x_labels: str = "file",
    metadata: DataFrame | None = None,
) -> DataFrame:
    """Trend of the maximum over the samples of each molecule."""
    axis = sample_axis(max_values, x_labels, metadata)
    return axis.withColumn(
        "plot_intensity", scoring.plot_intensity(F.col("max_intensity"), log_scale)
    )


def stripes(
    max_values: DataFrame,
    log_scale: bool = True,
    x_labels: str = "file",
    metadata: DataFrame | None = None,
) -> DataFrame:
    """One stripe per sample of each molecule, with the colour scale's midpoint."""
    line = intensity_line(max_values, log_scale, x_labels, metadata)
    return line.join(colour_midpoint(max_values, log_scale, ["target_id"]), "target_id")


def colour_midpoint(max_values: DataFrame, log_scale: bool, keys: list[str]) -> DataFrame:
    """Median plot value per group, for a diverging scale."""
    plotted = _plotted(max_values, log_scale)
    return quantiles(plotted, keys, "plot_intensity", {"midpoint": 0.5})


def stripe_colours(max_values: DataFrame, log_scale: bool = True) -> DataFrame:
    """Colour bucket 1..100 of each stripe, over the range of its molecule."""
    plotted = _plotted(max_values, log_scale)
    value = F.col("plot_intensity")
    span = plotted.groupBy("target_id").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    bucket = scoring.colour_bucket(value, F.col("_low"), F.col("_high"))
    return plotted.join(span, "target_id").withColumn("bucket", bucket).drop("_low", "_high")


def interactive_stripes(
    max_values: DataFrame,
    log_scale: bool = True,
    x_labels: str = "file",
    metadata: DataFrame | None = None,
) -> DataFrame:
    """One frame for an interactive stripes chart: position, labels, tick, value and colour bucket."""
    return stripe_colours(sample_axis(max_values, x_labels, metadata), log_scale)


def multi_stripes(max_values: DataFrame, log_scale: bool = True) -> DataFrame:
    """Cells of molecule against sample; the same grid feeds the distances."""
    columns = ["target_id", "molecule", "file_id", "file", "plot_intensity"]
    return _plotted(max_values, log_scale).select(*columns)


def multi_stripes_wide(cells: DataFrame, across: str, keys: list) -> DataFrame:
    """The grid with one column per listed key, missing cells 0: `across` is "target_id" or "file_id".

    The rows carry key and name of the other side, so equal names stay apart. Targets across and samples down suits any
    number of samples.
    """
    if across not in ("target_id", "file_id"):
        raise ValueError("a grid has 'target_id' or 'file_id' across")
    down = ["file_id", "file"] if across == "target_id" else ["target_id", "molecule"]
    return distance.wide_matrix(cells, down, across, "plot_intensity", keys)


def profiles(cells: DataFrame, of: str) -> DataFrame:
    """Profiles of the "molecule"s (items: target_id) or of the samples ("file", items: file_id) in a grid of cells."""
    if of not in ("molecule", "file"):
        raise ValueError("profiles are of 'molecule' or 'file'")
    item, dimension = ("target_id", "file_id") if of == "molecule" else ("file_id", "target_id")
    return distance.profile_chunks(cells, item, dimension, "plot_intensity")


# Distances are compared to so many digits, as sums have no fixed order.
DISTANCE_DIGITS = 9


def cluster_order(max_values: DataFrame, of: str, log_scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """(leaves, merges) of the complete-linkage tree of the "molecule"s or of the samples ("file"): rows and columns of the grid
    in the order in which a clustered stripes chart draws them. See clustering.cluster_tree.

    Equals go by list order: target_id, or a sample's pos and path. Items are keys: target_id or file_id.
    """
    cells = multi_stripes(max_values, log_scale)
    first, groups = distance.alike(materialize(profiles(cells, of)))
    first = materialize(first)
    pairs = distance.pairwise_distances(first)
    pairs = pairs.withColumn("distance", F.round("distance", DISTANCE_DIGITS))
    item, order = ("target_id", ["item"]) if of == "molecule" else ("file_id", ["pos", "item"])
    known = [F.first("pos").alias("pos")] if of == "file" else []
    items = max_values.groupBy(F.col(item).alias("item")).agg(F.lit(0).alias("_"), *known)
    return clustering.cluster_tree(pairs, items, [F.col(x) for x in order], groups, first, DISTANCE_DIGITS)


def box_values(max_values: DataFrame, log_scale: bool = True) -> DataFrame:
    """Values that boxes and tests are made of: target_id, molecule, file_id, file, value."""
    value: Column = scoring.plot_intensity(F.col("max_intensity"), log_scale)
    return max_values.select("target_id", "molecule", "file_id", "file", value.alias("value"))


def box_comparison(
    max_values: DataFrame,
    pairs: DataFrame,
    log_scale: bool = True,
    test: str = "wilcox.test",
    paired: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(points, boxes, tests) of a box plot; no tests for test="none"."""
    values = box_values(max_values, log_scale)
    tests = None if test == "none" else compare(values, pairs, test, paired)
    return values, box_statistics(values), tests


def _plotted(max_values: DataFrame, log_scale: bool) -> DataFrame:
    value = scoring.plot_intensity(F.col("max_intensity"), log_scale)
    return max_values.withColumn("plot_intensity", value)
