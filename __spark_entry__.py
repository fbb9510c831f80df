"""Entry points: one flagship query, every registered query, and its SQL twin."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402
from ionsieve import fixtures  # noqa: E402
from ionsieve.operators import distance, eic as eics, filters, metric_index, samples, stats  # noqa: E402
from ionsieve.operators.normalize import combine_molecules, normalize_by_istd  # noqa: E402
from ionsieve.operators.ordering import with_index  # noqa: E402
from ionsieve.operators.targets import prepare_targets  # noqa: E402
from ionsieve.plans import apex, counters, frames, incremental, screening  # noqa: E402
from ionsieve.session import materialize, scratch_folder  # noqa: E402
from ionsieve.sources import sinks, time_layout  # noqa: E402
from ionsieve.sources.manifest import files_without_peaks, manifest_from_listing, only_samples  # noqa: E402
from ionsieve.sources.metadata import as_metadata, latest_metadata  # noqa: E402

ONE_MASS = 155.0523
HIGH = 90_000.0
STANDARD = "mol_3"


class Data:
    """The derived tables of one folder, and the intermediate results built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def peaks(self) -> DataFrame:
        return fixtures.peaks(self.spark, self.sf_dir)

    @cached_property
    def manifest(self) -> DataFrame:
        return fixtures.manifest(self.spark, self.sf_dir)

    @cached_property
    def metadata(self) -> DataFrame:
        return fixtures.metadata(self.spark, self.sf_dir)

    @cached_property
    def targets(self):
        return prepare_targets(fixtures.molecules(self.spark, self.sf_dir))

    @cached_property
    def library(self):
        return prepare_targets(fixtures.library(self.spark, self.sf_dir))

    @cached_property
    def max_frame(self) -> DataFrame:
        return screening.max_frame(self.peaks, self.manifest, self.targets)

    @cached_property
    def saved_max(self) -> DataFrame:
        return materialize(self.max_frame)

    @cached_property
    def summary(self) -> DataFrame:
        return screening.summary_frame(self.peaks, self.manifest, self.targets)

    @cached_property
    def pairs(self) -> DataFrame:
        """Every pair of molecules that the target list names."""
        return stats.all_pairs(self.targets.table, "target_id")

    @cached_property
    def box_values(self) -> DataFrame:
        return frames.box_values(self.saved_max)


def _rounded(df: DataFrame, /, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name, places in digits.items()})


def _eic_columns(df: DataFrame, *more: str) -> DataFrame:
    return _rounded(df.select("molecule", "file", "rt", "intensity", "target_mz", *more), intensity=2)


# Chromatograms


def eic_single_target(d: Data) -> DataFrame:
    found = eics.eic_one_target(d.peaks, ONE_MASS, rt_range=(0.0, 30.0))
    return _rounded(found.select("file", "rt", "intensity", "target_mz"), intensity=2)


def eic_dataset(d: Data) -> DataFrame:
    found = screening.screen_one_mass(d.peaks, d.manifest, ONE_MASS)
    return _rounded(found.select("file", "pos", "rt", "intensity", "target_mz"), intensity=2)


def eic_rt_range(d: Data) -> DataFrame:
    return _eic_columns(
        screening.screen_molecules(d.peaks, d.targets, rt_range=(1.0, 3.0), min_intensity=20_000.0)
    )


def eic_multi_molecule(d: Data) -> DataFrame:
    return _eic_columns(screening.screen_molecules(d.peaks, d.targets))


def eic_multi_molecule_binned(d: Data) -> DataFrame:
    return _eic_columns(screening.screen_molecules(d.peaks, d.targets, broadcast=False))


def eic_library(d: Data) -> DataFrame:
    return _eic_columns(screening.screen_molecules(d.peaks, d.library))


def eic_per_scan(d: Data) -> DataFrame:
    found = eics.eic(d.peaks, d.targets, min_intensity=None, per_scan=True)
    return _eic_columns(eics.labelled(found, d.targets), "scanid")


def eic_overlay_subsample(d: Data) -> DataFrame:
    return _eic_columns(frames.eic_overlay(d.peaks, d.manifest, d.targets, max_samples=8))


def eic_compare(d: Data) -> DataFrame:
    two = filters.named(fixtures.molecules(d.spark, d.sf_dir), "mol_0").unionByName(
        filters.named(fixtures.molecules(d.spark, d.sf_dir), "mol_2")
    )
    points = frames.eic_compare(
        d.peaks, d.manifest, prepare_targets(two), max_samples=25, shown_rt=(1.0, 4.0)
    )
    return _eic_columns(points, "trace")


def eic_faceted(d: Data) -> DataFrame:
    return _eic_columns(frames.eic_faceted(d.peaks, d.manifest, d.targets), "facet")


# Suspect screening


def hits(d: Data) -> DataFrame:
    found = eics.labelled(eics.hits(d.peaks, d.targets, min_intensity=HIGH), d.targets)
    columns = ("molecule", "file", "rt", "scanid", "max_intensity", "mean_mz", "n_points")
    return _rounded(found.select(*columns), mean_mz=9)


def _screened(d: Data, targets) -> DataFrame:
    found = screening.suspect_screening(
        d.peaks, d.manifest, targets, min_intensity=HIGH, rounded=False, mass_digits=6
    )
    return _rounded(found, Observed_MZ=9, MZ_Error_ppm=6)


def suspect_screening(d: Data) -> DataFrame:
    return _screened(d, d.targets)


def suspect_screening_rounded(d: Data) -> DataFrame:
    found = screening.suspect_screening(d.peaks, d.manifest, d.targets, min_intensity=HIGH)
    # A mean that ends in a 5 by chance may round either way, as sums have no fixed order.
    return found.drop("Observed_MZ", "MZ_Error_ppm")


def suspect_screening_library(d: Data) -> DataFrame:
    return _screened(d, d.library)


def results_by_score(d: Data) -> DataFrame:
    found = screening.suspect_screening(d.peaks, d.manifest, d.targets, min_intensity=HIGH)
    return sinks.ranked_by_score(found).select("place", "Sample", "Compound", "Detection_Score", "Status")


def one_sample_only(d: Data) -> DataFrame:
    """Chromatograms of one sample that the user names."""
    return _eic_columns(screening.screen_molecules(only_samples(d.peaks, ["POOL_2023%201.parquet"]), d.targets))


def detected_compounds(d: Data) -> DataFrame:
    return filters.detected_compounds(_screened(d, d.targets))


# Summaries


def batch_summary(d: Data) -> DataFrame:
    columns = ("molecule", "file", "detected", "max_intensity", "rt_at_max", "n_points", "auc")
    return _rounded(d.summary.select(*columns), max_intensity=2, auc=6)


def max_intensities(d: Data) -> DataFrame:
    columns = ("molecule", "file", "max_intensity", "rt_at_max", "target_mz")
    return _rounded(d.max_frame.select(*columns), max_intensity=2)


def _heatmap(metric: str) -> Callable[[Data], DataFrame]:
    def query(d: Data) -> DataFrame:
        return _rounded(frames.heatmap(d.summary, metric).drop("file_id"), value=6)

    return query


# Samples and dates


def manifest_listing(d: Data) -> DataFrame:
    found = manifest_from_listing(fixtures.listing(d.spark, d.sf_dir))
    return with_index(materialize(found), [], [F.col("pos")], "place").select("place", "file_id", "file", "path", "folder", "url")


def metadata_from_text(d: Data) -> DataFrame:
    return latest_metadata(as_metadata(fixtures.text_metadata(d.spark, d.sf_dir)))


def metadata_latest(d: Data) -> DataFrame:
    return latest_metadata(d.metadata)


def date_labels_from_name(d: Data) -> DataFrame:
    return samples.with_date_labels(d.manifest).select("file", "date_label")


def date_labels_from_metadata(d: Data) -> DataFrame:
    return samples.with_date_labels(d.manifest, d.metadata).select("file", "date_label")


def reorder_by_date(d: Data) -> DataFrame:
    return samples.reorder_by_date(d.manifest, d.metadata).select(
        "file", "year", "month", "date_order", "display_name", "sample_idx"
    )


def date_span(d: Data) -> DataFrame:
    return samples.date_span(samples.with_dates(d.manifest, d.metadata))


def filter_samples(d: Data) -> DataFrame:
    return filters.keep_samples(d.manifest).select("file", "pos")


def filter_sample_paths(d: Data) -> DataFrame:
    return filters.keep_paths(d.manifest).select("file", "pos")


def missing_files(d: Data) -> DataFrame:
    found = eics.eic_one_target(d.peaks, ONE_MASS, min_intensity=HIGH)
    return files_without_peaks(d.manifest, found).select("file", "pos")


def run_counters(d: Data) -> DataFrame:
    standard = d.saved_max.where(F.col("molecule") == STANDARD)
    return screening.run_counters(d.saved_max, standard, d.metadata).drop("target_id")


def run_counters_observed(d: Data) -> DataFrame:
    """The same counts, from the metrics of the run that processes the results."""
    ids = [row.target_id for row in d.targets.table.select("target_id").collect()]
    standard = d.saved_max.where(F.col("molecule") == STANDARD)
    _, counted = counters.processed_with_counters(d.saved_max, standard, d.metadata, ids)
    return counted.join(d.targets.labels.select("target_id", "molecule"), "target_id").drop("target_id")


def incremental_max_frame(d: Data) -> DataFrame:
    """Two loads of samples, the second one with new samples and with some of the first again, whose peaks had been cut short."""
    path = scratch_folder(d.spark, "max-state")
    first = d.manifest.where("pos % 3 <> 0")
    short = d.peaks.where("rt < 2")
    incremental.update_max_frame(path, short.unionByName(d.peaks.where("rt >= 2 and file_id not like 'Sample%'")), first, d.targets, folders=8)
    second = d.manifest.where("pos % 3 = 0 or file like 'Sample%'")
    found = incremental.update_max_frame(path, d.peaks, second, d.targets, folders=8)
    return _rounded(found.select("molecule", "file", "max_intensity", "rt_at_max", "target_mz"), max_intensity=2)


def process_screening_results(d: Data) -> DataFrame:
    kept = screening.process_screening_results(d.saved_max, d.metadata)
    columns = ("molecule", "file", "display_name", "sample_idx", "max_intensity", "rt_at_max")
    return _rounded(kept.select(*columns), max_intensity=2)


# Normalisation and stacking


def normalize(d: Data) -> DataFrame:
    of = lambda name: d.saved_max.where(F.col("molecule") == name)
    ratios = normalize_by_istd(of("mol_0"), of(STANDARD), "mol_0", STANDARD)
    rounded = dict(max_intensity=9, max_intensity_mol=2, max_intensity_istd=2)
    return _rounded(ratios.drop("target_id", "file_id", "pos"), **rounded)


def _ordered_ratios(d: Data) -> DataFrame:
    """mol_0 against the standard after processing: kept samples in date order."""
    kept = screening.process_screening_results(d.saved_max, d.metadata)
    of = lambda name: kept.where(F.col("molecule") == name)
    return normalize_by_istd(of("mol_0"), of(STANDARD), "mol_0", STANDARD)


def normalized_line(d: Data) -> DataFrame:
    found = frames.intensity_line(_ordered_ratios(d), log_scale=False)
    columns = ("molecule", "file", "display_name", "date_order", "sample_idx", "tick", "plot_intensity")
    return _rounded(found.select(*columns), plot_intensity=9)


def combined_stripes(d: Data) -> DataFrame:
    """The maxima and the ratios of one molecule as two stripes."""
    raw = d.saved_max.where(F.col("molecule") == "mol_0")
    ratios = normalize_by_istd(raw, d.saved_max.where(F.col("molecule") == STANDARD), "mol_0", STANDARD)
    found = frames.stripes(combine_molecules(Raw=raw, Normalised=ratios))
    columns = ("molecule", "molecule_ord", "file", "sample_idx", "plot_intensity", "midpoint")
    return _rounded(found.select(*columns), plot_intensity=9, midpoint=9)


def combine(d: Data) -> DataFrame:
    of = lambda name: d.saved_max.where(F.col("molecule") == name)
    stacked = combine_molecules(First=of("mol_1"), Second=of("mol_2"))
    return _rounded(stacked.select("molecule", "file", "max_intensity", "rt_at_max"), max_intensity=2)


# Spectra


def apex_rt_tolerance(d: Data) -> DataFrame:
    windows = apex.apex_window_frame(d.peaks, d.targets)
    found = eics.labelled(windows, d.targets)
    return _rounded(found.select("molecule", "file", "apex_rt", "n_near", "rt_tolerance"), rt_tolerance=9)


def _spectrum(mslevel: str) -> Callable[[Data], DataFrame]:
    def query(d: Data) -> DataFrame:
        windows = apex.apex_window_frame(d.peaks, d.targets)
        lines = apex.spectrum_at_apex(d.peaks, d.targets, windows, mslevel)
        columns = lines.select("molecule", "file", "mz", "intensity", "base_peak")
        return _rounded(columns, intensity=2, base_peak=2)

    return query


def _given_spectrum(mslevel: str) -> Callable[[Data], DataFrame]:
    """Spectra at three given times of every chromatogram, the last one without any point near it."""

    def query(d: Data) -> DataFrame:
        times = F.explode(F.array(F.lit(1.0), F.lit(2.5), F.lit(9.0))).alias("rt")
        given = d.manifest.select("file_id").crossJoin(d.targets.table.select("target_id")).select("target_id", "file_id", times)
        windows = apex.apex_window_frame(d.peaks, d.targets, given_rt=given)
        lines = apex.spectrum_at_apex(d.peaks, d.targets, windows, mslevel)
        columns = lines.select("molecule", "file", "apex_rt", "mz", "intensity", "base_peak")
        return _rounded(columns, intensity=2, base_peak=2)

    return query


def spectrum_from_time_layout(d: Data) -> DataFrame:
    """MS2 spectra from peaks that are laid out by sample and time; only files that the windows touch are opened."""
    path = scratch_folder(d.spark, "time-layout")
    time_layout.write_time_layout(d.peaks, path, 24)
    windows = apex.apex_window_frame(d.peaks, d.targets)
    bounds = windows.select("file_id", (F.col("apex_rt") - F.col("rt_tolerance")).alias("lo"), (F.col("apex_rt") + F.col("rt_tolerance")).alias("hi"))
    lines = apex.spectrum_at_apex(time_layout.peaks_in_windows(d.spark, path, bounds, "2"), d.targets, windows, "2")
    return _rounded(lines.select("molecule", "file", "mz", "intensity", "base_peak"), intensity=2, base_peak=2)


def given_rt_windows(d: Data) -> DataFrame:
    given = d.manifest.select("file_id").crossJoin(d.targets.table.select("target_id"))
    given = given.select("target_id", "file_id", F.explode(F.array(F.lit(1.0), F.lit(2.5), F.lit(9.0))).alias("rt"))
    found = eics.labelled(apex.apex_window_frame(d.peaks, d.targets, given_rt=given), d.targets)
    return _rounded(found.select("molecule", "file", "apex_rt", "n_near", "rt_tolerance"), rt_tolerance=9)


def spectrum_rt_range(d: Data) -> DataFrame:
    lines = eics.spectrum(d.peaks, "2", (1.0, 2.5))
    return _rounded(lines.withColumnRenamed("file_id", "file"), intensity=2)


# Plot frames over a saved max frame


def stripes(d: Data) -> DataFrame:
    found = frames.stripes(d.saved_max, x_labels="date", metadata=d.metadata)
    columns = ("molecule", "file", "sample_idx", "date_label", "tick", "plot_intensity", "midpoint")
    return _rounded(found.select(*columns), plot_intensity=6, midpoint=6)


def stripes_color_bucket(d: Data) -> DataFrame:
    return frames.stripe_colours(d.saved_max).select("molecule", "file", "bucket")


def interactive_stripes(d: Data) -> DataFrame:
    found = frames.interactive_stripes(d.saved_max, x_labels="date", metadata=d.metadata)
    columns = ("molecule", "file", "sample_idx", "date_label", "tick", "plot_intensity", "bucket")
    return _rounded(found.select(*columns), plot_intensity=6)


def intensity_line(d: Data) -> DataFrame:
    ordered = screening.process_screening_results(d.saved_max, d.metadata)
    found = frames.intensity_line(ordered, x_labels="year", metadata=d.metadata)
    columns = ("molecule", "display_name", "sample_idx", "date_label", "tick", "plot_intensity")
    return _rounded(found.select(*columns), plot_intensity=6)


def multi_stripes_matrix(d: Data) -> DataFrame:
    return _rounded(frames.multi_stripes(d.saved_max).drop("target_id", "file_id"), plot_intensity=6)


# The wide grid's columns are part of the query, as a user gives them.
WIDE = range(5)


def _wide(cells: DataFrame) -> DataFrame:
    wide = frames.multi_stripes_wide(cells, "target_id", list(WIDE)).drop("file_id")
    named = wide.withColumnsRenamed({str(i): f"mol_{i}" for i in WIDE})
    return _rounded(named, **{f"mol_{i}": 6 for i in WIDE})


def multi_stripes_wide(d: Data) -> DataFrame:
    return _wide(frames.multi_stripes(d.saved_max))


def _kept(d: Data) -> DataFrame:
    """Cells of field samples with a signal: a grid with holes."""
    return frames.multi_stripes(filters.with_signal(filters.keep_samples(d.saved_max)))


def multi_stripes_wide_processed(d: Data) -> DataFrame:
    return _wide(_kept(d))


def _profiles(cells: DataFrame, of: str) -> DataFrame:
    return materialize(frames.profiles(cells, of))


def molecule_distance(d: Data) -> DataFrame:
    return _molecule_distances(d, frames.multi_stripes(d.saved_max))


def molecule_distance_processed(d: Data) -> DataFrame:
    return _molecule_distances(d, _kept(d))


def _molecule_distances(d: Data, cells: DataFrame) -> DataFrame:
    found = distance.pairwise_distances(_profiles(cells, "molecule"))
    names = lambda i: d.targets.labels.select(F.col("target_id").alias(f"item_{i}"), F.col("molecule").alias(f"name_{i}"))
    named = found.join(names(1), "item_1").join(names(2), "item_2")
    return _rounded(named.select(F.col("name_1").alias("item_1"), F.col("name_2").alias("item_2"), "distance"), distance=6)


def _leaves(d: Data, of: str) -> DataFrame:
    return frames.cluster_order(d.saved_max, of)[0]


def cluster_order_molecules(d: Data) -> DataFrame:
    named = _leaves(d, "molecule").join(d.targets.labels, F.col("item") == F.col("target_id"))
    return _rounded(named.select("molecule", "place", "height"), height=6)


def cluster_order_samples(d: Data) -> DataFrame:
    return _rounded(_leaves(d, "file").select(F.col("item").alias("file"), "place", "height"), height=6)


def cluster_merges_samples(d: Data) -> DataFrame:
    return _rounded(frames.cluster_order(d.saved_max, "file")[1], height=6)


def sample_distance(d: Data) -> DataFrame:
    return _rounded(distance.pairwise_distances(_profiles(frames.multi_stripes(d.saved_max), "file")), distance=6)


def nearest_profile(d: Data) -> DataFrame:
    return _rounded(distance.nearest_profiles(_profiles(frames.multi_stripes(d.saved_max), "file")), distance=6)


def nearest_profile_processed(d: Data) -> DataFrame:
    return _rounded(distance.nearest_profiles(_profiles(_kept(d), "file")), distance=6)


# Neighbours of each sample.
NEAREST = 5


def nearest_k_profiles(d: Data) -> DataFrame:
    found = metric_index.nearest_k(_profiles(frames.multi_stripes(d.saved_max), "file"), NEAREST)
    return _rounded(found, distance=6)


def nearest_k_profiles_processed(d: Data) -> DataFrame:
    return _rounded(metric_index.nearest_k(_profiles(_kept(d), "file"), NEAREST), distance=6)


def box_compare_frame(d: Data) -> DataFrame:
    return _rounded(d.box_values.drop("file_id", "target_id"), value=6)


def box_stats(d: Data) -> DataFrame:
    rounded = {name: 6 for name in ("q1", "median", "q3", "whisker_low", "whisker_high")}
    return _rounded(stats.box_statistics(d.box_values).drop("target_id"), **rounded)


# Tests between molecules


KEYS = ("target_1", "target_2")


def wilcoxon_signed_rank_stat(d: Data) -> DataFrame:
    return _rounded(stats.signed_rank(d.box_values, d.pairs).drop(*KEYS), p=6)


def rank_sum_stat(d: Data) -> DataFrame:
    return _rounded(stats.rank_sum(d.box_values, d.pairs).drop(*KEYS), p=6)


def t_test_paired(d: Data) -> DataFrame:
    found = stats.paired_t(d.box_values, d.pairs).drop(*KEYS)
    return _rounded(found, statistic=6, mean_difference=6, p=6)


def t_test_welch(d: Data) -> DataFrame:
    found = stats.welch_t(d.box_values, d.pairs).drop(*KEYS)
    return _rounded(found, statistic=6, df=6, mean_1=6, mean_2=6, p=6)


def pairwise_tests(d: Data) -> DataFrame:
    found = stats.compare(d.box_values, d.pairs)
    for test, paired in (("wilcox.test", False), ("t.test", True), ("t.test", False)):
        found = found.unionByName(stats.compare(d.box_values, d.pairs, test, paired))
    return _rounded(found.drop(*KEYS), statistic=6, p=6)


QUERIES: dict[str, Callable[[Data], DataFrame]] = {
    "eic_single_target": eic_single_target,
    "eic_dataset": eic_dataset,
    "eic_rt_range": eic_rt_range,
    "eic_multi_molecule": eic_multi_molecule,
    "eic_multi_molecule_binned": eic_multi_molecule_binned,
    "eic_library": eic_library,
    "eic_per_scan": eic_per_scan,
    "eic_overlay_subsample": eic_overlay_subsample,
    "eic_compare": eic_compare,
    "eic_faceted": eic_faceted,
    "hits": hits,
    "suspect_screening": suspect_screening,
    "suspect_screening_rounded": suspect_screening_rounded,
    "suspect_screening_library": suspect_screening_library,
    "results_by_score": results_by_score,
    "one_sample_only": one_sample_only,
    "detected_compounds": detected_compounds,
    "batch_summary": batch_summary,
    "max_intensities": max_intensities,
    "heatmap_max": _heatmap("max_intensity"),
    "heatmap_auc": _heatmap("auc"),
    "heatmap_detected": _heatmap("detected"),
    "manifest_listing": manifest_listing,
    "metadata_from_text": metadata_from_text,
    "metadata_latest": metadata_latest,
    "date_labels_from_name": date_labels_from_name,
    "date_labels_from_metadata": date_labels_from_metadata,
    "reorder_by_date": reorder_by_date,
    "date_span": date_span,
    "filter_samples": filter_samples,
    "filter_sample_paths": filter_sample_paths,
    "missing_files": missing_files,
    "run_counters": run_counters,
    "run_counters_observed": run_counters_observed,
    "incremental_max_frame": incremental_max_frame,
    "process_screening_results": process_screening_results,
    "normalize_by_istd": normalize,
    "normalized_line": normalized_line,
    "combine_molecules": combine,
    "combined_stripes": combined_stripes,
    "apex_rt_tolerance": apex_rt_tolerance,
    "spectrum_at_apex_ms1": _spectrum("1"),
    "spectrum_at_apex_ms2": _spectrum("2"),
    "spectrum_from_time_layout": spectrum_from_time_layout,
    "given_rt_windows": given_rt_windows,
    "spectrum_at_given_rt_ms1": _given_spectrum("1"),
    "spectrum_at_given_rt_ms2": _given_spectrum("2"),
    "spectrum_rt_range": spectrum_rt_range,
    "stripes": stripes,
    "stripes_color_bucket": stripes_color_bucket,
    "interactive_stripes": interactive_stripes,
    "intensity_line": intensity_line,
    "multi_stripes_matrix": multi_stripes_matrix,
    "multi_stripes_wide": multi_stripes_wide,
    "multi_stripes_wide_processed": multi_stripes_wide_processed,
    "molecule_distance": molecule_distance,
    "molecule_distance_processed": molecule_distance_processed,
    "sample_distance": sample_distance,
    "cluster_order_molecules": cluster_order_molecules,
    "cluster_order_samples": cluster_order_samples,
    "cluster_merges_samples": cluster_merges_samples,
    "nearest_k_profiles": nearest_k_profiles,
    "nearest_k_profiles_processed": nearest_k_profiles_processed,
    "nearest_profile": nearest_profile,
    "nearest_profile_processed": nearest_profile_processed,
    "box_compare_frame": box_compare_frame,
    "box_stats": box_stats,
    "wilcoxon_signed_rank_stat": wilcoxon_signed_rank_stat,
    "rank_sum_stat": rank_sum_stat,
    "t_test_paired": t_test_paired,
    "t_test_welch": t_test_welch,
    "pairwise_tests": pairwise_tests,
}


def entry(spark: SparkSession) -> DataFrame:
    """Maximum and apex of every molecule in every sample, from one scan."""
    return max_intensities(Data(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query: Callable[[Data], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Data(spark, sf_dir))

    return {name: bound(query) for name, query in QUERIES.items()} | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | _training_data()[1]


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators and their pipeline, where these are installed."""
    try:
        import corpus_pipeline
        from ionsieve.llm import queries as training
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "ionsieve.llm"):
            raise
        return {}, {}
    found, sql = dict(training.QUERIES), dict(training.ORACLES)
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql
