"""Shapes of the physical plans that make the engine scale."""

import contextlib
import io
import re

import pytest

from ionsieve import fixtures, prepare_targets, read_peaks, targets_of, write_peaks
from ionsieve.operators import eic as eics
from ionsieve.operators.ranges import join_ranges
from ionsieve.operators.spectra import apex_windows, spectra_in_windows
from ionsieve.plans import screening
from ionsieve.session import materialize
from plan_text import plan_of



@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Peaks in the written layout."""
    path = str(tmp_path_factory.mktemp("layout") / "peaks")
    write_peaks(fixtures.peaks(spark, sf_dir), path, partitions=6)
    return read_peaks(spark, path)


@pytest.fixture(scope="module")
def targets(spark, sf_dir):
    return prepare_targets(fixtures.molecules(spark, sf_dir))


def test_one_mass_prunes_folders_and_row_groups(stored):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        eics.eic_one_target(stored, 155.0523, rt_range=(1.0, 2.0)).explain("formatted")
    plan = text.getvalue()
    pushed = re.search(r"PushedFilters: (.*)", plan).group(1)
    assert "GreaterThanOrEqual(mz,155.0423)" in pushed and "LessThanOrEqual(mz,155.0623)" in pushed
    assert "GreaterThanOrEqual(rt,1.0)" in pushed and "GreaterThanOrEqual(intensity,0.0)" in pushed
    assert "mslevel" in re.search(r"PartitionFilters: (.*)", plan).group(1)
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "scanid" not in schema


def test_target_list_is_pushed_as_ranges(stored, targets):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        eics.eic(stored, targets).explain("formatted")
    pushed = re.search(r"PushedFilters: (.*)", text.getvalue()).group(1)
    assert pushed.count("Or(") >= len(targets.scan_ranges) - 1


def test_molecules_share_one_scan_and_one_shuffle_of_points(stored, targets):
    plan = plan_of(eics.eic(stored, targets), run=True)
    assert plan.count("FileScan parquet [scanid") + plan.count("FileScan parquet [file_id") == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "partial_sum" in plan and "NestedLoop" not in plan


def peak_scans(plan):
    return sum("mz" in columns for columns in re.findall(r"FileScan parquet \[(.*?)\]", plan))


def test_apex_windows_scan_once(stored, targets):
    windows = apex_windows(eics.eic(stored, targets, min_intensity=None, per_scan=True))
    assert peak_scans(plan_of(windows, run=True)) == 1
    lines = spectra_in_windows(stored, materialize(windows), "1")
    assert peak_scans(plan_of(lines, run=True)) == 1


def test_shuffled_range_join(spark, stored, targets):
    """Without broadcasts the salted equi join gives the same rows, from one scan."""
    few = eics.eic(stored, targets).count()
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1")
        shuffled = eics.eic(stored, targets, broadcast=False)
        plan = plan_of(shuffled, run=True)
        assert "SortMergeJoin [_bin" in plan and "_salt" in plan and "Broadcast" not in plan
        assert shuffled.count() == few
        lines = spectra_in_windows(stored, spark.createDataFrame([], "target_id long, file_id string, apex_rt double, rt_tolerance double"), "1")
        assert lines.count() == 0
    finally:
        for name in names:
            spark.conf.unset(name)


def test_summary_orders_minutes_not_chromatograms(stored, targets, spark, sf_dir):
    found = screening.summary_frame(stored, fixtures.manifest(spark, sf_dir), targets)
    windows = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan_of(found))
    assert any("_cell" in spec and "rt#" in spec for spec in windows)
    assert not any("rt#" in spec and "_cell" not in spec for spec in windows)


def test_range_join_keeps_other_keys(spark):
    points = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "f string, v double")
    windows = spark.createDataFrame([("a", 0.0, 2.0)], "f string, lo double, hi double")
    for salts in (1, 4):
        assert join_ranges(points, windows, "v", 0.25, on=["f"], salts=salts).count() == 1


def test_empty_target_list(spark, stored):
    empty = spark.createDataFrame([], "name string, mz double")
    assert eics.eic(stored, prepare_targets(empty)).count() == 0
    assert eics.eic(stored, targets_of(spark, [("far", 5000.0)])).count() == 0
