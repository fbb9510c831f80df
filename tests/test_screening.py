"""Chromatograms, summaries and screening against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ionsieve import prepare_targets, targets_of
from ionsieve.operators import eic as eics
from ionsieve.operators import summary
from ionsieve.operators.normalize import combine_molecules, normalise, normalize_by_istd
from ionsieve.operators.ranges import join_ranges
from ionsieve.operators.targets import merged_ranges
from ionsieve.plans import apex, frames, screening
from ionsieve.schemas import PEAKS
from plan_text import plan_of

TARGETS = [("one", 100.00512), ("two", 100.01512), ("far", 250.00012)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = []
    for i in range(3000):
        # A third of all peaks sit in one file and on one mass.
        hot = i % 3 == 0
        made.append(
            (
                "hot.parquet" if hot else f"s{rng.randrange(6)}.parquet",
                rng.choice("12"),
                rng.randrange(40),
                rng.randrange(200) / 20,
                100.01 if hot else round(rng.uniform(99.98, 100.05), 3),
                float(rng.randrange(1, 5000)),
            )
        )
    return made


@pytest.fixture(scope="module")
def peaks(spark, rows):
    return spark.createDataFrame(rows, PEAKS)


@pytest.fixture(scope="module")
def manifest(spark):
    files = [f"s{i}.parquet" for i in range(6)] + ["hot.parquet", "empty.parquet"]
    return spark.createDataFrame(
        [(file, file, i) for i, file in enumerate(files)], "file_id string, file string, pos long"
    )


@pytest.fixture(scope="module")
def targets(spark):
    return targets_of(spark, TARGETS)


def brute_eic(rows, level="1", floor=0.0, rt=(0, 1e9)):
    sums = defaultdict(float)
    for file, mslevel, scan, time, mz, height in rows:
        for name, mass in TARGETS:
            inside = mass - 0.01 <= mz <= mass + 0.01
            if mslevel == level and inside and height >= floor and rt[0] <= time <= rt[1]:
                sums[name, file, time] += height
    return dict(sums)


def as_eic(df):
    return {(r.molecule, r.file, r.rt): r.intensity for r in df.collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_eic_is_brute_force(peaks, targets, rows, broadcast):
    found = screening.screen_molecules(peaks, targets, broadcast=broadcast)
    assert as_eic(found) == brute_eic(rows)
    limits = dict(rt_range=(2.0, 6.5), min_intensity=900.0, broadcast=broadcast)
    assert as_eic(screening.screen_molecules(peaks, targets, **limits)) == brute_eic(
        rows, floor=900.0, rt=(2.0, 6.5)
    )


def test_one_at_a_time_equals_all_at_once(peaks, targets, rows):
    everything = brute_eic(rows)
    for name, mass in TARGETS:
        found = eics.eic_one_target(peaks, mass)
        assert {(name, r.file, r.rt): r.intensity for r in found.collect()} == {
            key: value for key, value in everything.items() if key[0] == name
        }


def test_sums_do_not_hang_on_the_order_of_points(spark):
    values = {"a": (0.1, 0.2, 0.3), "b": (0.3, 0.2, 0.1), "c": (0.2, 0.3, 0.1), "big": (1e300, 1e300), "nan": (1.0, float("nan")), "sum": (9e14,) * 3}
    made = [(file, "1", 1, 1.0, 100.0, x) for file, points in values.items() for x in points]
    peaks = spark.createDataFrame(made, PEAKS).coalesce(1)
    found = {x.file: x.intensity for x in eics.eic_one_target(peaks, 100.0).collect()}
    assert found["a"] == found["b"] == found["c"] == 0.6
    assert found["big"] == 2e300 and found["nan"] != found["nan"] and found["sum"] == 27e14


def test_totals_and_wider_tolerance(spark, peaks, targets):
    narrow = as_eic(screening.screen_molecules(peaks, targets))
    wide = as_eic(screening.screen_molecules(peaks, targets_of(spark, TARGETS, 0.015)))
    assert all(wide[key] >= value for key, value in narrow.items())
    matched = eics.matched_points(peaks, targets).agg(F.sum("intensity")).first()[0]
    assert sum(narrow.values()) == pytest.approx(matched)


def test_integer_ms_level(peaks, targets, rows):
    numbers = peaks.withColumn("mslevel", F.col("mslevel").cast("int"))
    assert as_eic(screening.screen_molecules(numbers, targets, mslevel="2")) == brute_eic(rows, "2")


def test_summary(peaks, manifest, targets, rows):
    curves = defaultdict(list)
    for (name, file, time), height in brute_eic(rows).items():
        curves[name, file].append((time, height))
    found = screening.summary_frame(peaks, manifest, targets).collect()
    assert len(found) == 8 * 3
    for row in found:
        curve = sorted(curves[row.molecule, row.file])
        assert row.n_points == len(curve)
        assert row.detected == bool(curve)
        if not curve:
            assert (row.max_intensity, row.rt_at_max, row.auc) == (None, None, None)
            continue
        top = max(height for _, height in curve)
        assert row.max_intensity == top
        assert row.rt_at_max == min(time for time, height in curve if height == top)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
        assert row.auc == pytest.approx(area if len(curve) > 1 else top)


def chromatogram(spark, *points):
    return spark.createDataFrame(
        [(1, "f", float(rt), float(height)) for rt, height in points],
        "target_id long, file_id string, rt double, intensity double",
    )


def test_area_and_apex_cases(spark):
    assert summary.curve_summary(chromatogram(spark, (4, 7))).first().auc == 7
    assert summary.curve_summary(chromatogram(spark, (0, 2), (1, 4), (3, 0))).first().auc == 7
    assert summary.apexes(chromatogram(spark, (3, 9), (1, 9), (2, 1))).first().rt_at_max == 1


def test_max_frame_of_missing_sample(peaks, manifest, targets):
    rows = screening.max_frame(peaks, manifest, targets).where("file = 'empty.parquet'").collect()
    assert [(r.max_intensity, r.rt_at_max, r.target_mz) for r in rows] == [(0.0, None, None)] * 3


def test_hits_and_screening(peaks, manifest, targets, rows):
    scans = defaultdict(list)
    for file, level, scan, rt, mz, height in rows:
        for name, mass in TARGETS:
            if level == "1" and mass - 0.01 <= mz <= mass + 0.01 and height >= 1000 and rt <= 30:
                scans[name, file, rt, scan].append((mz, height))
    groups = defaultdict(list)
    for (name, file, _, _), points in scans.items():
        mean = sum(mz for mz, _ in points) / len(points)
        groups[name, file].append((mean, max(height for _, height in points)))
    found = screening.suspect_screening(peaks, manifest, targets, rounded=False).collect()
    assert len(found) == 8 * 3
    for row in found:
        group = groups[row.Compound, row.Sample]
        assert row.N_Detections == len(group)
        assert row.Detection_Score == min(100, len(group) * 10)
        assert row.Max_Intensity == max((height for _, height in group), default=0)
        if group:
            mean = sum(mz for mz, _ in group) / len(group)
            assert row.Observed_MZ == pytest.approx(mean, rel=1e-12)
            ppm = (mean - row.Exact_Mass) / row.Exact_Mass * 1e6
            assert row.MZ_Error_ppm == pytest.approx(ppm, abs=1e-6)
        else:
            assert (row.Observed_MZ, row.MZ_Error_ppm, row.Status) == (None, None, "Not Detected")


@pytest.mark.parametrize(
    "n, score, status",
    [(0, 0, "Not Detected"), (5, 50, "Tentative"), (6, 60, "Detected"), (12, 100, "Detected")],
)
def test_score_and_status(spark, n, score, status):
    from ionsieve.functions import scoring

    points = scoring.detection_score(F.lit(n))
    row = spark.range(1).select(points.alias("s"), scoring.detection_status(points).alias("t")).first()
    assert (row.s, row.t) == (score, status)


def test_rounding_is_half_to_even(spark, manifest):
    peak = [("s0.parquet", "1", 1, 1.0, 100.0, 2000.5), ("s1.parquet", "1", 1, 1.0, 100.0, 2001.5)]
    table = spark.createDataFrame(peak, PEAKS)
    found = screening.suspect_screening(table, manifest, targets_of(spark, [("x", 100.00012)]))
    tops = {row.Sample: row.Max_Intensity for row in found.collect()}
    assert (tops["s0.parquet"], tops["s1.parquet"]) == (2000, 2002)


def test_repeated_target_names(spark, peaks, rows):
    twice = targets_of(spark, [TARGETS[0], TARGETS[0]])
    found = screening.screen_molecules(peaks, twice).count()
    assert found == 2 * sum(key[0] == "one" for key in brute_eic(rows))


def test_long_target_lists(spark, peaks):
    """A list past the listing bound: condensed ranges, the same matches."""
    many = spark.range(2000).select(
        F.concat(F.lit("t"), "id").alias("name"), (F.lit(90.00012) + F.col("id") * 0.01).alias("mz")
    )
    prepared = prepare_targets(many)
    assert prepared.count == 2000 and len(prepared.scan_ranges) <= 32
    wanted = (
        peaks.where("mslevel = '1'")
        .withColumnRenamed("mz", "at")
        .join(many, F.col("at").between(F.col("mz") - 0.01, F.col("mz") + 0.01))
    )
    assert eics.matched_points(peaks, prepared).count() == wanted.count()


def test_merged_ranges():
    assert merged_ranges([(5, 6), (1, 2), (1.5, 3)], 9) == ((1, 3), (5, 6))
    assert merged_ranges([(0, 1), (2, 3), (9, 10), (20, 21)], 2) == ((0, 10), (20, 21))
    assert merged_ranges([], 3) == ()


def test_salted_join_on_one_hot_bin(spark):
    points = spark.range(5000).select("id", F.lit(10.0).alias("v"))
    windows = spark.createDataFrame([(1, 9.5, 10.5), (2, 10.0, 10.0), (3, 10.1, 11.1)], "w long, lo double, hi double")
    found = join_ranges(points, windows, "v", 1.0).groupBy("w").count().collect()
    assert {row.w: row["count"] for row in found} == {1: 5000, 2: 5000}


def test_block_grid_equals_small_grid(manifest, targets):
    small = {tuple(r) for r in summary.sample_target_grid(manifest, targets).pairs.select("file_id", "target_id").collect()}
    large = type(targets)(targets.table, targets.tolerance, 10**7, targets.scan_ranges)
    blocks = summary.sample_target_grid(manifest, large).pairs.select("file_id", "target_id").collect()
    assert len(blocks) == 8 * 3 and {tuple(r) for r in blocks} == small


def test_block_grid_never_moves_pairs(spark, peaks, manifest, targets, monkeypatch):
    """Blocks of samples and targets give the small grid's rows, with Spark's own settings too."""
    monkeypatch.setattr(summary, "SAMPLES_PER_BLOCK", 3)
    large = type(targets)(targets.table, targets.tolerance, 10**5 + 1, targets.scan_ranges)
    found = summary.apexes(eics.eic(peaks, targets))
    small = summary.complete(found, manifest, targets)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    try:
        blocks = summary.complete(found, manifest, large)
        plan = plan_of(blocks)
        assert sorted(map(str, blocks.select(*small.columns).collect())) == sorted(map(str, small.collect()))
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # The join that makes the pairs is the last one, and nothing is exchanged after it.
    assert "Exchange" not in plan.split("Join")[0]
    assert "target_id" not in plan.split("Join")[1].split("\n")[0]


def test_what_hangs_on_a_hit_or_a_suspect_is_not_worked_out_per_pair(peaks, manifest, targets):
    large = type(targets)(targets.table, targets.tolerance, 10**5 + 1, targets.scan_ranges)
    plain = screening.suspect_screening(peaks, manifest, targets, rounded=False)
    rounded = lambda df: df.withColumns({"Observed_MZ": F.round("Observed_MZ", 9), "MZ_Error_ppm": F.round("MZ_Error_ppm", 4)})
    expected = rounded(plain.withColumn("Exact_Mass", F.round("Exact_Mass", 2))).collect()
    for some in (targets, large):
        found = screening.suspect_screening(peaks, manifest, some, rounded=False, mass_digits=2)
        assert sorted(map(str, rounded(found).collect())) == sorted(map(str, expected))
        pairs = plan_of(found).split("Join")[0]
        assert "round(" not in pairs and "least(" not in pairs and "CASE WHEN" not in pairs


def max_rows(spark, *rows):
    full = [(1, "m", file, file, i, float(top) if top is not None else None, 1.0, 100.0) for i, (file, top) in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "target_id long, molecule string, file_id string, file string, pos long,"
        " max_intensity double, rt_at_max double, target_mz double",
    )


def test_normalise(spark):
    molecule = max_rows(spark, ("a", 10), ("b", 10), ("c", 10), ("d", 0))
    standard = max_rows(spark, ("a", 4), ("b", 0), ("d", 5), ("a", 8))
    ratios = {r.file: r.max_intensity for r in normalise(molecule, standard).collect()}
    assert ratios == {"a": 2.5, "b": None, "c": None, "d": 0.0}
    dated = molecule.withColumns({"date_order": F.lit(202201), "display_name": F.lit("d"), "sample_idx": F.col("pos") + 1})
    kept = normalize_by_istd(dated, standard)
    assert [(r.file, r.date_order, r.display_name, r.sample_idx) for r in kept.collect()] == [("a", 202201, "d", 1)]
    assert normalise(molecule, standard.drop("pos")).where("file = 'a'").first().max_intensity_istd == 8.0


def test_combine(spark):
    one, two = max_rows(spark, ("a", 1)), max_rows(spark, ("a", 2))
    found = combine_molecules(X=one, Y=two).orderBy("molecule_ord").collect()
    assert [(r.molecule, r.max_intensity) for r in found] == [("X", 1.0), ("Y", 2.0)]
    assert [(r.target_id, r.source_target_id) for r in found] == [(0, 1), (1, 1)]
    with pytest.raises(ValueError):
        combine_molecules()
    with pytest.raises(ValueError, match="Missing required columns"):
        combine_molecules(X=one.drop("file"))


def scan_rows(spark, *points):
    return spark.createDataFrame(
        [(1, "f", float(rt), i, float(h)) for i, (rt, h) in enumerate(points)],
        "target_id long, file_id string, rt double, scanid long, intensity double",
    )


def test_apex_tolerance(spark):
    tolerance = lambda *points: apex.apex_windows(scan_rows(spark, *points)).first().rt_tolerance
    assert tolerance((1, 9), (1.1, 9), (1.2, 9)) == 0.1
    assert tolerance((1, 9), (1.1, 1), (1.2, 1), (1.3, 1)) == 0.05
    assert tolerance((1, 9), (1.1, 8), (1.2, 7), (1.3, 1)) == pytest.approx(0.2)
    given = spark.createDataFrame([(1, "f", 5.0)], "target_id long, file_id string, rt double")
    scans = scan_rows(spark, (1, 99), (4.6, 5), (5, 4), (5.1, 4), (5.4, 1))
    assert apex.apex_windows(scans, given).first().rt_tolerance == pytest.approx(0.5)


def test_several_given_times_stay_apart(spark):
    given = spark.createDataFrame([(1, "f", t) for t in (1.0, 1.05, 1.05, 8.0)], "target_id long, file_id string, rt double")
    windows = apex.apex_windows(scan_rows(spark, (1, 5), (1.1, 5)), given)
    found = {r.apex_rt: (r.n_near, r.rt_tolerance) for r in windows.collect()}
    assert found == {1.0: (2, 0.1), 1.05: (2, 0.1), 8.0: (0, 0.1)} and windows.count() == 3
    peaks = spark.createDataFrame([("f", "1", 1, 1.0, 100.0, 10.0)], "file_id string, mslevel string, scanid long, rt double, mz double, intensity double")
    lines = apex.spectra_in_windows(peaks, windows, "1").collect()
    assert {(r.apex_rt, r.intensity, r.base_peak) for r in lines} == {(1.0, 10.0, 10.0), (1.05, 10.0, 10.0)}


def test_overlay_subsample_keeps_whole_chromatograms(peaks, manifest, targets, rows):
    found = as_eic(frames.eic_overlay(peaks, manifest, targets, max_samples=3))
    # Positions 1, 4.5 (even: 4) and 8 of the manifest.
    wanted = {"s0.parquet", "s3.parquet", "empty.parquet"}
    assert found == {key: v for key, v in brute_eic(rows).items() if key[1] in wanted}


def test_axis_labels(spark):
    axis = lambda labels: {r.file: r.tick for r in frames.sample_axis(max_rows(spark, ("x_2021_02", 1), ("y_2021-02", 2), ("z_2020", 3)), labels).collect()}
    assert axis("date") == {"x_2021_02": "2021-02", "y_2021-02": None, "z_2020": "2020"}
    assert axis("year") == {"x_2021_02": "2021", "y_2021-02": None, "z_2020": "2020"}
    assert axis("none") == {"x_2021_02": None, "y_2021-02": None, "z_2020": None}
    assert axis("file")["z_2020"] == "z_2020"
    with pytest.raises(ValueError):
        axis("week")
