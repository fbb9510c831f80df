"""Files on disk: peaks, manifests, suspects, results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ionsieve import manifest_from_folder, manifest_from_listing, manifest_from_paths
from ionsieve import prepare_targets, read_peaks, read_samples, write_peaks
from ionsieve.operators.eic import eic_one_target
from ionsieve.plans.screening import screen_one_mass
from ionsieve.schemas import PEAK_FILE, PEAKS
from ionsieve.sources import manifest as manifests
from ionsieve.sources import metadata, sinks, suspects
from ionsieve.sources.peaks import write_by_file


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three samples: two with one base name, one with an encoded name."""
    root = tmp_path_factory.mktemp("samples")
    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(name, *points):
        path = root / name
        path.parent.mkdir(exist_ok=True)
        columns = list(zip(*points))
        pq.write_table(
            pa.table(dict(zip(PEAK_FILE.fieldNames(), (list(column) for column in columns)))), path
        )

    write("day1/a%20b.parquet", ("1", 1, 1.0, 100.0, 5.0), ("1", 1, 1.0, 100.001, 6.0))
    write("day2/a%20b.parquet", ("1", 1, 1.0, 100.0, 70.0), ("2", 2, 1.5, 100.0, 1.0))
    write("c d.PARQUET", ("1", 1, 2.0, 100.0, float("nan")), ("1", 2, 2.5, 300.0, 9.0))
    (root / "notes.txt").write_text("no peaks")
    return str(root)


def sample_paths(folder):
    return [f"{folder}/{name}" for name in ("day1/a%20b.parquet", "day2/a%20b.parquet", "c d.PARQUET")]


def test_same_base_name_stays_apart(spark, folder):
    peaks = read_samples(spark, sample_paths(folder))
    found = eic_one_target(peaks, 100.00001).orderBy("intensity").collect()
    assert [(row.file, row.rt, row.intensity) for row in found] == [
        ("a%20b.parquet", 1.0, 11.0), ("a%20b.parquet", 1.0, 70.0)
    ]
    assert [row.file_id.split("/")[-2] for row in found] == ["day1", "day2"]


def test_a_folder_is_all_its_samples(spark, folder):
    by_folder = read_samples(spark, folder).collect()
    by_path = read_samples(spark, sample_paths(folder)).collect()
    assert sorted(map(tuple, by_folder)) == sorted(map(tuple, by_path)) and len(by_path) == 5


def test_folder_manifest_matches_the_peaks(spark, folder):
    manifest = manifest_from_folder(spark, folder)
    rows = manifest.orderBy("pos").collect()
    assert [row.file for row in rows] == ["c d.PARQUET", "a%20b.parquet", "a%20b.parquet"]
    peaks = read_samples(spark, sample_paths(folder))
    full = screen_one_mass(peaks, manifest, 100.00001).collect()
    assert {(row.file, row.intensity) for row in full} == {
        ("a%20b.parquet", 11.0), ("a%20b.parquet", 70.0), ("c d.PARQUET", None)
    }
    assert manifests.files_without_peaks(manifest, peaks).count() == 0


def test_damaged_file(spark, folder, tmp_path):
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"PAR1 this is not a table PAR1")
    paths = [*sample_paths(folder), str(bad)]
    with pytest.raises(Exception):
        read_samples(spark, paths).collect()
    peaks = read_samples(spark, paths, skip_damaged=True)
    assert peaks.count() == 5
    listed = manifest_from_paths(spark, [f"file://{path}" for path in paths])
    assert [row.file for row in manifests.files_without_peaks(listed, peaks).collect()] == ["bad.parquet"]


def test_layout_keeps_rows_and_prunes(spark, folder, tmp_path):
    peaks = read_samples(spark, sample_paths(folder))
    write_peaks(peaks, str(tmp_path / "peaks"), partitions=4)
    back = read_peaks(spark, str(tmp_path / "peaks"))
    assert back.schema.fieldNames() == PEAKS.fieldNames()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, peaks.collect()))
    assert dict(back.dtypes)["mslevel"] == "string"


def test_split_by_file(spark, folder, tmp_path):
    found = eic_one_target(read_samples(spark, sample_paths(folder)), 100.00001)
    write_by_file(found, str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert {row.file for row in back.collect()} == {"a%20b.parquet"} and back.count() == 2


def test_listing(spark):
    rows = [
        ("x.parquet", "x.parquet", False, "file:///share/x.parquet"),
        ("y.PARQUET", "d/e/y.PARQUET", False, None),
        ("y.PARQUET", "d/e/y.PARQUET", False, None),
        ("d", "d", True, None),
        ("z.csv", "d/z.csv", False, "u3"),
    ]
    listing = spark.createDataFrame(rows, "name string, path string, is_folder boolean, url string")
    found = manifest_from_listing(listing)
    assert {(row.file_id, row.folder) for row in found.collect()} == {
        ("/share/x.parquet", "."), ("d/e/y.PARQUET", "d/e")
    }
    assert [row.file for row in found.orderBy("pos").collect()] == ["y.PARQUET", "x.parquet"]
    loaded = spark.createDataFrame([("/share/x.parquet",)], "file_id string")
    assert [row.file for row in manifests.new_samples(found, loaded).collect()] == ["y.PARQUET"]
    assert manifests.only_samples(found, None).count() == 2
    assert manifests.only_samples(found, ["d/e/y.PARQUET"]).count() == 1
    assert manifests.only_samples(found, loaded).count() == 1


def test_metadata_csv(spark, tmp_path):
    path = tmp_path / "dates.csv"
    path.write_text("name,year,month,site\na,2021,03,north\nb,2022,May,south\n")
    rows = metadata.read_metadata_csv(spark, str(path)).orderBy("name").collect()
    assert [tuple(row)[:4] for row in rows] == [("a", 2021, 3, "north"), ("b", 2022, None, "south")]
    assert rows[0].pos < rows[1].pos


def test_equal_years_take_the_first_row(spark, tmp_path):
    path = tmp_path / "dates.csv"
    path.write_text("name,year,month\na,2021,09\na,2021,02\na,2020,01\na,1e99,5\n")
    row = metadata.latest_metadata(metadata.read_metadata_csv(spark, str(path))).first()
    assert (row.year, row.month) == (2021, 9)


def test_excluded_files_are_not_read(spark, tmp_path):
    one = [("1", 1, 1.0, 100.0, 5.0)]
    kinds = "mslevel string, scanid long, rt double, mz double, intensity double"
    for name in ("a.parquet", "POOL_1.parquet", "sub/blanc.parquet"):
        spark.createDataFrame(one, kinds).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    found = read_samples(spark, str(tmp_path), exclude_patterns=["part"])
    assert found.count() == 0
    assert read_samples(spark, str(tmp_path), exclude_patterns=["no such"]).count() == 3


def test_targets_without_a_mass_are_returned(spark):
    listed = spark.createDataFrame([("a", 100.0), ("b", None)], "name string, mz double")
    targets = prepare_targets(listed)
    assert targets.count == 1 and [r.molecule for r in targets.rejected.collect()] == ["b"]


def test_suspects(spark, tmp_path):
    assert suspects.predefined_suspects(spark).count() == 6
    full = tmp_path / "full.csv"
    full.write_text("id,name,smiles,exact_mass\n1,A,C,16.03\n2,B,CC,\n")
    usable, rejected = suspects.read_suspects_csv(spark, str(full))
    assert [tuple(row) for row in usable.collect()] == [("A", "C", 16.03)]
    assert [tuple(row) for row in rejected.collect()] == [("B", "CC", None)]
    bare = tmp_path / "bare.csv"
    bare.write_text("name,smiles\nA,C\n")
    assert prepare_targets(usable).table.select("molecule", "target_mz").first() == ("A", 16.03)
    usable, rejected = suspects.read_suspects_csv(spark, str(bare))
    assert (usable.count(), rejected.count()) == (0, 1)
    more = suspects.append_suspects(suspects.predefined_suspects(spark), suspects.predefined_suspects(spark))
    assert more.count() == 12
    assert suspects.append_suspects(more, rejected).count() == 12


def test_reading_order(spark):
    rows = [("b", 2.0), ("a", 3.0), ("b", 1.0)]
    found = sinks.in_reading_order(spark.createDataFrame(rows, "file string, rt double"))
    assert [tuple(row) for row in found.collect()] == [("a", 3.0), ("b", 1.0), ("b", 2.0)]


def test_result_csv(spark, tmp_path):
    rows = [("s", "low", 10.0), ("s", "high", 90.0)]
    results = spark.createDataFrame(rows, "Sample string, Compound string, Detection_Score double")
    assert [row.Compound for row in sinks.by_score(results).collect()] == ["high", "low"]
    path = sinks.write_results_csv(results, str(tmp_path), date(2024, 5, 6))
    assert path.endswith("screening_results_2024-05-06.csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == results.columns and back.count() == 2


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns: url"):
        manifest_from_listing(spark.range(1).select(*(F.lit("x").alias(c) for c in ("name", "path", "is_folder"))))
