"""Time layout, damaged files, kept state and observed counters."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ionsieve import fixtures
from ionsieve.operators.targets import prepare_targets
from ionsieve.plans import counters, incremental, screening
from ionsieve.sources import faults, time_layout
from plan_text import plan_of


def test_z_values_interleave_bits(spark):
    rows = spark.range(0, 1 << 16, 331).withColumn("y", (F.col("id") * 7919) % (1 << 16))
    for row in rows.select("id", "y", time_layout.z_value(F.col("id"), F.col("y")).alias("z")).collect():
        assert row.z == sum(((row.id >> k & 1) << 2 * k) | ((row.y >> k & 1) << 2 * k + 1) for k in range(16))


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    """64 samples of 400 points over 40 minutes, half of them at each level."""
    at = F.col("id")
    peaks = spark.range(64 * 400).select(
        F.format_string("s%%20%03d", (at % 64).cast("int")).alias("file_id"),
        F.when(at % 2 == 0, "1").otherwise("2").alias("mslevel"),
        at.alias("scanid"),
        (F.floor(at / 64) / F.lit(10.0)).alias("rt"),
        (F.lit(100.0) + at % 977).alias("mz"),
        F.lit(5.0).alias("intensity"),
    )
    path = str(tmp_path_factory.mktemp("layout") / "a b")
    time_layout.write_time_layout(peaks, path, 32)
    return path, peaks


def test_windows_open_few_files_and_lose_no_point(spark, layout):
    path, peaks = layout
    windows = spark.createDataFrame([("s%20003", 10.0, 10.4), ("s%20041", 30.2, 30.9), ("no such", 1.0, 2.0)], "file_id string, lo double, hi double")
    inside = lambda rows: rows.join(windows, "file_id").where("mslevel = '2' and rt between lo and hi").select("file_id", "scanid", "rt", "mz", "intensity")
    found = time_layout.peaks_in_windows(spark, path, windows, "2")
    assert sorted(map(tuple, inside(found).collect())) == sorted(map(tuple, inside(peaks).collect()))
    every = time_layout.zones(spark, path).where("mslevel = '2'").count()
    opened = found.inputFiles()
    assert 0 < len(opened) <= every // 3 and time_layout.zones(spark, path).agg(F.sum("n")).first()[0] == peaks.count()
    assert time_layout.peaks_in_windows(spark, path, windows.where("file_id = 'no such'"), "2").count() == 0


def sample_table(n, **changed):
    columns = {"mslevel": ["1"] * n, "scanid": list(range(n)), "rt": [1.0 + i for i in range(n)], "mz": [100.0] * n, "intensity": [5.0] * n}
    return pa.table({k: v for k, v in (columns | changed).items() if v is not None})


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    (root / "sub").mkdir()
    pq.write_table(sample_table(5), root / "good.parquet")
    pq.write_table(sample_table(5), root / "sub" / "good%20too.parquet")
    pq.write_table(sample_table(5, mz=None), root / "no_mz.parquet")
    pq.write_table(sample_table(5, rt=["x"] * 5), root / "text_rt.parquet")
    (root / "sub" / "empty.parquet").write_bytes(b"")
    (root / "text.parquet").write_text("this is no parquet file at all")
    whole = (root / "good.parquet").read_bytes()
    (root / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    pq.write_table(sample_table(2000, intensity=[float(i * 7919 % 1000) for i in range(2000)]), root / "inner.parquet", row_group_size=500)
    inner = bytearray((root / "inner.parquet").read_bytes())
    inner[len(inner) // 2 : len(inner) // 2 + 400] = b"\xff" * 400
    (root / "inner.parquet").write_bytes(inner)
    return root


FOOTERS = {"no_mz.parquet", "text_rt.parquet", "empty.parquet", "text.parquet", "cut.parquet"}


def test_damaged_files_are_told_with_their_error(spark, archive):
    found = {row.file: row.error for row in faults.file_faults(spark, str(archive)).collect()}
    assert set(found) == FOOTERS
    assert found["no_mz.parquet"] == "column mz is missing" and found["text_rt.parquet"] == "column rt is string, not double"
    assert all(found.values())
    whole = {row.file for row in faults.file_faults(spark, str(archive), whole=True).collect()}
    assert whole == FOOTERS | {"inner.parquet"}


def test_sound_files_only_or_nothing(spark, archive):
    peaks, rejects = faults.read_checked(spark, str(archive), whole=True)
    names = {row.file_id.rsplit("/", 1)[1] for row in peaks.select("file_id").distinct().collect()}
    assert names == {"good.parquet", "good%20too.parquet"} and peaks.count() == 10
    assert {row.file for row in rejects.collect()} == FOOTERS | {"inner.parquet"}
    with pytest.raises(faults.DamagedFiles, match="5 damaged files: .*column mz is missing") as raised:
        faults.read_checked(spark, str(archive), all_or_nothing=True)
    assert raised.value.faults.count() == 5
    peaks, rejects = faults.read_checked(spark, str(archive / "sub"), all_or_nothing=True, exclude_patterns=["empty"])
    assert peaks.count() == 5 and rejects.count() == 0


def test_loaded_samples_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(r, "file_id string, mz double")
    listed = lambda *names: spark.createDataFrame([(n,) for n in names], "file_id string")
    counted = lambda peaks, manifest: manifest.join(peaks.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left")
    state = lambda df: {row.file_id: row.n for row in df.collect()}
    first = rows(("a", 1.0), ("a", 2.0), ("b", 1.0), ("c", 9.0))
    assert state(incremental.update_state(path, first, listed("a", "b"), counted, folders=2)) == {"a": 2, "b": 1}
    later = rows(("b", 1.0), ("b", 1.0), ("b", 1.0), ("c", 9.0), ("a", 0.0))
    assert state(incremental.update_state(path, later, listed("b", "c", "d"), counted, folders=2)) == {"a": 2, "b": 3, "c": 1, "d": None}
    assert state(incremental.read_state(spark, path)) == {"a": 2, "b": 3, "c": 1, "d": None}


def test_counters_come_from_the_run_itself(spark, sf_dir):
    from ionsieve.session import materialize

    targets = prepare_targets(fixtures.molecules(spark, sf_dir))
    values = materialize(screening.max_frame(fixtures.peaks(spark, sf_dir), fixtures.manifest(spark, sf_dir), targets))
    standard, metadata = values.where("molecule = 'mol_3'"), fixtures.metadata(spark, sf_dir)
    kept, counted = counters.processed_with_counters(values, standard, metadata, list(range(5)))
    expected = {row.target_id: row for row in screening.run_counters(values, standard, metadata).collect()}
    for row in counted.collect():
        assert all(row[name] == expected[row.target_id][name] for name in counters.COUNTERS)
    assert kept.count() == screening.process_screening_results(values, metadata).count()
    # The table was made from what had been counted: it reads no rows again.
    assert "Scan" not in plan_of(counted).replace("LocalTableScan", "").replace("Scan ExistingRDD", "")
    with pytest.raises(ValueError):
        counters.processed_with_counters(values, standard, metadata, list(range(65)))
