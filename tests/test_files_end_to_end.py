"""The whole way from sample files to a result file, against the same peaks as a table."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ionsieve import fixtures, manifest_from_folder, max_frame, prepare_targets, read_samples
from ionsieve import process_screening_results, materialize, suspect_screening
from ionsieve.operators.filters import keep_paths
from ionsieve.schemas import PEAK_FILE
from ionsieve.sources.manifest import files_without_peaks, new_samples
from ionsieve.sources.sinks import by_score, write_results_csv


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """One Parquet file per sample, in two folders, plus one file without a row."""
    root = tmp_path_factory.mktemp("archive")
    table = fixtures.peaks(spark, sf_dir).toPandas()
    for i, (name, rows) in enumerate(table.groupby("file_id")):
        place = root / f"batch{i % 2}"
        place.mkdir(exist_ok=True)
        pq.write_table(pa.Table.from_pandas(rows[PEAK_FILE.fieldNames()], preserve_index=False), place / name)
    empty = table.head(0)[PEAK_FILE.fieldNames()]
    pq.write_table(pa.Table.from_pandas(empty, preserve_index=False), root / "Sample_empty.parquet")
    return str(root)


def test_files_give_what_the_table_gives(spark, sf_dir, folder, tmp_path):
    targets = prepare_targets(fixtures.molecules(spark, sf_dir))
    peaks, manifest = read_samples(spark, folder), manifest_from_folder(spark, folder)
    table, listed = fixtures.peaks(spark, sf_dir), fixtures.manifest(spark, sf_dir)

    columns = ("molecule", "file", F.round("max_intensity", 2), "rt_at_max", "target_mz")
    rows = lambda frame: sorted(map(str, map(tuple, frame.select(*columns).collect())))
    from_files = materialize(max_frame(peaks, manifest, targets))
    from_table = materialize(max_frame(table, listed, targets))
    assert rows(from_files) == rows(from_table)
    assert [row.file for row in files_without_peaks(manifest, peaks).collect()] == ["Sample_empty.parquet"]

    metadata = fixtures.metadata(spark, sf_dir)
    shown = lambda frame: sorted(
        map(tuple, process_screening_results(frame, metadata).select("molecule", "display_name", "sample_idx").collect())
    )
    assert shown(from_files) == shown(from_table)

    kept = keep_paths(manifest)
    paths = [row.path for row in kept.select("path").collect()]
    screened = suspect_screening(read_samples(spark, paths), kept, targets)
    path = write_results_csv(by_score(screened), str(tmp_path))
    written = spark.read.option("header", True).csv(path)
    assert written.columns == screened.columns
    assert written.count() == kept.count() * targets.count < manifest.count() * targets.count
    assert new_samples(manifest, kept).count() == manifest.count() - kept.count()
