"""Name parsing, dates and lookups on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from ionsieve.functions import names
from ionsieve.operators import filters, samples
from ionsieve.sources.metadata import as_metadata, latest_metadata


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, name string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("name"))).collect()]


def manifest(spark, *files):
    rows = [(file, file, i) for i, file in enumerate(files)]
    return spark.createDataFrame(rows, "file_id string, file string, pos long")


def metadata(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, year int, month int")


def test_date_label(spark):
    given = ["E-2021_01-x", "a_2024_03", "run2023x", "sample-without", "S_run%2017.parquet"]
    wanted = ["2021-01", "2024-03", "2023", "sample-wit", "2017"]
    assert column(spark, given, names.date_label) == wanted


def test_url_decoding(spark):
    given = ["a+b%20c", "bad%zz", "x%2520y", "plain"]
    assert column(spark, given, names.url_decoded) == ["a+b c", "bad%zz", "x%20y", "plain"]


def test_paths(spark):
    given = ["a/b/c.parquet", "c.parquet", "/x/y.PARQUET/"]
    assert column(spark, given, names.folder_name) == ["a/b", ".", "x"]
    assert column(spark, given[:2], names.base_name) == ["c.parquet", "c.parquet"]
    assert column(spark, given, lambda c: names.is_parquet(names.trim_slashes(c))) == [True] * 3
    joined = column(spark, ["x"], lambda c: names.join_path(F.lit("f"), c))
    assert joined == ["f/x"]


def test_prefix_and_year(spark):
    assert column(spark, ["E-2021_01-a.parquet"], names.without_date_prefix) == ["a.parquet"]
    assert column(spark, ["2021-03", "2021", "x-y"], names.year_part) == ["2021", "2021", "x"]


def test_exclusion(spark):
    files = manifest(spark, "Blanc_1", "POOL_2", "local", "SST_3", "Sample_4")
    kept = lambda df: {row.file for row in df.collect()}
    assert kept(filters.keep_samples(files)) == {"Sample_4"}
    assert kept(filters.keep_paths(files)) == {"SST_3", "Sample_4"}
    assert len(kept(filters.keep_samples(files, []))) == 5


def test_latest_metadata(spark):
    found = latest_metadata(
        metadata(spark, ("a", 2007, 1), ("a", 2021, 3), ("b", None, 2), ("b", 2020, 5), ("c", None, 1))
    )
    assert sorted(tuple(row) for row in found.collect()) == [
        ("a", 2021, 3), ("b", 2020, 5), ("c", None, 1)
    ]


def test_metadata_columns(spark):
    text = spark.createDataFrame([("a", "2021", "03"), ("b", "2021", "May")], "name string, year string, month string")
    assert [row.month for row in as_metadata(text).orderBy("name").collect()] == [3, None]
    with pytest.raises(ValueError, match="Missing required columns: year, month"):
        as_metadata(text.select("name"))


def test_match_cascade(spark):
    files = manifest(spark, "a%2520b", "c%20d.parquet", "plain", "none%20here.parquet")
    dates = metadata(spark, ("a%20b", 2021, None), ("c d.parquet", 2022, 4), ("plain", 2020, 2))
    found = {row.file: row for row in samples.reorder_by_date(files, dates).collect()}
    # Matched by its decoded name, but without a month: last and not renamed.
    third = found["a%2520b"]
    assert (third.year, third.date_order, third.display_name) == (2021, None, "a%2520b")
    assert found["c%20d.parquet"].display_name == "E-2022_04-c d.parquet"
    assert found["none%20here.parquet"].display_name == "none here.parquet"
    order = sorted(found, key=lambda file: found[file].sample_idx)
    assert order == ["plain", "c%20d.parquet", "a%2520b", "none%20here.parquet"]


def test_lookup_never_multiplies(spark):
    files = manifest(spark, "a%20b")
    dates = metadata(spark, ("a b", 2021, 1), ("a%20b", 2022, 2))
    labelled = samples.with_date_labels(files, dates).collect()
    # The first raw name in name order is "a b".
    assert [row.date_label for row in labelled] == ["2021-01"]
    # The raw name itself goes first when dating.
    assert [row.year for row in samples.with_dates(files, dates).collect()] == [2022]


def test_label_fallbacks(spark):
    files = manifest(spark, "E-2021_01-a%20b", "E-2021_05-zzz", "q")
    dates = metadata(spark, ("a b", 2019, 7), ("q", 2020, None))
    found = {row.file: row.date_label for row in samples.with_date_labels(files, dates).collect()}
    assert found == {"E-2021_01-a%20b": "2019-07", "E-2021_05-zzz": "2021-05", "q": "q"}


def test_date_span_of_nothing(spark):
    dated = samples.with_dates(manifest(spark, "x"), metadata(spark, ("y", 2020, 1)))
    assert tuple(samples.date_span(dated).first()) == (None,) * 4
