"""Distributed positions, ranks and quantiles against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ionsieve.operators import ordering


@pytest.fixture(autouse=True, params=[65_536, 40, 1])
def rows_per_cell(request, monkeypatch):
    """Run every case with one cell per group, a few, and as many as can be."""
    monkeypatch.setattr(ordering, "ROWS_PER_CELL", request.param)
    monkeypatch.setattr(ordering, "MOST_CELLS", 64 if request.param == 40 else 4096)
    return request.param


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = []
    for key in ("a", "b"):
        for _ in range(400):
            kind = rng.random()
            # A third of the rows share one value.
            value = 5.0 if kind < 0.33 else rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 8)
            rows.append((key, value))
    rows.append(("single", 3.0))
    return spark.createDataFrame(rows, "key string, value double"), rows


def test_mid_ranks(values):
    df, rows = values
    found = {(r.key, r.value): r.mid_rank for r in ordering.tied_ranks(df, ["key"], "value").collect()}
    for (key, value), rank in found.items():
        group = [v for k, v in rows if k == key]
        smaller, equal = sum(v < value for v in group), group.count(value)
        assert rank == smaller + (equal + 1) / 2


def test_quantiles(values):
    df, rows = values
    shares = {"low": 0.25, "mid": 0.5, "high": 0.75, "top": 0.999}
    for row in ordering.quantiles(df, ["key"], "value", shares).collect():
        group = [v for k, v in rows if k == row.key]
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.quantile(group, share), rel=1e-12)
        assert row.mid == pytest.approx(statistics.median(group), rel=1e-12)


def test_index_over_negative_and_huge_positions(spark):
    positions = [-70_000, -1, 0, 5, 65_535, 65_536, 10**12]
    df = spark.createDataFrame([(p,) for p in positions], "pos long")
    placed = ordering.with_index(df, [], [F.col("pos")], "i")
    assert [row.i for row in placed.orderBy("pos").collect()] == list(range(1, 8))


def test_index_over_names(spark, rows_per_cell):
    """5000 names with one long common start, in three groups of very unequal size."""
    rng = random.Random(2)
    names = [f"a_very_long_common_start_{rng.random():.9f}" for _ in range(5000)]
    rows = [(name, "big" if i % 10 else "small") for i, name in enumerate(names)] + [("x", "one")]
    df = spark.createDataFrame(rows, "name string, key string").repartition(5)
    placed = ordering.with_index(df, ["key"], [F.col("name")], "i")
    found = {(row.key, row.name): row.i for row in placed.collect()}
    for key in ("big", "small", "one"):
        for i, name in enumerate(sorted(n for n, k in rows if k == key), 1):
            assert found[key, name] == i
    keyed = df.select(F.struct("key").alias("_g"), F.struct(F.col("name").alias("k0")).alias("_k"))
    cut = ordering._cuts(keyed)
    cells = keyed.join(cut, "_g", "left").withColumn("c", ordering._cell("_k", "_cuts")).groupBy("_g", "c").count()
    largest = cells.agg(F.max("count")).first()[0]
    assert largest == 4500 if rows_per_cell == 65_536 else largest < 1000


def test_like_a_plain_window_on_odd_values(spark):
    """Null keys, null, NaN and infinite values, ties and groups of one value."""
    rng = random.Random(4)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -3.0, 1.0, 5.0]
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1]), rng.choice(odd + [rng.gauss(0, 1e3)] * 4)) for _ in range(600)]
    rows += [("same", 1, 2.0)] * 50
    df = spark.createDataFrame(rows, "k string, j int, v double").withColumn("id", F.monotonically_increasing_id())
    window = Window.partitionBy("k", "j").orderBy("v", "id")
    plain = df.withColumn("i", F.row_number().over(window).cast("long"))
    found = ordering.with_index(df, ["k", "j"], [F.col("v"), F.col("id")], "i")
    text = lambda frame: sorted(map(str, frame.select("k", "j", "v", "id", "i").collect()))
    assert text(found) == text(plain)
    ties = Window.partitionBy("k", "j").orderBy("v")
    plain = df.select("k", "j", "v", (F.rank().over(ties) + (F.count("*").over(Window.partitionBy("k", "j", "v")) - 1) / 2).alias("r")).distinct()
    ranked = ordering.tied_ranks(df, ["k", "j"], "v").select("k", "j", "v", F.col("mid_rank").alias("r"))
    assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize(
    "n, k, wanted",
    [(4, 3, [1, 2, 4]), (5, 1, [1]), (3, 3, [1, 2, 3]), (2, 8, [1, 2]), (101, 4, [1, 34, 68, 101])],
)
def test_evenly_spaced(spark, n, k, wanted):
    files = spark.range(1, n + 1).select(
        F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("file_id")
    )
    found = ordering.evenly_spaced(files, k)
    assert sorted(row.pos for row in found.collect()) == wanted


def test_no_sample_is_no_choice(spark):
    with pytest.raises(ValueError):
        ordering.evenly_spaced(spark.range(1).select(F.col("id").alias("pos"), F.lit("f").alias("file_id")), 0)
