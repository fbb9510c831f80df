"""Crowded bins of a range join: every match once, even tasks, one copy of windows of quiet bins."""

import pytest
from pyspark.sql import functions as F

from ionsieve.operators import ranges

WIDTH = 0.02


@pytest.fixture(scope="module")
def points(spark):
    """A third of all points in one bin, spread inside it; a tenth with one and the same value; the rest everywhere."""
    at = F.col("id")
    spot = F.when(at % 3 == 0, 200.001 + (at % 1013) * 1.7e-5).when(at % 10 == 1, F.lit(300.01)).otherwise(100 + (at * 7919 % 40_000) / 100.0)
    return spark.range(30_000).select("id", spot.alias("mz"), F.lit(None).cast("string").alias("note"))


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(i, 100 + i * 0.37, 100 + i * 0.37 + WIDTH) for i in range(900)]
    rows += [(1000, 199.99, 200.0105), (1001, 200.005, 200.0051), (1002, 200.0, 200.02), (1003, 300.0, 300.02), (1004, 300.01, 300.01)]
    return spark.createDataFrame(rows, "w long, lo double, hi double")


def test_same_matches_as_a_broadcast_join(points, windows):
    expected = ranges.join_ranges(points, windows, "mz", WIDTH, broadcast=True)
    crowded = ranges.crowded_bins(points, "mz", WIDTH, looked_at=0.3)
    found = ranges.join_ranges(points, windows, "mz", WIDTH, crowded=crowded)
    assert found.columns == expected.columns
    pairs = lambda df: sorted(map(tuple, df.select("id", "w").collect()))
    assert pairs(found) == pairs(expected)
    assert found.where("w = 1003").count() > 2000


def test_crowded_bins_spread_evenly_and_quiet_ones_are_copied_once(points, windows):
    crowded = ranges.crowded_bins(points, "mz", WIDTH, looked_at=1.0)
    binned = lambda df, x: df.withColumn("_bin", ranges._bin(x, WIDTH))
    right = windows.withColumn("_bin", F.explode(F.sequence(ranges._bin("lo", WIDTH), ranges._bin("hi", WIDTH))))
    left, copies = ranges._dealt(binned(points, "mz"), right, "mz", crowded, ["_bin"])
    shares = [row["count"] for row in left.groupBy("_bin", "_piece", "_salt").count().collect()]
    assert max(shares) <= 3 * points.count() * ranges.CROWDED_PART  # one bin alone holds a third
    names = {row["_bin"] for row in crowded.collect()}
    assert len(names) == 2
    quiet = F.col("_bin").isin(*names)
    assert copies.where(~quiet).count() == right.where(~quiet).count()
    narrow = copies.where("w = 1001").count()
    assert 1 <= narrow <= 3 < copies.where("w = 1002").count()  # copied to the pieces it touches only


def test_no_points_and_keys(spark, points, windows):
    none = points.where("false")
    assert ranges.join_ranges(none, windows, "mz", WIDTH, crowded=ranges.crowded_bins(none, "mz", WIDTH)).count() == 0
    keyed, asked = points.withColumn("k", F.col("id") % 2), windows.withColumn("k", F.lit(1).cast("long"))
    crowded = ranges.crowded_bins(keyed, "mz", WIDTH, ["k"], looked_at=0.5)
    found = ranges.join_ranges(keyed, asked, "mz", WIDTH, on=["k"], crowded=crowded)
    expected = ranges.join_ranges(keyed, asked, "mz", WIDTH, on=["k"], broadcast=True)
    assert sorted(map(tuple, found.select("id", "w").collect())) == sorted(map(tuple, expected.select("id", "w").collect()))


def test_tasks_follow_the_points(spark, points, windows, monkeypatch):
    seen = ranges.seen_bins(points, "mz", WIDTH, looked_at=0.3)
    assert ranges.tasks_for(seen, 0.3) is None
    monkeypatch.setattr(ranges, "TASK_POINTS", 300)
    tasks = ranges.tasks_for(seen, 0.3)
    assert 90 <= tasks <= 110
    monkeypatch.setattr(ranges, "PIECE_POINTS", 150)
    crowded = ranges.crowded_bins(points, "mz", WIDTH, looked_at=0.3, seen=seen)
    found = ranges.join_ranges(points, windows, "mz", WIDTH, crowded=crowded, tasks=tasks)
    expected = ranges.join_ranges(points, windows, "mz", WIDTH, broadcast=True)
    pairs = lambda df: sorted(map(tuple, df.select("id", "w").collect()))
    assert pairs(found) == pairs(expected)
    assert found.rdd.getNumPartitions() == tasks  # small tasks stay apart


def test_long_lists_are_joined_in_tasks_of_few_points(spark, points, monkeypatch):
    from ionsieve.operators import eic
    from ionsieve.operators.targets import targets_of

    peaks = points.select(
        F.lit("a").alias("file_id"), F.lit("1").alias("mslevel"), F.col("id").alias("scanid"), (F.col("id") % 50).cast("double").alias("rt"), "mz", F.lit(1.0).alias("intensity")
    )
    targets = targets_of(spark, [(f"t{i}", 100 + i * 0.37) for i in range(900)])
    monkeypatch.setattr(ranges, "TASK_POINTS", 1_000)
    found = eic.matched_points(peaks, targets, broadcast=False)
    assert found.rdd.getNumPartitions() > 20
    assert found.count() == eic.matched_points(peaks, targets, broadcast=True).count()
