"""Interval joins: many points against many short windows in one scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Copies of each window in a shuffled join whose crowded bins are not known.
SALTS = 16

# Share of the points that is looked at to find crowded bins, and the part of these that makes one crowded. Of many points
# a smaller part does, which PIECE_POINTS are, so that pieces stay as small; at most MOST_CROWDED bins are crowded.
LOOKED_AT = 0.01
CROWDED_PART = 1 / 256
PIECE_POINTS = 1 << 17
MOST_CROWDED = 4_096
# Fewer rows than these in the sample say nothing.
LEAST_ROWS = 32
# Points that one task joins, about, where there are more than the cluster's tasks take at a time.
TASK_POINTS = 1 << 18
# Pieces of a crowded bin at most, before equal values are dealt out by hash.
PIECES = 64


def _bin(column: str, width: float) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def seen_bins(
    points: DataFrame, value: str, width: float, on: Sequence[str] = (), looked_at: float = LOOKED_AT
) -> DataFrame:
    """A sample of the points, written out: `on`, _bin and _v, the value. One job."""
    seen = points.select(*on, _bin(value, max(float(width), 1e-4)).alias("_bin"), F.col(value).alias("_v"))
    return materialize(seen.sample(looked_at, 7) if looked_at < 1 else seen)


def tasks_for(seen: DataFrame, looked_at: float = LOOKED_AT) -> int | None:
    """Tasks that a shuffled join of the points behind a sample (see seen_bins) takes; None for few points.

    Points of a task match many windows each, which shuffled bytes do not show, so tasks are counted by points.
    """
    tasks = math.ceil(seen.count() / looked_at / TASK_POINTS)
    return tasks if tasks > seen.sparkSession.sparkContext.defaultParallelism else None


def crowded_bins(
    points: DataFrame,
    value: str,
    width: float,
    on: Sequence[str] = (),
    looked_at: float = LOOKED_AT,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Bins that hold a large part of all points: `on`, _bin, _cuts, _salts; a few rows, written out.

    Found in a sample (`seen`, see seen_bins). A crowded bin is cut at equal depth into pieces (_cuts are the upper ends of all but the last). A
    piece that still holds too much, because its values are equal, is dealt out to _salts by hash. No result
    hangs on what it finds.
    """
    keys = [*on, "_bin"]
    seen = seen_bins(points, value, width, on, looked_at) if seen is None else seen
    count = seen.count()
    most = max(LEAST_ROWS, count // MOST_CROWDED, int(min(count * CROWDED_PART, PIECE_POINTS * looked_at)))
    counts = seen.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    shares = [k / PIECES for k in range(1, PIECES)]
    ends = seen.join(F.broadcast(counts), keys).groupBy(*keys).agg(F.max("_n").alias("_n"), F.percentile_approx("_v", shares, 10_000).alias("_ends"))
    step = F.greatest(F.lit(1), F.floor(F.lit(PIECES) / F.ceil(F.col("_n") / F.lit(most)))).cast("int")
    cuts = F.array_distinct(F.filter("_ends", lambda _, i: (i + 1) % step == 0))
    bins = materialize(ends.select(*keys, cuts.alias("_cuts")))
    pieces = seen.join(F.broadcast(bins), keys).groupBy(*keys, _piece(F.col("_v"), F.col("_cuts")).alias("_piece"))
    salts = pieces.agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_s"))
    salts = salts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_piece", "_s"))).alias("_of"))
    every = F.transform(F.sequence(F.lit(0), F.size("_cuts")), lambda i: F.coalesce(F.element_at("_of", i), F.lit(1)))
    return materialize(bins.join(salts, keys).select(*keys, "_cuts", every.alias("_salts")))


def _piece(value: Column, cuts: Column) -> Column:
    """How many cuts lie below the value; 0 where there are none."""
    return F.coalesce(F.size(F.filter(cuts, lambda cut: cut < value)), F.lit(0))


def _dealt(left: DataFrame, right: DataFrame, value: str, crowded: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_piece` and `_salt`: windows are copied to the pieces they touch, and once where a bin is quiet."""
    crowded = F.broadcast(crowded)
    columns = left.columns
    left = left.join(crowded, keys, "left").withColumn("_piece", _piece(F.col(value), F.col("_cuts")))
    salts = F.coalesce(F.get("_salts", F.col("_piece")), F.lit(1))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*columns), salts)).select(*columns, "_piece", "_salt")
    columns = right.columns
    right = right.join(crowded, keys, "left")
    touched = F.sequence(_piece(F.col("lo"), F.col("_cuts")), _piece(F.col("hi"), F.col("_cuts")))
    right = right.withColumn("_piece", F.explode(touched))
    last = F.coalesce(F.get("_salts", F.col("_piece")), F.lit(1)).cast("long") - 1
    return left, right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*columns, "_piece", "_salt")


def join_ranges(
    points: DataFrame,
    windows: DataFrame,
    value: str,
    width: float,
    on: Sequence[str] = (),
    broadcast: bool = False,
    salts: int = SALTS,
    crowded: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Rows of `points` with each window (`lo`..`hi`, closed) around their `value`.

    A value lies in one bin of `width`; a window is listed under each bin it
    touches, so an equi join on the bin plus the exact test finds every match
    once. `on` adds equality keys. With `broadcast` the points never move; the
    caller must know that the windows are few. Otherwise both sides are
    shuffled: the bins of `crowded` (see crowded_bins) in as many pieces as they need, or all bins with `salts`. With `crowded`,
    `tasks` says to how many tasks (see tasks_for).
    """
    width = max(float(width), 1e-4)
    keys = [*on, "_bin"]
    left = points.withColumn("_bin", _bin(value, width))
    right = windows.withColumn("_bin", F.explode(F.sequence(_bin("lo", width), _bin("hi", width))))
    if broadcast:
        right = F.broadcast(right)
    elif crowded is not None:
        left, right = _dealt(left, right, value, crowded, keys)
        keys += ["_piece", "_salt"]
        if tasks:
            left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    elif salts > 1:
        keys.append("_salt")
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)))
        every_salt = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
        right = right.withColumn("_salt", F.explode(every_salt))
    matched = left.join(right, keys, "inner").where(F.col(value).between(F.col("lo"), F.col("hi")))
    return matched.drop("_bin", "_piece", "_salt", "lo", "hi")
