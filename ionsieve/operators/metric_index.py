"""The k nearest profiles of every profile, found through distances to a few pivots.

A pivot is one of the profiles. Two profiles differ by at least as much as their distances to any pivot do, so a block of
profiles whose distances to a pivot lie in an interval is out of reach for a profile whose own distance lies too
far from it. Profiles are packed into blocks by their distances to the first two pivots, and a table holds the intervals
of every block for all pivots. The k-th distance inside its own block bounds how far a profile has to look.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS, materialize
from .distance import SPELLED_OUT, _dense, _whole
from .ordering import with_index, with_running_total

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256  # profiles of a block
PIVOTS = 6
# Profiles that pivots are chosen from.
CANDIDATES = 64
# Numbers of a difference of blocks that are held at once.
HELD = 1 << 21
# Pairs of a profile and a block that one task looks at, about.
TASK_MEETINGS = 1 << 22
# Distances are compared to so many digits, as sums have no fixed order.
DIGITS = 9

_PROFILE = "array<struct<chunk: bigint, v: array<double>>>"


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The distance of every row to every other one, some dimensions at a time."""
    total = np.zeros((len(rows), len(others)))
    if rows.shape[1] <= SPELLED_OUT:
        for mine, theirs in zip(rows.T, np.ascontiguousarray(others.T)):
            gap = mine[:, None] - theirs[None, :]
            total += gap * gap
        return np.round(np.sqrt(total), DIGITS)
    step = max(1, HELD // max(1, total.size))
    for at in range(0, rows.shape[1], step):
        part = rows[:, None, at : at + step] - others[None, :, at : at + step]
        total += np.einsum("ijk,ijk->ij", part, part)
    return np.round(np.sqrt(total), DIGITS)


def _farthest(rows: pd.DataFrame) -> pd.DataFrame:
    """Pivots among the candidates: each one is the farthest from those before it."""
    rows = rows.sort_values("idx", ignore_index=True)
    vectors = _dense(rows["v"])[0]
    chosen, nearest = [0], _distances(vectors[:1], vectors)[0]
    while len(chosen) < min(PIVOTS, len(rows)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _distances(vectors[chosen[-1:]], vectors)[0])
    return rows.loc[chosen, ["v"]]


def _pivots(profiles: DataFrame) -> list:
    """A few profiles; that many come to the driver, however many there are."""
    drawn = profiles.orderBy(F.xxhash64("idx"), "idx").limit(CANDIDATES).select("idx", "v")
    one = drawn.groupBy(F.pmod("idx", F.lit(1))).applyInPandas(_farthest, f"v {_PROFILE}")
    return [[part.asDict() for part in row.v] for row in one.collect()]


def _with_coordinates(profiles: DataFrame, pivots: list) -> DataFrame:
    """Add `at`: the distances to the pivots."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                rows = batch.iloc[first : first + BLOCK]
                own, of = _dense(rows["v"], pd.Series(pivots, dtype=object))
                yield rows.assign(at=list(_distances(own, of)))

    return profiles.mapInPandas(measured, f"idx long, v {_PROFILE}, at array<double>")


def _packed(profiles: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Add `slab` and `block`: runs along the first pivot's distance, cut along the second one's. Returns a slab's size too."""
    across = max(1, round((count / BLOCK) ** 0.5))
    size = across * BLOCK
    coordinate = lambda k: F.coalesce(F.get("at", F.lit(k)), F.lit(0.0))
    slabs = with_index(profiles, [], [coordinate(0), F.col("idx")], "_place")
    slabs = materialize(slabs.withColumn("slab", F.floor((F.col("_place") - 1) / F.lit(size))).drop("_place"))
    blocks = with_index(slabs, ["slab"], [coordinate(1), F.col("idx")], "_place")
    block = F.col("slab") * F.lit(across) + F.floor((F.col("_place") - 1) / F.lit(BLOCK))
    return materialize(blocks.withColumn("block", block).drop("_place")), size


def _bounds(packed: DataFrame) -> DataFrame:
    """slab, block, low, high: the interval of each block at each pivot."""
    each = packed.select("slab", "block", F.posexplode("at").alias("pivot", "x"))
    ends = each.groupBy("slab", "block", "pivot").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    lists = ends.groupBy("slab", "block").agg(F.sort_array(F.collect_list(F.struct("pivot", "low", "high"))).alias("_"))
    return lists.select("slab", "block", F.col("_.low").alias("low"), F.col("_.high").alias("high"))


def _inside(k: int):
    """A group function: how far each profile of a block has to look for its k nearest."""

    def reach(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = _dense(rows["v"])[0]
        between = _distances(vectors, vectors)
        np.fill_diagonal(between, np.inf)
        enough = len(rows) > k
        limit = np.partition(between, k - 1, axis=1)[:, k - 1] if enough else np.full(len(rows), np.inf)
        return pd.DataFrame({"idx": rows["idx"], "reach": limit})

    return reach


def meetings(packed: DataFrame, slab_size: int, k: int) -> DataFrame:
    """idx, block, reach, host: the blocks that each profile has to meet."""
    own = packed.groupBy("block").applyInPandas(_inside(k), "idx long, reach double")
    spans = materialize(packed.select("idx", "block", "at").join(own, "idx"))
    limit = F.col("reach") * F.lit(1 + 1e-9) + F.lit(1e-8)
    first = F.coalesce(F.get("at", F.lit(0)), F.lit(0.0))
    end = lambda at, kind: F.struct(at.alias("x"), F.lit(kind).alias("kind"))
    ends = spans.select("idx", F.explode(F.array(end(first - limit, 0), end(first + limit, 2))).alias("end")).select("idx", "end.*")
    points = spans.select("idx", first.alias("x"), F.lit(1).alias("kind"))
    # How many profiles lie below either end of a reach tells the first and the last slab in it.
    order = [F.col("x"), F.col("kind"), F.col("idx")]
    ranked = with_running_total(ends.unionByName(points), [], order, (F.col("kind") == 1).cast("long"))
    slab = lambda place: F.floor(place / F.lit(slab_size))
    low, high = F.max(F.when(F.col("kind") == 0, slab(F.col("before")))), F.max(F.when(F.col("kind") == 2, slab(F.col("before") - 1)))
    slabs = ranked.where("kind <> 1").groupBy("idx").agg(F.explode(F.sequence(low, high)).alias("slab"))
    bounds = _bounds(packed).withColumnRenamed("block", "host")
    gaps = F.zip_with("at", F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, i: F.greatest(i.a - x, x - i.b))
    near = F.forall(gaps, lambda gap: gap <= limit)
    count = packed.count()
    blocks = count // BLOCK + 1
    # Few bytes meet many blocks, so tasks are counted by these.
    tasks = max(packed.sparkSession.sparkContext.defaultParallelism, count * blocks // TASK_MEETINGS)
    bounds = F.broadcast(bounds) if blocks <= BROADCAST_MAX_ROWS else bounds
    met = slabs.join(spans, "idx").repartition(tasks, "idx").join(bounds, "slab")
    return met.where(near).select("idx", "block", "reach", "host")


def _dense_lists(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """As distance._dense(), from Arrow columns and without a look at single rows."""
    parts = []
    for column in columns:
        lists = column.combine_chunks()
        offsets, structs = lists.offsets.to_numpy(), lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        values = structs.field("v")
        ends = values.offsets.to_numpy()
        flat = values.values[ends[0] : ends[-1]].to_numpy(zero_copy_only=False)
        parts.append((np.repeat(np.arange(len(lists)), np.diff(offsets)), structs.field("chunk").to_numpy(), np.diff(ends), flat, len(lists)))
    chunks = np.unique(np.concatenate([chunk for _, chunk, *_ in parts]))
    width = np.zeros(len(chunks), np.int64)
    for _, chunk, lengths, *_ in parts:
        np.maximum.at(width, np.searchsorted(chunks, chunk), lengths)
    starts, size, found = np.cumsum(width) - width, int(width.sum()), []
    for row, chunk, lengths, flat, count in parts:
        rows = np.zeros(count * size)
        begins = row * size + starts[np.searchsorted(chunks, chunk)] - (np.cumsum(lengths) - lengths)
        rows[np.repeat(begins, lengths) + np.arange(len(flat))] = flat
        found.append(rows.reshape(count, size))
    return found


def _across(k: int):
    """A cogroup function: of each visiting profile the k nearest ones of a block within its reach, more if equally near; itself left out."""

    def nearest(visitors: pa.Table, hosts: pa.Table) -> pa.Table:
        found = {"idx": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "distance": np.zeros(0)}
        if len(visitors) and len(hosts):
            ids, own = hosts["other"].to_numpy(), visitors["idx"].to_numpy()
            between = _distances(*_dense_lists(visitors["v"], hosts["w"]))
            between[own[:, None] == ids[None, :]] = np.inf
            limit = visitors["reach"].to_numpy() * (1 + 1e-9) + 1e-8
            if len(ids) > k:
                limit = np.fmin(limit, np.partition(between, k - 1, axis=1)[:, k - 1])
            # A bound that is not a number bounds nothing.
            row, at = np.nonzero(~(between > limit[:, None]) & np.isfinite(between))
            found = {"idx": own[row], "other": ids[at], "distance": between[row, at]}
        return pa.table(found)

    return nearest


def nearest_k(chunks: DataFrame, k: int) -> DataFrame:
    """item, rank, nearest, distance: the k nearest other items of each item, ties by item order; all if there are fewer.

    `chunks` come from distance.profile_chunks. Copies of one profile are folded first and count as items of their
    own at distance 0. Distances are rounded to DIGITS digits before they are compared.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    items = materialize(_whole(chunks))
    folded = materialize(items.groupBy("v").agg(F.min("idx").alias("idx")).select("idx", "v"))
    count = folded.count()
    pivots = _pivots(folded)
    packed, slab_size = _packed(_with_coordinates(folded, pivots), count)
    visits = materialize(meetings(packed, slab_size, k))
    hosts = packed.select(F.col("block").alias("host"), F.col("idx").alias("other"), F.col("v").alias("w"))
    wanted = visits.select("block", "host").distinct()
    found = (
        visits.join(folded, "idx")
        .groupBy("block", "host")
        .cogroup(hosts.join(wanted, "host").groupBy("block", "host"))
        .applyInArrow(_across(k), "idx long, other long, distance double")
    )
    best = Window.partitionBy("idx").orderBy("distance", "other")
    near = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).select("idx", "other", "distance")
    return _named(items, folded, near, k)


def _named(items: DataFrame, folded: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Lists of folded profiles as ranked items of every item."""
    members = items.join(folded.withColumnRenamed("idx", "first"), "v").select("item", "idx", "first")
    members = materialize(members)
    by_place = Window.partitionBy("first").orderBy("idx")
    heads = members.withColumn("_rank", F.row_number().over(by_place)).where(F.col("_rank") <= k + 1)
    heads = heads.select(F.col("first").alias("other"), "idx", "item")
    own = members.select(F.col("first").alias("idx")).distinct().select("idx", F.col("idx").alias("other"), F.lit(0.0).alias("distance"))
    lists = near.unionByName(own).withColumnRenamed("idx", "first").join(heads, "other")
    in_list = Window.partitionBy("first").orderBy("distance", "idx")
    lists = lists.withColumn("_rank", F.row_number().over(in_list)).where(F.col("_rank") <= k + 1)
    entry = F.struct("distance", "idx", F.col("item").alias("nearest"))
    # At most k + 1 entries; the item itself is one of them or lies behind them.
    lists = lists.groupBy("first").agg(F.sort_array(F.collect_list(entry)).alias("list"))
    others: Column = F.slice(F.filter("list", lambda x: x.idx != F.col("_self")), 1, k)
    placed = members.withColumnRenamed("idx", "_self").join(lists, "first").select("item", F.posexplode(others).alias("rank", "x"))
    return placed.select("item", (F.col("rank") + 1).alias("rank"), "x.nearest", "x.distance")
