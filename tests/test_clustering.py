"""Cluster trees and nearest profiles against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionsieve.operators import clustering, distance, metric_index
from ionsieve.plans import frames
from ionsieve.session import detached, materialize


def plain_tree(d, n):
    """(merges, leaf order): the least (distance, first, first) pair merges, one at a time."""
    clusters = {i: ([i], None) for i in range(1, n + 1)}
    near = {(i, j): d[i, j] for i in clusters for j in clusters if i < j}
    merges = []
    while len(clusters) > 1:
        (a, b), height = min(near.items(), key=lambda x: (x[1], x[0]))
        (left, age_a), (right, age_b) = clusters[a], clusters.pop(b)
        both = left + right if (age_a or 0) <= (age_b or 0) else right + left
        merges.append((len(merges) + 1, a, b, height, len(both)))
        clusters[a] = (both, len(merges))
        for c in clusters:
            if c != a:
                keep, gone = (min(a, c), max(a, c)), (min(b, c), max(b, c))
                near[keep] = max(near[keep], near[gone])
        near = {pair: x for pair, x in near.items() if b not in pair}
    return merges, next(iter(clusters.values()))[0]


@pytest.mark.parametrize("kind,n,local", [("ties", 8, 3), ("chain", 7, 1), ("ties", 30, 1024), ("apart", 40, 1024), ("equal", 12, 1024)])
def test_tree_is_the_one_by_one_tree(spark, monkeypatch, kind, n, local):
    monkeypatch.setattr(clustering, "LOCAL", local)
    draw = random.Random(7)
    value = {"apart": lambda i, j: draw.random(), "ties": lambda i, j: float(draw.randint(1, 4)), "chain": lambda i, j: 1.0 + j * j - i, "equal": lambda i, j: 2.0}[kind]
    d = {(i, j): value(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)}
    name = "item{:02}".format
    # Either way round, and in no order.
    rows = [(name(i), name(j), x) if draw.random() < 0.5 else (name(j), name(i), x) for (i, j), x in d.items()]
    draw.shuffle(rows)
    items = spark.createDataFrame([(name(i),) for i in range(n, 0, -1)], "item string")
    distances = spark.createDataFrame(rows, "item_1 string, item_2 string, distance double")
    leaves, merges = clustering.cluster_tree(distances, items, [F.col("item")])
    expected, order = plain_tree(d, n)
    assert sorted(map(tuple, merges.collect())) == [(s, name(a), name(b), h, k) for s, a, b, h, k in expected]
    found = leaves.orderBy("place").collect()
    assert [x.item for x in found] == [name(i) for i in order] and [x.place for x in found] == list(range(1, n + 1))
    assert {x.idx: x.height for x in found} == {i: min(h for _, a, b, h, _ in expected if i in (a, b)) for i in range(1, n + 1)}


@pytest.mark.parametrize("near,local", [(False, 1024), (False, 3), (True, 1024), (True, 2)])
def test_folded_copies_give_the_same_tree(spark, monkeypatch, near, local):
    """Groups of 1 to 4 copies; with `near`, different groups lie at distance 0 too."""
    monkeypatch.setattr(clustering, "LOCAL", local)
    draw = random.Random(9)
    group = [draw.randrange(7) for _ in range(18)]
    known = sorted(set(group))
    between = {(a, b): float(draw.randint(0 if near else 1, 5)) for a in known for b in known if a < b}
    if near:
        between[known[0], known[1]] = between[known[2], known[4]] = 0.0
    d = {(i, j): between.get((min(a, b), max(a, b)), 0.0) for i, a in enumerate(group, 1) for j, b in enumerate(group, 1) if i < j}
    name = "item{:02}".format
    some = {g: name(draw.choice([i for i, x in enumerate(group, 1) if x == g])) for g in known}
    distances = spark.createDataFrame([(some[a], some[b], x) for (a, b), x in between.items()], "item_1 string, item_2 string, distance double")
    items = spark.createDataFrame([(name(i), g) for i, g in enumerate(group, 1)], "item string, group int")
    leaves, merges = clustering.cluster_tree(distances, items.select("item"), [F.col("item")], items)
    expected, order = plain_tree(d, 18)
    assert sorted(map(tuple, merges.collect())) == [(s, name(a), name(b), h, k) for s, a, b, h, k in expected]
    assert [x.item for x in leaves.orderBy("place").collect()] == [name(i) for i in order]


@pytest.mark.parametrize("rows", [4, 64])
def test_tree_from_profiles_stores_no_pairs(spark, monkeypatch, rows):
    """Profiles of two values, with copies and with groups at distance 0 by rounding; clusters outgrow blocks of 4."""
    monkeypatch.setattr(clustering, "LOCAL", 3)
    monkeypatch.setattr(distance, "LINK_ROWS", rows)
    draw = random.Random(4)
    group = [draw.randrange(24) for _ in range(36)]
    values = {g: (draw.random(), draw.random() * 3) for g in set(group)}
    values[group[0]] = tuple(x + 1e-12 for x in values[group[1]])
    n, name = len(group), "item{:02}".format
    d = {(i, j): round(math.dist(values[a], values[b]), 9) for i, a in enumerate(group, 1) for j, b in enumerate(group, 1) if i < j}
    chunks = chunks_of(spark, {name(i): values[g] for i, g in enumerate(group, 1)})
    first, groups = distance.alike(chunks)
    first = materialize(first)
    unread = spark.range(1).select(*(F.raise_error(F.lit("read")).alias(x) for x in ("item_1", "item_2", "distance")))
    leaves, merges = clustering.cluster_tree(unread, chunks.select("item").distinct(), [F.col("item")], groups, first)
    expected, order = plain_tree(d, n)
    assert sorted(map(tuple, merges.collect())) == [(s, name(a), name(b), h, k) for s, a, b, h, k in expected]
    assert [x.item for x in leaves.orderBy("place").collect()] == [name(i) for i in order]


def test_order_of_many_samples_reads_no_pairs(spark, monkeypatch):
    draw = random.Random(8)
    some = [(t, f"m{t}", f"s{i:02}", f"s{i:02}", 20 - i, draw.choice([0.0, 10.0, 1000.0]) + i // 3, 1.0, 100.0) for i in range(20) for t in (1, 2)]
    columns = "target_id long, molecule string, file_id string, file string, pos long, max_intensity double, rt_at_max double, target_mz double"
    frame = materialize(spark.createDataFrame(some, columns))
    rows = lambda: [sorted(map(tuple, x.collect())) for x in frames.cluster_order(frame, "file")]
    expected = rows()
    monkeypatch.setattr(clustering, "LOCAL", 12)
    pairs = distance.pairwise_distances
    monkeypatch.setattr(distance, "pairwise_distances", lambda chunks: pairs(chunks).withColumn("distance", F.raise_error(F.lit("read")).cast("double")))
    assert rows() == expected and [len(x) for x in expected] == [20, 19]


@pytest.mark.parametrize("rows", [3, 1000])
def test_links_are_the_nearest_and_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(distance, "LINK_ROWS", rows)
    monkeypatch.setattr(distance, "LINK_TILE", 8)
    draw = random.Random(5)
    label = [draw.choice([1, 1, 2, 5, 5, 7, 8, 11]) for _ in range(30)]
    vectors = [(i, x, [float(draw.randint(0, 9)) for _ in range(3)]) for i, x in enumerate(label)] + [(99, 20, [float("nan")] * 3)]
    plain = {}
    for _, a, v in vectors[:-1]:
        for _, b, w in vectors[:-1]:
            if a < b:
                plain[a, b] = max(plain.get((a, b), 0.0), round(math.dist(v, w), 4))
    frame = materialize(spark.createDataFrame(vectors, "idx long, label long, v array<double>"))
    found = {(x.lo, x.hi): x.d for x in distance.linked(frame, 4, every=True).collect() if x.hi != 20}
    assert found == plain
    nearest = {x.label: tuple(x.key) for x in clustering._nearest(distance.linked(frame, 4).where("not isnan(d)")).collect()}
    assert nearest == {x: min((d, *pair) for pair, d in plain.items() if x in pair) for x in set(label)}


def test_distances_are_rounded_as_spark_does(spark):
    draw = random.Random(6)
    values = [draw.random() * 10.0 ** draw.randint(-9, 6) for _ in range(300)] + [0.0, 0.125, 1.0000005, 2.5e-7, 1e15 + 0.5, 123456.1234565]
    values += [round(draw.random(), 6) + 5e-7 for _ in range(300)] + [math.inf]
    expected = [x.r for x in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("r")).collect()]
    assert distance._half_up(np.array(values), 6).tolist() == expected


def test_rounds_hand_down_no_estimates(spark):
    """An estimated size would have twice as many digits after each of these rounds."""
    kept = spark.range(3).selectExpr("id", "id + 1 as other")
    for _ in range(12):
        kept = detached(kept.join(kept.select("id"), "id"))
    assert kept.count() == 3 and kept.join(kept, "id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200


def test_trees_of_one_item_and_of_none(spark):
    none = spark.createDataFrame([], "item_1 string, item_2 string, distance double")
    one = spark.createDataFrame([("only",)], "item string")
    leaves, merges = clustering.cluster_tree(none, one, [F.col("item")])
    assert [tuple(x) for x in leaves.collect()] == [("only", 1, 1, None)] and merges.count() == 0
    leaves, merges = clustering.cluster_tree(none, one.where("false"), [F.col("item")])
    assert leaves.count() == 0 and merges.count() == 0


def chunks_of(spark, profiles):
    rows = [(name, f"d{k:03}", float(x)) for name, values in profiles.items() for k, x in enumerate(values)]
    return materialize(distance.profile_chunks(spark.createDataFrame(rows, "item string, dimension string, value double"), "item", "dimension", "value"))


def plain_nearest(profiles, k):
    for name, own in profiles.items():
        others = sorted((round(math.dist(own, x), metric_index.DIGITS), other) for other, x in profiles.items() if other != name)
        for rank, (d, other) in enumerate(others[:k], 1):
            yield name, rank, other, pytest.approx(d, abs=1e-8)


@pytest.mark.parametrize("k,block", [(4, 8), (60, 16)])
def test_nearest_k(spark, monkeypatch, k, block):
    monkeypatch.setattr(metric_index, "BLOCK", block)
    draw = random.Random(k)
    profiles = {f"p{i:03}": [draw.randint(0, 6) for _ in range(3)] for i in range(60)}  # many copies and ties
    found = metric_index.nearest_k(chunks_of(spark, profiles), k)
    assert [tuple(x) for x in found.orderBy("item", "rank").collect()] == sorted(plain_nearest(profiles, k), key=lambda x: x[:2])


def test_alone_and_copies_only(spark):
    one = metric_index.nearest_k(chunks_of(spark, {"a": [1, 2]}), 3)
    assert one.count() == 0
    copies = metric_index.nearest_k(chunks_of(spark, {x: [1, 2] for x in "abcde"}), 2)
    found = [tuple(x) for x in copies.orderBy("item", "rank").collect()]
    assert found[:4] == [("a", 1, "b", 0.0), ("a", 2, "c", 0.0), ("b", 1, "a", 0.0), ("b", 2, "c", 0.0)] and len(found) == 10


def test_equal_norms_meet_few_blocks(spark, monkeypatch):
    """On a circle all norms are equal, yet a profile only meets the blocks around it."""
    monkeypatch.setattr(metric_index, "BLOCK", 16)
    n = 400
    profiles = {f"p{i:04}": [math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)] for i in range(n)}
    items = metric_index._whole(chunks_of(spark, profiles)).select("idx", "v")
    packed, size = metric_index._packed(metric_index._with_coordinates(items, metric_index._pivots(items)), n)
    blocks = packed.select("block").distinct().count()
    met = metric_index.meetings(packed, size, 2).select("block", "host").distinct().count()
    assert blocks >= 25 and met <= 5 * blocks  # all pairs would be blocks squared


PROFILES = pa.list_(pa.struct([("chunk", pa.int64()), ("v", pa.list_(pa.float64()))]))


def test_profiles_from_arrow_are_dense_as_from_pandas():
    draw = random.Random(6)
    some = lambda n: [[{"chunk": c, "v": [draw.random() for _ in range(2 if c == 7 else 4)]} for c in (0, 3, 7) if draw.random() < 0.6] for _ in range(n)]
    left, right = some(9), some(5)
    expected = distance._dense(pd.Series(left), pd.Series(right))
    column = lambda rows: pa.chunked_array([pa.array(rows[:2], PROFILES), pa.array([[]] + rows[2:], PROFILES).slice(1)])
    for found, plain in zip(metric_index._dense_lists(column(left), column(right)), expected):
        assert (found == plain).all()
    assert [x.shape for x in metric_index._dense_lists(column([[], []]), column([[], []]))] == [(2, 0), (2, 0)]


def test_a_visit_returns_only_what_lies_within_reach():
    profile = lambda x: [{"chunk": 0, "v": [float(x), 0.0]}]
    hosts = pa.table({"other": pa.array(range(10), pa.int64()), "w": pa.array([profile(i) for i in range(10)], PROFILES)})
    visit = lambda reach: pa.table({"idx": pa.array([4, 50], pa.int64()), "reach": pa.array(reach), "v": pa.array([profile(4), profile(100)], PROFILES)})
    rows = lambda reach: list(zip(*metric_index._across(3)(visit(reach), hosts).to_pydict().values()))
    assert rows([1.0, 5.0]) == [(4, 3, 1.0), (4, 5, 1.0)]
    far = [(50, 7, 93.0), (50, 8, 92.0), (50, 9, 91.0)]
    assert rows([9.0, np.inf]) == [(4, 2, 2.0), (4, 3, 1.0), (4, 5, 1.0), (4, 6, 2.0)] + far  # the 3rd and the 4th are equally near
    assert rows([0.5, np.nan]) == far


def test_few_and_many_dimensions_give_one_distance():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, metric_index.SPELLED_OUT, metric_index.SPELLED_OUT + 1, 70):
        rows, others = rng.random((6, n)), rng.random((8, n))
        plain = [[math.dist(x, y) for y in others] for x in rows]
        assert metric_index._distances(rows, others) == pytest.approx(np.array(plain).reshape(6, 8), abs=1e-8)
