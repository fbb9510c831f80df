"""Complete-linkage clustering of items, and the order of the leaves of its tree.

The clusters live in tables: distances between clusters, and the members of each. A round merges every pair of clusters
that are each other's nearest at the same time. Under complete linkage no merge brings another cluster nearer, so these are
merges that the one-by-one procedure makes too. Rounds go on until LOCAL clusters are left, whose distances fit into one
task; it merges them one by one. A cluster is named after its first item. Pairs at equal distance rank by the names of
their clusters, the smaller one first, which makes the tree unique.

Every pair of items has a distance, so this is for items that someone chose, as for a chart. Where the items' profiles are
given, distances of more than LOCAL clusters are taken anew in each round and never stored.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS, at_most, detached, materialize
from .distance import linked, whole_profiles
from .ordering import with_index, with_running_total

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Clusters that one task may merge: a matrix of 128 MB.
LOCAL = 4_096

FORMED = "struct<d: double, lo: bigint, hi: bigint>"


def _small(df: DataFrame) -> DataFrame:
    """A materialised frame, broadcast if its rows are few."""
    return F.broadcast(df) if at_most(df, BROADCAST_MAX_ROWS) else df


def _nearest(distances: DataFrame) -> DataFrame:
    """(label, key): the distance of each cluster to its nearest, and both names."""
    key = F.struct("d", "lo", "hi")
    ends = distances.select(F.explode(F.array("lo", "hi")).alias("label"), key.alias("key"))
    return ends.groupBy("label").agg(F.min("key").alias("key"))


def _mutual(nearest: DataFrame) -> DataFrame:
    """(lo, hi, d): pairs of clusters that are each other's nearest."""
    return nearest.groupBy("key").agg(F.count("*").alias("sides")).where("sides = 2").select("key.*")


def _moves(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """What becomes of the clusters that merge: label, into, shift (places that its items move on), n, formed.

    On the left is an item that stands alone, before a cluster; of two items the first; of two clusters the one formed earlier.
    """
    heads = members.where("idx = label").select("label", "n", "formed")
    side = lambda name: heads.select(F.col("label").alias(name), F.struct("n", F.struct("formed", F.lit(0)).alias("age")).alias(f"of_{name}"))
    both = pairs.join(side("lo"), "lo").join(side("hi"), "hi")
    # Nulls sort first: no item that stands alone has been formed. Two of these go by name, and lo is the smaller one.
    lo_first = F.coalesce(F.col("of_lo.age") <= F.col("of_hi.age"), F.lit(True))
    total, formed = F.col("of_lo.n") + F.col("of_hi.n"), F.struct("d", "lo", "hi")
    move = lambda label, first, other: F.struct(
        F.col(label).alias("label"),
        F.col("lo").alias("into"),
        F.when(first, F.lit(0)).otherwise(F.col(other)).cast("long").alias("shift"),
        total.alias("n"),
        formed.alias("formed"),
    )
    moves = F.array(move("lo", lo_first, "of_hi.n"), move("hi", ~lo_first, "of_lo.n"))
    return both.select(F.explode(moves).alias("m")).select("m.*")


def _moved_members(members: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select("label", "into", "shift", F.col("n").alias("_n"), F.col("formed").alias("_formed"))
    found = F.col("into").isNotNull()
    return members.join(to, "label", "left").select(
        "idx",
        F.coalesce("into", "label").alias("label"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"),
        F.when(found, F.col("_n")).otherwise(F.col("n")).alias("n"),
        F.when(found, F.col("_formed")).otherwise(F.col("formed")).alias("formed"),
    )


def _moved_distances(distances: DataFrame, moves: DataFrame) -> DataFrame:
    """Distances between what is left: the largest between two clusters' members."""
    to = lambda old, new: moves.select(F.col("label").alias(old), F.col("into").alias(new))
    relabelled = distances.join(to("lo", "_lo"), "lo", "left").join(to("hi", "_hi"), "hi", "left")
    lo, hi = F.coalesce("_lo", "lo"), F.coalesce("_hi", "hi")
    pairs = relabelled.select(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"), "d").where("lo <> hi")
    return pairs.groupBy("lo", "hi").agg(F.max("d").alias("d"))


def _folded(numbered: DataFrame, alike: DataFrame | None) -> DataFrame:
    """item, idx, label (the first of the item's group), k (1-based place in it), n and last (its size and last item)."""
    if alike is None:
        one = F.lit(1).cast("long")
        return numbered.select("item", "idx", F.col("idx").alias("label"), one.alias("k"), one.alias("n"), F.col("idx").alias("last"))
    placed = materialize(with_running_total(numbered.join(alike, "item"), ["group"], [F.col("idx")], F.lit(1).cast("long")))
    groups = placed.groupBy("group").agg(F.min("idx").alias("label"), F.max("idx").alias("last"))
    return materialize(placed.join(groups, "group").select("item", "idx", "label", (F.col("before") + 1).alias("k"), F.col("total").alias("n"), "last"))


def _taken_apart(near: DataFrame, folded: DataFrame) -> DataFrame:
    """`folded` with the groups of `near` (label) taken apart, and `group`, the label before. Groups that lie at distance 0 from
    another one need that: their copies need not merge before the groups do."""
    apart = near.withColumn("_apart", F.lit(True))
    kept = folded.join(apart, "label", "left").withColumn("group", F.col("label"))
    alone = lambda value, name: F.when(F.col("_apart"), value).otherwise(F.col(name)).alias(name)
    one = F.lit(1).cast("long")
    return materialize(kept.select("item", "idx", "group", alone(F.col("idx"), "label"), alone(one, "k"), alone(one, "n"), alone(F.col("idx"), "last")))


def _unfolded(rows: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distances and items, with the groups taken apart that lie at distance 0 from another one."""
    near = materialize(rows.where("d = 0").select(F.explode(F.array("lo", "hi")).alias("label")).distinct())
    if near.isEmpty():
        return rows, folded
    kept = _taken_apart(near, folded)
    heads = kept.where("idx = label")
    side = lambda old, new: heads.select(F.col("group").alias(old), F.col("label").alias(new))
    across = rows.join(side("lo", "i"), "lo").join(side("hi", "j"), "hi").select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "d")
    inside = side("group", "lo").join(side("group", "hi"), "group").where("lo < hi").select("lo", "hi", F.lit(0.0).alias("d"))
    return materialize(across.unionByName(inside)), kept.drop("group")


def _unfolded_profiles(vectors: DataFrame, folded: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """The same with profiles (idx, v): one for each group, and one for each item of a group that is taken apart."""
    nearest = _nearest(linked(vectors.withColumn("label", F.col("idx")), digits))
    near = materialize(nearest.where("key.d = 0").select("label"))
    if near.isEmpty():
        return vectors, folded
    kept = _taken_apart(near, folded)
    heads = kept.where("idx = label").select(F.col("group").alias("idx"), "label")
    return materialize(vectors.join(heads, "idx").select(F.col("label").alias("idx"), "v")), kept.drop("group")


def _copies_merged(folded: DataFrame) -> DataFrame:
    """The merges inside groups of copies, as _moves gives them: one copy after the other joins the first one."""
    formed = F.struct(F.lit(0.0).alias("d"), F.col("label").alias("lo"), F.col("idx").alias("hi"))
    later = folded.where("k > 1").select(F.explode(F.array("label", "idx")).alias("label"), formed.alias("formed"), F.col("k").alias("n"))
    return later.withColumn("formed", F.col("formed").cast(FORMED))


def cluster_tree(
    distances: DataFrame,
    items: DataFrame,
    order: Sequence[Column],
    alike: DataFrame | None = None,
    profiles: DataFrame | None = None,
    digits: int = 9,
) -> tuple[DataFrame, DataFrame]:
    """(leaves, merges) of the complete-linkage tree.

    distances: item_1, item_2, distance, one row for every pair of `items`, either way round. items: item, and what
    `order` needs, which numbers them; it decides between equals. With `alike` (item, group), items of one group are copies
    at distance 0 from each other, and `distances` has a row for every pair of groups only, under any item of theirs.

    profiles: the chunks (see distance.profile_chunks) that `distances`, rounded to `digits`, come from, one profile for each group. With
    these, more than LOCAL groups have their distances taken in every round and stored in none, and `distances` is not read.

    leaves: item, idx (1-based), place (1-based, along the tree), height (at which the item first merges, null for a
    single item). merges: step (1-based, by rising height), a, b (first items of both sides), height, n_items.
    """
    numbered = materialize(with_index(items, [], list(order), "idx").select("item", "idx"))
    folded = _folded(numbered, alike)
    if profiles is not None and folded.where("idx = label").count() > LOCAL:
        vectors = materialize(whole_profiles(profiles).join(folded.select("item", F.col("label").alias("idx")), "item").select("idx", "v"))
        if alike is not None:
            vectors, folded = _unfolded_profiles(vectors, folded, digits)
        members, merged = _begun(folded)
        rows, members, more = _rounds_on_profiles(vectors, members, digits)
    else:
        name = lambda side, number: folded.select(F.col("item").alias(f"item_{side}"), F.col("label").alias(number))
        known = distances.join(_small(name(1, "i")), "item_1").join(_small(name(2, "j")), "item_2")
        rows = materialize(known.select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("distance").alias("d")))
        if alike is not None:
            rows, folded = _unfolded(rows, folded)
        members, merged = _begun(folded)
        rows, members, more = _rounds(rows, members)
    merged += more
    last = materialize(_finished(rows, members))
    merged.append(last.where("shift is null"))
    shifts = last.where("shift is not null").select("label", "shift")
    steps, firsts = _steps(merged, numbered)
    places = members.join(F.broadcast(shifts), "label", "left")  # one row for each of the clusters left
    places = places.select("idx", (F.col("place") + F.coalesce("shift", F.lit(0)) + 1).alias("place"))
    leaves = numbered.join(places, "idx").join(firsts, "idx", "left").select("item", "idx", "place", "height")
    return leaves, steps


def _begun(folded: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The clusters before the first round, copies merged, and the moves of these."""
    # The second copy stands behind the first one, each later one, as it stands alone, in front of all before it.
    place = F.when(F.col("k") > 2, F.col("n") - F.col("k")).otherwise(F.greatest(F.col("n") - 3 + F.col("k"), F.lit(0)))
    formed = F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("d"), F.col("label").alias("lo"), F.col("last").alias("hi")))
    members = folded.select("idx", "label", place.cast("long").alias("place"), "n", formed.cast(FORMED).alias("formed"))
    return members, [_copies_merged(folded)]


def _rounds(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Distances and members when at most LOCAL clusters are left, and the moves of each round."""
    left, merged = members.where("idx = label").count(), []
    while left > LOCAL and not rows.isEmpty():
        moves = detached(_moves(_mutual(_nearest(rows)), members))
        merged.append(moves)
        left -= moves.count() // 2
        moves = _small(moves)
        members = detached(_moved_members(members, moves))
        rows = detached(_moved_distances(rows, moves))
    return rows, members, merged


def _rounds_on_profiles(vectors: DataFrame, members: DataFrame, digits: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The same from profiles (idx, v)."""
    now = lambda: detached(vectors.join(members.select("idx", "label"), "idx"))
    left, merged = members.where("idx = label").count(), []
    while left > LOCAL:
        moves = detached(_moves(_mutual(_nearest(linked(now(), digits))), members))
        made = moves.count() // 2
        if not made:  # no finite distance is left
            break
        merged.append(moves)
        left -= made
        members = detached(_moved_members(members, _small(moves)))
    return linked(now(), digits, every=True), members, merged


def _finished(rows: DataFrame, members: DataFrame) -> DataFrame:
    """label, formed, n, shift: the merges of the clusters that are left, two rows each as in _moves but with no shift, and
    by how many places each cluster moves on in all."""
    heads = members.where("idx = label").select("label", "n", F.col("formed.d").alias("d"), F.col("formed.lo").alias("lo"), F.col("formed.hi").alias("hi"))
    one = lambda key: F.pmod(F.col(key), F.lit(1))
    pairs = rows.groupBy(one("lo"))
    return pairs.cogroup(heads.groupBy(one("label"))).applyInPandas(_one_by_one, f"label long, formed {FORMED}, n long, shift long")


def _one_by_one(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    heads = heads.sort_values("label", ignore_index=True)
    labels, m = heads["label"].to_numpy(), len(heads)
    matrix = np.full((m, m), np.inf)
    i, j = np.searchsorted(labels, rows["lo"].to_numpy()), np.searchsorted(labels, rows["hi"].to_numpy())
    matrix[i, j] = matrix[j, i] = rows["d"].to_numpy()
    sizes = heads["n"].tolist()
    # An item that stands alone is younger than any cluster.
    ages = [(-np.inf, 0, 0) if pd.isna(d) else (d, lo, hi) for d, lo, hi in zip(heads["d"], heads["lo"], heads["hi"])]
    inside, shifts = [[k] for k in range(m)], np.zeros(m, np.int64)
    to, nearest = np.zeros(m, np.int64), np.full(m, np.inf)

    def look(k: int) -> None:
        """The nearest of the later clusters; the first of equal ones."""
        if k + 1 < m:
            to[k] = k + 1 + int(np.argmin(matrix[k, k + 1 :]))
            nearest[k] = matrix[k, to[k]]

    for k in range(m):
        look(k)
    out = []
    while m > 1:
        i = int(np.argmin(nearest))
        if not np.isfinite(nearest[i]):
            break
        j, d = int(to[i]), float(nearest[i])
        first, second = (i, j) if ages[i] <= ages[j] else (j, i)
        shifts[inside[second]] += sizes[first]
        sizes[i] += sizes[j]
        inside[i] += inside[j]
        ages[i] = formed = (d, int(labels[i]), int(labels[j]))
        out += [(int(labels[k]), formed, sizes[i], None) for k in (i, j)]
        joint = np.maximum(matrix[i], matrix[j])
        joint[[i, j]] = np.inf
        matrix[i] = matrix[:, i] = joint
        matrix[j] = matrix[:, j] = np.inf
        nearest[j] = np.inf
        # Distances only grow, so nobody else's nearest changes.
        for k in np.flatnonzero(np.isfinite(nearest) & ((to == i) | (to == j))).tolist() + [i]:
            look(k)
    out += [(label, None, size, shift) for label, size, shift in zip(labels.tolist(), sizes, shifts.tolist())]
    found = pd.DataFrame(out, columns=["label", "formed", "n", "shift"])
    found["formed"] = [None if x is None else dict(zip(("d", "lo", "hi"), x)) for x in found["formed"]]
    return found.astype({"label": "int64", "n": "int64", "shift": "Int64"})


def _steps(merged: list[DataFrame], numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges, height of each item's first merge) from the moves of all rounds."""
    none = numbered.where("false").select(
        F.col("idx").alias("label"), F.lit(None).cast(FORMED).alias("formed"), F.lit(0).cast("long").alias("n")
    )
    moves = none
    for rows in merged:
        moves = moves.unionByName(rows.select("label", "formed", "n"))
    moves = materialize(moves)
    firsts = moves.groupBy(F.col("label").alias("idx")).agg(F.min("formed.d").alias("height"))
    each = moves.where(F.col("label") == F.col("formed.lo")).select("formed.*", "n")
    placed = with_index(each, [], [F.col("d"), F.col("lo"), F.col("hi")], "step")
    name = lambda side, number: numbered.select(F.col("item").alias(side), F.col("idx").alias(number))
    named = placed.join(name("a", "lo"), "lo").join(name("b", "hi"), "hi")
    return named.select("step", "a", "b", F.col("d").alias("height"), F.col("n").alias("n_items")), firsts
