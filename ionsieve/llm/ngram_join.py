"""An exact Jaccard join on word shingles, by prefixes of token combinations.

Tokens (shingles) are ordered from rare to frequent: by the number of documents in which chance would put their words
side by side, from the counts of all words; tokens that are counted far more often than others come last. A document with n tokens can miss at most a quarter of
them in a partner, so a prefix that covers a quarter and one more must share something with it. Rare tokens of the
prefix are indexed one by one. Frequent tokens fall into groups by hash; there only pairs of tokens of one group are
indexed, and the prefix is longer to make up for it: c tokens of a group cover c - 1. Whatever two linked documents
share lies in both prefixes, as both are cut from one order.

Candidates that share an index key are not paired with each other at once. They are compared with the
least of them; where this leaves several components under one key, their members are compared across. So a group of
a thousand near copies costs a thousand comparisons, and no link between components is lost.

Before the sets of a pair are fetched, their parity bitmaps are compared: bit i tells whether an odd number of tokens
fall on i. Bits that differ count tokens that are in one set only, so this bound never rejects a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import written
from .words import Shingles, Words, mix, shingles_of, slices, text_bytes, words_of

SHINGLE = 5
# 100 * intersection >= 75 * union.
PERCENT = 75

# Words and tokens are counted in so many hashed buckets each: tables of fixed size, whatever the input.
WORD_BUCKETS = 1 << 16
TOKEN_BUCKETS = 1 << 20
COUNT_BLOCK = 1 << 16
# A bucket of tokens is frequent if it holds so many square roots more than the mean.
CROWDED = 6.0
# A token is frequent if chance alone makes it so often.
EXPECTED = 0.05
LEVELS_PER_E = 4  # steps of the order per factor e
# Index keys per task that looks for equal ones.
KEYS_PER_BUCKET = 1 << 16
# Ids are broadcast up to so many rows (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1 << 20

_SIGNED = np.int64


def _shingled(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[Words, Shingles]]:
    for a, b in slices(offsets):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield words, shingles_of(words, k)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    bounds = first.tolist()
    for x, y in zip(bounds, bounds[1:]):
        tokens = np.sort(hashes[x:y])
        yield tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if y - x > 1 else tokens


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, as sorted hashes."""
    for _, found in _shingled(data, offsets, k):
        yield from _distinct(found.hashes, found.first)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


class Order(NamedTuple):
    """What the global order of tokens is made of: tables over hashed buckets."""

    log_share: np.ndarray  # of words, by bucket
    crowded: np.ndarray  # whether a bucket of tokens is
    log_total: float  # of words

    @property
    def frequent_from(self) -> np.uint64:
        return np.uint64(self._level(np.log(EXPECTED))) << np.uint64(56)

    @staticmethod
    def _level(log_expected: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((log_expected + 40) * LEVELS_PER_E), 0, 254)

    def ordered(self, words: Words, found: Shingles, k: int) -> np.ndarray:
        """The shingles with their place in the order in front: 8 bits of level, then 56 bits of hash."""
        share = self.log_share[_bucket(words.hashes, WORD_BUCKETS)]
        sums = np.concatenate([[0.0], np.cumsum(share)])
        texts = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
        begin = words.first[texts] + np.arange(len(texts)) - found.first[texts]
        end = np.minimum(begin + k, words.first[texts + 1])
        # Sums in another order may differ in the last digits; rounded before they become levels.
        level = self._level(np.round(sums[end] - sums[begin], 4) + self.log_total)
        level[self.crowded[_bucket(found.hashes, TOKEN_BUCKETS)]] = 255
        return (level.astype(np.uint64) << np.uint64(56)) | (found.hashes >> np.uint64(8))


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(tokens + np.uint64(salt)).sum().astype(_SIGNED)) for salt in (11, 12))


def parity_bitmap(tokens: np.ndarray) -> bytes:
    """At least two bits per token; a power of two, so that a longer bitmap folds onto a shorter one."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound for the tokens that only one of two sets has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(folded ^ b).sum())


SUMMARY = "doc_id long, n long, f1 long, f2 long, bitmap binary, block int, counts binary"


def _summaries(k: int) -> Callable:
    """A row per document (size, fingerprints and bitmap of its set), then the counts of the task's tokens by bucket."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "f1", "f2", "bitmap", "block", "counts"]
        of_words, of_tokens = np.zeros(WORD_BUCKETS, np.int64), np.zeros(TOKEN_BUCKETS, np.int64)
        for batch in batches:
            rows, bitmaps = [], []
            for words, found in _shingled(*text_bytes(batch.column(1)), k):
                np.add.at(of_words, _bucket(words.hashes, WORD_BUCKETS), 1)
                sets = list(_distinct(found.hashes, found.first))
                rows += [(len(tokens), *_fingerprint(tokens)) for tokens in sets]
                bitmaps += map(parity_bitmap, sets)
                np.add.at(of_tokens, _bucket(np.concatenate(sets), TOKEN_BUCKETS), 1)
            n, f1, f2 = np.array(rows, _SIGNED).reshape(-1, 3).T
            nothing = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            columns = [batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *nothing], names=names)
        counts = np.concatenate([of_words, of_tokens]).astype(np.int32)
        blobs = [x.tobytes() for x in counts.reshape(-1, COUNT_BLOCK)]
        empty = [*[pa.nulls(len(blobs), pa.int64())] * 4, pa.nulls(len(blobs), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=names
        )

    return summarise


def _add_counts(block: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in block["counts"])
    return pd.DataFrame({"block": block["block"][:1], "counts": [total.tobytes()]})


def token_order(summaries: DataFrame) -> Order:
    blocks = summaries.where("block is not null").select("block", "counts")
    sums = blocks.groupBy("block").applyInPandas(_add_counts, "block int, counts binary").collect()
    counts = np.zeros(WORD_BUCKETS + TOKEN_BUCKETS, np.int64)
    for row in sums:
        counts[row.block * COUNT_BLOCK : (row.block + 1) * COUNT_BLOCK] = np.frombuffer(row.counts, np.int64)
    words, tokens = np.split(counts, [WORD_BUCKETS])
    total = max(1, words.sum())
    mean = tokens.mean()
    return Order(np.log(np.maximum(words, 1) / total), tokens > mean + CROWDED * np.sqrt(mean) + 1, float(np.log(total)))


def _levels(n: int) -> set[int]:
    """log2 of the number of groups of frequent tokens: at this size, and at the least size of a partner."""
    return {max(1, size // 3).bit_length() - 1 for size in (n, -(-n * PERCENT // 100))}


def prefix_keys(ordered: np.ndarray, frequent_from: np.uint64) -> np.ndarray:
    """The index keys of one document, whose tokens come in global order.

    With at most n/3 groups, all frequent tokens together cover what the prefix needs, so it always ends.
    """
    n = len(ordered)
    need = n * (100 - PERCENT) // 100 + 1
    rare = int(np.searchsorted(ordered, frequent_from))
    keys = [mix(ordered[: min(rare, need)])]
    if rare >= need:
        return keys[0]
    tokens = mix(ordered[rare:])
    for level in sorted(_levels(n)):
        group = tokens >> np.uint64(64 - level) if level else np.zeros(len(tokens), np.uint64)
        by_group = np.lexsort((tokens, group))
        sorted_tokens, group = tokens[by_group], group[by_group]
        covers = np.concatenate([[0], (group[1:] == group[:-1]).astype(np.int64)])
        end = int(np.searchsorted(np.cumsum(covers), need - rare)) + 1
        sorted_tokens, group = sorted_tokens[:end], group[:end]
        step = 1
        while step < len(group) and (same := group[step:] == group[:-step]).any():
            pair = sorted_tokens[:-step] * np.uint64(0x9E3779B97F4A7C15) + sorted_tokens[step:] + np.uint64(level)
            keys.append(mix(pair[same]))
            step += 1
    return np.concatenate(keys)


def _index(order_: Order, bits: int, k: int) -> Callable:
    """Rows (bucket, keys, owners): packed index keys and the fingerprints of the sets that have them."""
    frequent_from = order_.frequent_from

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        owners: list[int] = []

        def packed() -> pa.RecordBatch:
            flat = np.concatenate(keys)
            owner = np.repeat(np.array(owners, _SIGNED), [len(x) for x in keys])
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            bucket = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
            numbers, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:].tolist(), len(flat)]
            spans = list(zip(starts.tolist(), ends))
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": numbers,
                    "keys": pa.array([flat[a:b].tobytes() for a, b in spans], pa.binary()),
                    "owners": pa.array([owner[a:b].tobytes() for a, b in spans], pa.binary()),
                }
            )

        held = 0
        for batch in batches:
            for words, found in _shingled(*text_bytes(batch.column(1)), k):
                sets = zip(_distinct(found.hashes, found.first), _distinct(order_.ordered(words, found, k), found.first))
                for tokens, ordered in sets:
                    if len(tokens) < 2:  # one token: only an equal set is near
                        continue
                    owner = _fingerprint(tokens)[0]
                    if owner in seen:  # a copy; those in other tasks add equal rows
                        continue
                    seen.add(owner)
                    keys.append(prefix_keys(ordered, frequent_from))
                    owners.append(owner)
                    held += len(keys[-1])
                if held > 1 << 20:
                    yield packed()
                    keys, owners, held, seen = [], [], 0, set()
        if keys:
            yield packed()

    return index


def _stars(rows: pd.DataFrame) -> pd.DataFrame:
    """For each key with several owners, the least owner with each of the others."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
    owners = np.concatenate([np.frombuffer(x, _SIGNED) for x in rows["owners"]])
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    begins = np.concatenate([[True], keys[1:] != keys[:-1]])
    least = owners[begins][np.cumsum(begins) - 1]
    apart = least != owners
    pairs = np.unique(np.stack([least[apart], owners[apart]], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sets(k: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [x.tobytes() for x in token_sets(*text_bytes(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "tokens"])

    return pack


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = (batch.column(k) for k in range(4))
        shared = []
        for x, y in zip(left, right):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            shared.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(shared, pa.int64())], names=["a", "b", "shared"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, a_n, b_n and the least difference of the last two columns, bitmaps; null where the sizes do not fit."""
    for batch in batches:
        m, n = (batch.column(k).to_numpy() for k in (2, 3))
        fit = np.minimum(m, n) * 100 >= np.maximum(m, n) * PERCENT
        x, y = (batch.column(k) for k in (4, 5))
        bounds = [least_difference(x[k].as_py(), y[k].as_py()) if fit[k] else None for k in range(len(m))]
        names = ["a", "b", "a_n", "b_n", "least"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bounds, pa.int64())], names=names)


def _sizes_fit(x: str, y: str) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of `docs` with these ids; the texts move only if the ids are too many to broadcast."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


BOUNDS = "a long, b long, a_n long, b_n long, least long"


def _with_bounds(pairs: DataFrame, sets: DataFrame, key: str = "id") -> DataFrame:
    """(a, b) by id and size, with `least`: a lower bound of the tokens in one set only, null if the sizes do not fit.

    `pairs` (a, b) name the sets by their column `key`.
    """
    side = lambda x: sets.select(
        F.col(key).alias(x), F.col("id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("bitmap").alias(f"{x}_map")
    )
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    both = both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_n", "b_n", "a_map", "b_map")
    return written(both.mapInArrow(_differences, BOUNDS), "bounds")


def _compared(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """`pairs` with `shared`, from the whole sets; null where `least` is null or shows that the pair does not link."""
    # Jaccard similarity is (sizes - difference) / (sizes + difference), with both sizes added.
    sizes = F.expr("a_n + b_n")
    open_ = pairs.where((sizes - F.col("least")) * 100 >= (sizes + F.col("least")) * PERCENT).select("a", "b")
    ids = written(open_.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = _with_ids(docs, ids).groupBy("doc_id").agg(F.min("text").alias("text"))
    tokens = written(texts.mapInArrow(_sets(k), "id long, tokens binary"), "sets")
    left = open_.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("left")), "a")
    both = left.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("right")), "b")
    exact = both.select("a", "b", "left", "right").mapInArrow(_intersections, "a long, b long, shared long")
    return written(pairs.join(exact, ["a", "b"], "left"), "compared")


_UNION = "(a_n + b_n - shared)"
_LINKED = f"shared * 100 >= {_UNION} * {PERCENT}"
# The distance of a compared pair: exact, or bounded from below by bitmap or size.
_LOW = f"coalesce(1 - shared / {_UNION}, 2 * least / (a_n + b_n + least), 1 - least(a_n, b_n) / greatest(a_n, b_n))"
_HIGH = f"coalesce(1 - shared / {_UNION}, 1D)"
_WITHIN = (100 - PERCENT) / 100 + 1e-9


def _members(stars: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """a, id, n, group, apart (not in the group of a), low, high: the members of stars that have some apart, a itself not.

    Without `groups` the members that a links are its group, and each other one is a group of its own.
    """
    if groups is None:
        linked = F.coalesce(F.expr(_LINKED), F.lit(False))
        members = stars.withColumns({"a_group": F.col("a"), "b_group": F.when(linked, F.col("a")).otherwise(F.col("b"))})
    else:
        of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"{side}_group"))
        members = stars.join(of("a"), "a", "left").join(of("b"), "b", "left")
    group_of = lambda side: F.coalesce(f"{side}_group", side)
    apart = group_of("a") != group_of("b")
    members = members.select(
        "a", F.col("b").alias("id"), F.col("b_n").alias("n"), group_of("b").alias("group"), apart.alias("apart"),
        F.expr(_LOW).alias("low"), F.expr(_HIGH).alias("high"),
    )
    return members.join(members.where("apart").select("a").distinct(), "a", "left_semi")


def _second_stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the member nearest to each star's own with the members outside its group."""
    centre = F.min(F.struct("high", "id", "n", "group", "low")).alias("c")
    pairs = members.join(members.groupBy("a").agg(centre), "a").where("`group` <> c.group")
    pairs = pairs.where(F.greatest(F.expr("low - c.high"), F.expr("c.low - high")) <= _WITHIN)
    pairs = pairs.where(_sizes_fit("c.n", "n"))
    return pairs.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


# Members that are held against others at once.
ACROSS = 2000
ACROSS_BUCKETS_ROWS = 1 << 15


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a member apart (side 0) and another (side 1) of one part of a star that sizes, distances and bitmaps allow."""
    found = []
    for _, part in rows.groupby(["a", "i", "j"], sort=False):
        side = part["side"].to_numpy()
        x, y = part[side == 0], part[side == 1]
        if not len(x) or not len(y):
            continue
        ids, n, group, low, high = (y[c].to_numpy() for c in ("id", "n", "group", "low", "high"))
        maps = y["bitmap"].tolist()
        lengths = np.array([len(m) for m in maps])
        folded: dict[int, np.ndarray] = {}  # all bitmaps of at least a length, folded to it

        def at_length(size: int) -> np.ndarray:
            if size not in folded:
                fold = lambda m: np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, size), axis=0)
                folded[size] = np.array([fold(m) if len(m) >= size else np.zeros(size, np.uint8) for m in maps])
            return folded[size]

        for xid, xn, xgroup, xlow, xhigh, xmap in zip(*(x[c].tolist() for c in ("id", "n", "group", "low", "high", "bitmap"))):
            ok = (group != xgroup) & (np.minimum(n, xn) * 100 >= np.maximum(n, xn) * PERCENT)
            ok &= np.maximum(low - xhigh, xlow - high) <= _WITHIN
            for size in np.unique(np.minimum(lengths[ok], len(xmap))).tolist():
                at = np.flatnonzero(ok & (np.minimum(lengths, len(xmap)) == size))
                own = np.bitwise_xor.reduce(np.frombuffer(xmap, np.uint8).reshape(-1, size), axis=0)
                least = np.bitwise_count(at_length(size)[at] ^ own).sum(axis=1, dtype=np.int64)
                both = n[at] + xn
                near = (both - least) * 100 >= (both + least) * PERCENT
                for k, bound in zip(at[near].tolist(), least[near].tolist()):
                    pair = sorted([(xid, xn), (int(ids[k]), int(n[k]))])
                    found.append((pair[0][0], pair[1][0], pair[0][1], pair[1][1], bound))
    return pd.DataFrame(sorted(set(found)), columns=["a", "b", "a_n", "b_n", "least"]).astype("int64")


def _across_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """What is left between the groups of each star: (a, b, a_n, b_n, least), large stars in parts of ACROSS members."""
    # Only stars of more than ACROSS members have several parts, so they are few, and no star has to meet in one task.
    large = members.groupBy("a").agg(F.ceil(F.count("*") / ACROSS).alias("parts")).where("parts > 1")
    large = written(large, "large-stars")
    if large.count() <= BROADCAST_IDS:
        large = F.broadcast(large)
    members = members.join(large, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    members = members.join(sets.select("id", "bitmap"), "id")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    columns = ["a", "id", "n", "group", "low", "high", "bitmap"]
    left = members.where("apart").select(*columns, F.lit(0).alias("side"), F.col("part").alias("i"), others.alias("j"))
    right = members.select(*columns, F.lit(1).alias("side"), others.alias("i"), F.col("part").alias("j"))
    buckets = members.count() // ACROSS_BUCKETS_ROWS + 1
    both = left.unionByName(right).groupBy(F.pmod(F.xxhash64("a", "i", "j"), F.lit(buckets * 8)))
    return both.applyInPandas(_across, "a long, b long, a_n long, b_n long, least long").distinct()


def similar_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs` (doc_id, text).

    Documents link when 100 * intersection >= 75 * union of their distinct k-word shingles; a shorter
    text is one shingle. Texts without words have no shingles and link with nothing. Null texts count as empty. A row
    whose doc_id is null links with nothing and gets a null component. Rows with one doc_id and different texts
    are one node; where sets are compared, its least text counts. Other columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    summaries = written(docs.mapInArrow(_summaries(k), SUMMARY), "summaries")
    rows = summaries.where("block is null").select("doc_id", "n", "f1", "f2", "bitmap")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n")
    sets = written(sets.agg(F.min("doc_id").alias("id"), F.min("bitmap").alias("bitmap")), "distinct-sets")
    order = token_order(summaries)
    keys = (sets.agg(F.sum("n")).first()[0] or 0) // 3
    bits = max(0, (keys // KEYS_PER_BUCKET).bit_length())
    index = docs.where("doc_id is not null").mapInArrow(_index(order, bits, k), "bucket long, keys binary, owners binary")
    stars = index.groupBy("bucket").applyInPandas(_stars, "a long, b long").distinct()
    stars = _compared(_with_bounds(stars, sets, "f1"), docs, k)
    linked = stars.where(_LINKED).select("a", "b")
    # A star whose least member is at its rim leaves many apart that the one nearest to it links.
    second = _compared(_with_bounds(_second_stars(_members(stars)), sets), docs, k)
    linked = linked.unionByName(second.where(_LINKED).select("a", "b"))
    groups = components(linked)
    across = written(_across_pairs(written(_members(stars, groups), "members"), sets), "across")
    linked = linked.unionByName(_compared(across, docs, k).where(_LINKED).select("a", "b"))
    groups = components(linked)

    sets = sets.join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    sets = sets.select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    found = rows.drop("bitmap").join(sets, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
