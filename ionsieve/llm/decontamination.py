"""Benchmark items inside documents: SimHash windows, a multi-index over Hamming blocks, exact verification.

A document is cut into windows as long as an item (in words), at every word. Each window and each item gets a
64-bit SimHash of its weighted shingles. Two fingerprints that differ in at most RADIUS bits agree in at least one of
RADIUS + 1 blocks, so tables by block value find every item within the radius. What they find is verified by the
weighted Jaccard similarity of the exact shingles. A window that holds no shingle of any item cannot pass
that test; it is left out before it is hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .words import shingles_of, slices, text_bytes, words_of

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 16
BITS = 64
# Items that one pass over the documents takes (a few hundred words each); more items take more passes.
ITEMS_PER_PASS = 20_000
SCREEN_BITS = 20
# Shingles of a document that are held as sums of bits at once.
STRETCH = 4096

_EDGES = np.linspace(0, BITS, RADIUS + 2).astype(int)
LEAKS = "doc_id long, item_id long, start_word long, end_word long, distance int, similarity double"


def blocks_of(fingerprints: np.ndarray) -> np.ndarray:
    """RADIUS + 1 block values for each fingerprint."""
    return np.stack(
        [(fingerprints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(_EDGES, _EDGES[1:])], axis=-1
    ).astype(np.int64)


def _sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of +weight and -weight for each bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    signed = (bits.astype(np.float64) * 2 - 1) * weights[:, None]
    return np.concatenate([np.zeros((1, BITS)), np.cumsum(signed, axis=0)])


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8")[:, 0]


class Item(NamedTuple):
    item_id: int
    shingles: np.ndarray  # distinct
    weights: np.ndarray
    fingerprint: np.uint64


class Items:
    """Benchmark items with their fingerprints, by length in words.

    `n` items hold the shingles of the whole benchmark, `holders` of them each; both are those of `rows` unless given.
    """

    def __init__(self, rows: list[tuple[int, str]], k: int = SHINGLE, n: int | None = None, holders: dict[int, int] | None = None) -> None:
        self.k = k
        data, offsets = text_bytes(pa.array([text or "" for _, text in rows], pa.string()))
        words = words_of(data, offsets)
        found = shingles_of(words, k)
        each = [found.hashes[a:b] for a, b in zip(found.first, found.first[1:])]
        distinct = [np.unique(x) for x in each]
        known, counts = np.unique(np.concatenate(distinct) if rows else np.zeros(0, np.uint64), return_counts=True)
        if holders is not None:
            counts = np.array([holders[h] for h in known.tolist()], np.int64)
        # A shingle that many items share says little.
        self.n, self.known = len(rows) if n is None else n, known
        self.known_weights = np.log1p(self.n / np.maximum(counts, 1))
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        self.screen[(known & np.uint64(len(self.screen) - 1)).astype(np.int64)] = True
        self.lengths: dict[int, list[Item]] = {}
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for (item_id, _), shingles, sequence, length in zip(rows, distinct, each, words.counts.tolist()):
            if not length:
                continue
            fingerprint = _packed(_sums(sequence, self.weights(sequence))[-1:])[0]
            self.lengths.setdefault(length, []).append(Item(item_id, shingles, self.weights(shingles), fingerprint))
        # The items that hold a shingle: only they, in windows of their lengths, can match because of it.
        self.holding: dict[int, dict[int, list[int]]] = {}
        for length, items in self.lengths.items():
            for place, x in enumerate(items):
                for h in x.shingles.tolist():
                    self.holding.setdefault(h, {}).setdefault(length, []).append(place)
        for length, items in self.lengths.items():
            tables: list[dict[int, list[int]]] = [{} for _ in range(RADIUS + 1)]
            for place, values in enumerate(blocks_of(np.array([x.fingerprint for x in items], np.uint64)).tolist()):
                for table, value in zip(tables, values):
                    table.setdefault(value, []).append(place)
            self.tables[length] = tables

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return at, (self.known[at] == hashes) if len(self.known) else np.zeros(len(hashes), bool)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        at, found = self._at(hashes)
        top = np.log1p(self.n)
        return np.where(found, self.known_weights[at], top) if len(self.known) else np.full(len(hashes), top)

    def seeds(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        maybe = np.flatnonzero(self.screen[(hashes & np.uint64(len(self.screen) - 1)).astype(np.int64)])
        return maybe[self._at(hashes[maybe])[1]]

    def near(self, length: int, fingerprints: np.ndarray, among: set[int]) -> Iterator[tuple[int, int, int]]:
        """(window, place of the item, distance) for all items of `among` within the radius."""
        items, tables = self.lengths[length], self.tables[length]
        own = np.array([x.fingerprint for x in items], np.uint64)
        values, back = np.unique(fingerprints, return_inverse=True)
        hits: dict[int, list[tuple[int, int]]] = {}
        for v, blocks in enumerate(blocks_of(values).tolist()):
            places = sorted({p for table, value in zip(tables, blocks) for p in table.get(value, ())} & among)
            if places:
                distance = np.bitwise_count(own[places] ^ values[v])
                hits[v] = [(p, int(d)) for p, d in zip(places, distance) if d <= RADIUS]
        for window, v in enumerate(back.tolist()):
            for place, distance in hits.get(v, ()):
                yield window, place, distance

    def leaks(self, hashes: np.ndarray, seeds: np.ndarray, n_words: int) -> dict[int, tuple[int, int, int, float]]:
        """item_id -> (first word, end word, distance, similarity) of its best window in one document."""
        best: dict[int, tuple[int, int, int, float]] = {}
        reach = max(self.lengths)
        for begin in range(0, len(hashes), STRETCH):  # windows that begin in this stretch
            end = min(len(hashes), begin + STRETCH + reach)
            near = seeds[np.searchsorted(seeds, begin) : np.searchsorted(seeds, end)] - begin
            if len(near):
                self._leaks_in(hashes[begin:end], near, begin, n_words, best)
        return best

    def _leaks_in(self, hashes: np.ndarray, seeds: np.ndarray, begin: int, n_words: int, best: dict) -> None:
        sums = _sums(hashes, self.weights(hashes))
        last = min(STRETCH, len(hashes))
        by_length: dict[int, list[int]] = {}
        sharing: dict[int, set[int]] = {}
        for seed, h in zip(seeds.tolist(), hashes[seeds].tolist()):
            for length, places in self.holding[h].items():
                by_length.setdefault(length, []).append(seed)
                sharing.setdefault(length, set()).update(places)
        for length, places in by_length.items():
            size = max(1, length - self.k + 1)
            mark, own = np.zeros(len(hashes) + 1, np.int64), np.array(places)
            np.add.at(mark, np.maximum(own - size + 1, 0), 1)
            np.add.at(mark, own + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[:last] > 0)
            # No window goes beyond the end, but a document shorter than the item is one window.
            starts = starts[starts + begin <= max(0, n_words - length)]
            if not len(starts):
                continue
            ends = np.minimum(starts + size, len(hashes))
            for window, place, distance in self.near(length, _packed(sums[ends] - sums[starts]), sharing[length]):
                item = self.lengths[length][place]
                start, end = int(starts[window]), int(ends[window])
                similarity = self.similarity(item, np.unique(hashes[start:end]))
                if similarity >= SIMILARITY and similarity > best.get(item.item_id, (0, 0, 0, 0.0))[3]:
                    first = start + begin
                    best[item.item_id] = (first, min(first + length, n_words), distance, similarity)

    def similarity(self, item: Item, shingles: np.ndarray) -> float:
        shared = np.isin(item.shingles, shingles, assume_unique=True)
        both = float(item.weights[shared].sum())
        return both / (float(item.weights.sum()) + float(self.weights(shingles).sum()) - both)


def _documents(items: Items, column: pa.Array) -> Iterator[tuple[int, dict[int, tuple[int, int, int, float]]]]:
    """(row, leaks) for the rows of `column` that have any."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found = shingles_of(words, items.k)
        seeds = items.seeds(found.hashes)
        rows = np.searchsorted(found.first, seeds, side="right") - 1
        for row in np.unique(rows).tolist():
            own = seeds[rows == row] - found.first[row]
            hashes = found.hashes[found.first[row] : found.first[row + 1]]
            if leaks := items.leaks(hashes, own, int(words.counts[row])):
                yield a + row, leaks


def _report(items: Items) -> Callable:
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], item, *x) for row, leaks in _documents(items, batch.column(1)) for item, x in leaks.items()]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            names = ["doc_id", "item_id", "start_word", "end_word", "distance", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return report


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, shingle): the distinct shingles of each item."""
    for batch in batches:
        parts = batch.column(0).to_numpy()
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets):
            found = shingles_of(words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), SHINGLE)
            each = [np.unique(found.hashes[x:y]) for x, y in zip(found.first, found.first[1:])]
            part = np.repeat(parts[a:b], [len(x) for x in each])
            shingles = np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int64()), "shingle": pa.array(shingles, pa.int64())})


def item_passes(benchmark: DataFrame, limit: int = ITEMS_PER_PASS) -> Iterator[Items]:
    """The items, at most about `limit` at a time. Null ids and texts without words are passed over.

    How many items hold a shingle is counted over the whole benchmark, so passes give what one alone would.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    rows = rows.dropDuplicates(["item_id", "text"])
    n = rows.count()
    parts = max(1, -(-n // limit))
    if parts == 1:
        yield Items(sorted((x.item_id, x.text) for x in rows.collect()))
        return
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))), "items")
    shingles = written(rows.select("part", "text").mapInArrow(_item_shingles, "part long, shingle long"), "item_shingles")
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("items"), F.collect_set("part").alias("parts"))
    counts = written(counts, "holders")
    for part in range(parts):
        here = counts.where(F.array_contains("parts", F.lit(part).cast("long"))).select("shingle", "items")
        held = {int(np.int64(x.shingle).view(np.uint64)): x["items"] for x in here.collect()}
        yield Items(sorted((x.item_id, x.text) for x in rows.where(F.col("part") == part).collect()), n=n, holders=held)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, end_word, distance, similarity: the best window of each item in each row of `docs`.

    Words count from 0. Null and empty texts have no windows; a document shorter than an item is one window. Null and
    equal doc_ids are ordinary rows. An item of fewer words than a shingle says too little inside a longer text; it is
    found where it is the whole document. Other columns are ignored; an empty table on either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = [docs.mapInArrow(_report(items), LEAKS) for items in item_passes(benchmark)]
    while len(found) > 1:
        found = [x.unionByName(y) for x, y in zip(found[::2], found[1::2])] + found[len(found) & ~1 :]
    return found[0]


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    schema, at = docs.schema, docs.columns.index("text")

    def keep(items: Items) -> Callable:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in _documents(items, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        return kept

    for items in item_passes(benchmark):
        docs = docs.mapInArrow(keep(items), schema)
    return docs
