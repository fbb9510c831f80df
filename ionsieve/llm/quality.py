"""A quality classifier on learned subword embeddings.

A document's features are its words, a mark on words that repeat the one before, and its character
n-grams, hashed into buckets. Each bucket has a
learned vector; their average over the document feeds a softmax. Vectors and softmax are trained together by
stochastic gradient descent in numpy. Once trained, a bucket only matters through the product of its vector
with the softmax weights, so scoring takes one number per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices, text_bytes, words_of

BUCKETS = 1 << 16
DIMENSIONS = 8
CHARACTERS = (3, 4, 5)
EPOCHS = 6
RATE = 0.5
SEED = 7
# The model is fitted on so many labelled rows at most, those with the smallest hashed doc_id.
TRAINING_ROWS = 3072
ACCEPT = 0.7

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features: for each kind the buckets of all texts, in order, and the n+1 places where a text's begin."""
    shift = np.uint32(32 - buckets.bit_length() + 1)
    words = words_of(data, offsets, fold=False)
    found = [((words.hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32), words.first)]
    # A word that repeats the one before it counts as one more word, the same for all; the rest as another.
    repeats = np.zeros(len(words.hashes), np.int32)
    repeats[1:] = words.hashes[1:] == words.hashes[:-1]
    found.append((repeats, words.first))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = leads[offsets]
    rolled = np.zeros(len(points), np.uint32)
    for n in range(1, max(CHARACTERS) + 1):
        size = max(0, len(points) - n + 1)
        rolled = rolled[:size] * np.uint32(0x01000193) + points[n - 1 :] * _ODD[n - 1]
        if n in CHARACTERS:
            hashed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            hashed = (hashed >> shift).astype(np.int32)
            lengths = np.maximum(np.diff(bounds) - n + 1, 0)
            inside = np.zeros(size + 1, np.int8)  # +1 where a text's n-grams begin, -1 where they end
            np.add.at(inside, bounds[:-1][lengths > 0], 1)
            np.add.at(inside, (bounds[:-1] + lengths)[lengths > 0], -1)
            keep = np.cumsum(inside[:size], dtype=np.int8) > 0
            found.append((hashed[keep], np.concatenate([[0], np.cumsum(lengths)])))
    return found


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, buckets, counts: each text as a bag of buckets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        rows: list[tuple[bytes, bytes]] = []
        for k in range(batch.num_rows):
            kinds = features(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
            every = np.concatenate([x for x, _ in kinds])
            which, counts = np.unique(every, return_counts=True)
            rows.append((which.astype(np.int32).tobytes(), counts.astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())],
            names=["label", "buckets", "counts"],
        )


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Fit on (label, buckets, counts); returns a number per bucket and a bias, whose sum is the log-odds of label 1.

    Without bags the odds are even; with one label only, all documents get the smoothed share of it.
    """
    ones = sum(label for label, _, _ in bags)
    bias = float(np.log((ones + 0.5) / (len(bags) - ones + 0.5)))
    if not 0 < ones < len(bags):
        return np.zeros(buckets, np.float32), bias
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1, 1, (buckets, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((DIMENSIONS, 2), np.float32)
    offset = np.array([0, bias], np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(bags)):
            label, which, counts = bags[k]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(which):
                continue
            share = counts / counts.sum()
            hidden = share @ vectors[which]
            logits = hidden @ output + offset
            odds = np.exp(logits - logits.max())
            slope = odds / odds.sum()
            slope[label] -= 1
            back = output @ slope
            output -= rate * np.outer(hidden, slope)
            offset -= np.float32(0.1 * rate) * slope
            # Averaging divides a bucket's slope by the document's length; the square root gives part of it back.
            vectors[which] -= rate * np.sqrt(counts.sum()) * share[:, None] * back[None, :]
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(offset[1] - offset[0])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags = []
    for batch in batches:
        for label, which, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            bags.append((label, np.frombuffer(which, np.int32), np.frombuffer(counts, np.float32)))
    bags.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))  # rows arrive in any order
    table, bias = train(bags)
    yield pa.RecordBatch.from_pydict({"odds": pa.array([table.tobytes()], pa.binary()), "bias": [bias]})


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Learn from labels.quality of rows that are not held out: at most `rows`, in the order of a hash of doc_id.

    Labels other than 0 and 1 and null doc_ids are passed over. A doc_id with several labels or texts counts
    once per pair. Documents without a label are never looked at.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~is_held_out())
    known = known.select("doc_id", F.col("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text")
    bags = sample.mapInArrow(_bags, "label int, buckets binary, counts binary")
    model = bags.repartition(1).mapInArrow(_fit, "odds binary, bias double").first()
    return np.frombuffer(bytes(model.odds), np.float32), model.bias


def scorer(table: np.ndarray, bias: float, name: str = "score") -> Callable:
    """A task that puts the score, as column `name`, in the place of the text, the last column."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            scores = np.empty(batch.num_rows)
            for a, b in slices(offsets):
                total, count = np.zeros(b - a), np.zeros(b - a)
                for which, first in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    sums = np.concatenate([[0], np.cumsum(table[which], dtype=np.float64)])
                    total += sums[first[1:]] - sums[first[:-1]]
                    count += np.diff(first)
                scores[a:b] = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], name]
            )

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`.

    The score comes from the text alone. Null and empty texts have no features and get the score of the bias. A
    null doc_id is not held out. Equal rows get equal scores. Other columns are ignored.
    """
    score = scorer(*fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return rows.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted"),
    )


def _accepting(table: np.ndarray, bias: float, accept: float, at: int) -> Callable:
    """A task that keeps the rows whose text, the column at place `at`, scores at least `accept`."""
    score = scorer(table, bias)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scored in score(iter([batch.select([at])])):
                yield batch.filter(pc.greater_equal(scored.column(0), accept))

    return kept


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `accept`."""
    return docs.mapInArrow(_accepting(*fit(docs, labels), accept, docs.columns.index("text")), docs.schema)
