"""Ranked lexical search: MaxScore over blocks of documents, with bounds for pairs of terms.

The index has a row for each block of documents and term: where the term occurs and how often. For a set of queries,
each block's lists become impacts (what an occurrence adds to a score), and lists of pairs of terms join them:
for each strip of STRIP documents in which both terms of a pair occur in one document, the highest impact that the two have
together. A query adds up bounds of pairs rather than of single terms, leaves out strips whose bound stays
below what its 50th best document has so far, and looks up terms that cannot lift a document above that only for documents
which other terms have brought up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .words import mix, run_hashes, text_bytes

TOP = 50
# Documents of a block, and of a strip inside it, at most; terms of a block, with repeats, about.
BLOCK_DOCS = 4096
STRIP = 128
BLOCK_TERMS = 1 << 20
# Bytes of text that are split into terms at once.
SLICE = 1 << 18
# Queries of one pass, and their terms together; more queries take more passes.
QUERIES_PER_PASS = 4096
TERMS_PER_PASS = 1 << 18
# Every so many blocks are searched first; the others start from the scores found there.
FIRST_BLOCKS = 16
# Parts that a query's hits are ranked in before they are ranked together.
PARTS = 64

FOUND = "item long, doc_id long, score long"


class Terms(NamedTuple):
    """Terms of consecutive texts: for each occurrence the text and the term's hash."""

    text: np.ndarray
    hashes: np.ndarray


# A term is a run of digits, A-Z, a-z and characters from U+0080 on, which have bytes from 0x80 on.
def _tables() -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return inside, mix(lower + np.uint64(1))


_INSIDE, _VALUES = _tables()


def cut_slices(data: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `size` bytes that end where no term runs on; a longer term stays whole."""
    first, n = 0, len(data)
    while first < n:
        last = min(n, first + size)
        while last < n and _INSIDE[data[last - 1]] and _INSIDE[data[last]]:
            stop = np.flatnonzero(~_INSIDE[data[last : last + size]])
            last = last + int(stop[0]) if len(stop) else min(n, last + size)
        yield first, last
        first = last


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[Terms]:
    """The terms of all texts, slice by slice; a text's terms may come in several slices."""
    ends_of_texts = offsets[1:-1]
    for a, b in cut_slices(data):
        part = data[a:b]
        inside = _INSIDE[part]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = ends_of_texts[(ends_of_texts > a) & (ends_of_texts < b)] - a
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        hashes = run_hashes(_VALUES[part], starts, ends).view(np.int64)
        yield Terms(np.searchsorted(offsets, starts + a, side="right") - 1, hashes)


class _Block:
    """Documents that gather until they make a block of the index."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n_terms = 0

    def add(self, docs: np.ndarray, terms: np.ndarray) -> None:
        order = np.lexsort((docs, terms))
        docs, terms = docs[order], terms[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (terms[1:] != terms[:-1])
        first = np.flatnonzero(new)
        self.docs.append(docs[first])
        self.terms.append(terms[first])
        self.counts.append(np.diff(np.append(first, len(docs))))
        self.n_terms += len(docs)

    def rows(self, block: int) -> pa.RecordBatch:
        docs, terms, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.terms, self.counts))
        order = np.lexsort((docs, terms))
        docs, terms, counts = docs[order], terms[order], counts[order]
        # A text's occurrences of a term may have come in several slices.
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (terms[1:] != terms[:-1])
        first = np.flatnonzero(new)
        docs, terms = docs[first], terms[first]
        counts = np.add.reduceat(counts, first) if len(first) else counts
        begins = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        ends = pa.array(np.append(begins, len(docs)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (docs, counts)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), block)), pa.array(terms[begins]), *lists], names=["block", "term", "docs", "counts"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(index rows, documents) of each block; `block` is given with the rows' number."""
    from pyspark import TaskContext

    base, number = TaskContext.get().partitionId() << 32, 0
    block, ids, sizes = _Block(), [], []

    def finished() -> tuple[pa.RecordBatch, pa.RecordBatch]:
        at, own = base + number, pa.concat_arrays(ids)
        missing = np.flatnonzero(own.is_null().to_numpy(zero_copy_only=False))
        lists = [own.fill_null(0), pa.array(missing.astype(np.int32)), pa.array(np.concatenate(sizes))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return block.rows(at), pa.RecordBatch.from_arrays([pa.array([at]), *lists], names=["block", *_DOCS])

    held = 0
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            room = offsets[first] + 8 * (BLOCK_TERMS - block.n_terms)  # terms of eight bytes on average, or fewer
            last = int(np.searchsorted(offsets, room, side="right")) - 1
            last = min(max(last, first + 1), first + BLOCK_DOCS - held, batch.num_rows)
            own = offsets[first : last + 1] - offsets[first]
            total = np.zeros(last - first, np.int64)
            for part in terms_of(data[offsets[first] : offsets[last]], own):
                block.add(part.text + held, part.hashes)
                total += np.bincount(part.text, minlength=len(total))
            ids.append(batch.column(0).slice(first, last - first))
            sizes.append(total)
            held, first = held + last - first, last
            if held == BLOCK_DOCS or block.n_terms >= BLOCK_TERMS:
                yield finished()
                block, ids, sizes, held, number = _Block(), [], [], 0, number + 1
    if held:
        yield finished()


_LISTS, _DOCS = ("term", "docs", "counts"), ("doc_ids", "without_id", "sizes")
_INDEX = pa.schema(
    [("block", pa.int64()), ("term", pa.int64()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    + [("doc_ids", pa.list_(pa.int64())), ("without_id", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64()))]
)
INDEX = "block long, term long, docs array<int>, counts array<int>, doc_ids array<long>, without_id array<int>, sizes array<long>"


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lists, docs in _blocks(batches):
        for rows in (lists, docs):
            columns = {name: rows.column(name) for name in rows.schema.names}
            yield pa.RecordBatch.from_arrays([columns.get(x.name, pa.nulls(rows.num_rows, x.type)) for x in _INDEX], schema=_INDEX)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of `docs` (doc_id, text), written once: a row per block and term, and one per block for its documents.

    block, term (a 64-bit hash), docs (numbers inside the block, ascending), counts; or block, doc_ids, without_id (numbers
    of those whose id is null), sizes (terms of each document, repeats included). A null text has no terms. Null and equal doc_ids are rows of their own. Other
    columns are ignored; an empty table gives an empty index. Whole texts are indexed, slice by slice.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_index_rows, INDEX)
    return written(rows, "lexical-index")


def query_terms(text: str | None) -> np.ndarray:
    """Hashes of the distinct terms of a query."""
    raw = (text or "").encode()
    if not raw:
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    return np.unique(np.concatenate([x.hashes for x in terms_of(data, np.array([0, len(data)]))]))


class Query(NamedTuple):
    """Term numbers by falling weight, and the pairs that two neighbours of this order make (number of pair or -1)."""

    item: int
    terms: np.ndarray
    pairs: np.ndarray


class Pass(NamedTuple):
    """A bounded set of queries with what they need of the whole table's counts."""

    queries: list[Query]
    terms: np.ndarray  # hashes, ascending
    weights: np.ndarray
    pairs: np.ndarray  # (n, 2) term numbers
    n_docs: int
    n_terms: int


def weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def impacts(weights: int | np.ndarray, counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What `counts` occurrences of a term add to the scores of documents of `sizes` terms."""
    if len(sizes) and 50 * n_docs * int(sizes.max()) >= 1 << 63:
        scaled = np.array([50 * n_docs * int(n) // n_terms for n in sizes], np.int64)
    else:
        scaled = 50 * n_docs * sizes.astype(np.int64) // max(n_terms, 1)
    counts = counts.astype(np.int64)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * (50 + scaled)))


def _pass(texts: list[tuple[int, np.ndarray]], holders: dict[int, int], n_docs: int, n_terms: int) -> Pass:
    terms = np.unique(np.concatenate([t for _, t in texts])) if texts else np.zeros(0, np.int64)
    weights = np.array([weight(n_docs, holders.get(t, 0)) if t in holders else 0 for t in terms.tolist()], np.int64)
    numbers: dict[tuple[int, int], int] = {}
    queries = []
    for item, own in texts:
        at = np.searchsorted(terms, own)
        at = at[weights[at] > 0]
        at = at[np.argsort(-weights[at], kind="stable")]
        pairs = [numbers.setdefault((min(a, b), max(a, b)), len(numbers)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        queries.append(Query(item, at, np.array(pairs, np.int64)))
    return Pass(queries, terms, weights, np.array(list(numbers), np.int64).reshape(-1, 2), n_docs, n_terms)


IMPACTS = "block long, a int, b int, at array<int>, impact array<long>"


def _impact_rows(found: Pass):
    """A group function: a block's index rows to lists of impacts, of single terms (b is null) and of pairs."""

    def lists(rows: pd.DataFrame, docs_of: pd.DataFrame) -> pd.DataFrame:
        out, own = [], {}
        if len(rows):
            block, sizes = rows["block"].iloc[0], np.asarray(docs_of["sizes"].iloc[0], np.int64)
            numbers = np.searchsorted(found.terms, rows["term"].to_numpy())
            for number, docs, counts in zip(numbers.tolist(), rows["docs"], rows["counts"]):
                docs = np.asarray(docs)
                own[number] = (docs, impacts(int(found.weights[number]), np.asarray(counts), sizes[docs], found.n_docs, found.n_terms))
                out.append((block, number, None, *own[number]))
            dense, last = np.zeros(len(sizes), np.int64), None
            for a, b in sorted(p for p in map(tuple, found.pairs.tolist()) if p[0] in own and p[1] in own):
                if a != last:
                    dense[:] = 0
                    dense[own[a][0]], last = own[a][1], a
                docs, values = own[b]
                both = dense[docs] > 0
                if both.any():
                    docs = docs[both]
                    strips = docs // STRIP
                    first = np.flatnonzero(np.append(True, strips[1:] != strips[:-1]))
                    out.append((block, a, b, strips[first], np.maximum.reduceat(values[both] + dense[docs], first)))
        return pd.DataFrame(out, columns=["block", "a", "b", "at", "impact"]).astype({"block": "int64", "a": "int32", "b": "Int32"})

    return lists


class _Lists(NamedTuple):
    """A block's impacts, made ready for queries."""

    place: np.ndarray  # of each document by ascending doc_id, null first
    single: dict[int, tuple[np.ndarray, np.ndarray]]
    tops: dict[int, np.ndarray]  # by strip
    pairs: dict[tuple[int, int], np.ndarray]  # joint bounds by strip


def _ready(doc_ids: np.ndarray, without_id: np.ndarray, lists: pd.DataFrame) -> _Lists:
    named = np.ones(len(doc_ids), bool)
    named[without_id] = False
    place = np.empty(len(doc_ids), np.int64)
    place[np.lexsort((doc_ids, named))] = np.arange(len(doc_ids))
    strips = -(-len(doc_ids) // STRIP)
    single, tops, joint = {}, {}, {}
    for a, b, at, impact in zip(lists["a"], lists["b"], lists["at"], lists["impact"]):
        at, impact = np.asarray(at), np.asarray(impact)
        bound = np.zeros(strips, np.int64)
        if pd.isna(b):
            of = at // STRIP
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            bound[of[first]] = np.maximum.reduceat(impact, first)
            single[int(a)], tops[int(a)] = (at, impact), bound
        else:
            bound[at] = impact
            joint[int(a), int(b)] = bound
    # A document with only one of the two terms has that one's impact at most.
    pairs = {(a, b): np.maximum(bound, np.maximum(tops[a], tops[b])) for (a, b), bound in joint.items()}
    return _Lists(place, single, tops, pairs)


def _units(query: Query, lists: _Lists, start: int) -> tuple[list[tuple[int, ...]], list[np.ndarray]]:
    """Terms in pairs (from place `start` on) or alone, with their bounds by strip."""
    units, bounds, at, terms = [], [], 0, query.terms.tolist()
    while at < len(terms):
        size = 2 if at >= start and at + 1 < len(terms) else 1
        unit = tuple(t for t in terms[at : at + size] if t in lists.single)
        at += size
        if len(unit) == 2:
            key = (min(unit), max(unit))
            # Two terms that share no document of the block never add up.
            bounds.append(lists.pairs[key] if key in lists.pairs else np.maximum(lists.tops[unit[0]], lists.tops[unit[1]]))
        elif unit:
            bounds.append(lists.tops[unit[0]])
        else:
            continue
        units.append(unit)
    return units, bounds


def search_block(query: Query, lists: _Lists, least: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in the block, scores) of the `top` best documents with a score of `least` or more, ties by doc_id."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = max(least, 1)
    ways = [_units(query, lists, start) for start in (0, 1)]  # the two ways to pair neighbours
    if not ways[0][0]:
        return none
    totals = [np.sum(bounds, axis=0) for _, bounds in ways]
    units, bounds = ways[int(totals[1].max() < totals[0].max())]
    total = np.minimum(*totals)
    live = total >= least
    if not live.any():
        return none
    highest = np.array([int(x[live].max()) for x in bounds])
    order = np.argsort(highest, kind="stable")
    rest = np.cumsum(highest[order])  # what the unit and all lower ones can add up to
    n_weak = int(np.searchsorted(rest, least, side="left"))
    scores = np.zeros(len(lists.place), np.int64)
    alive = np.zeros(len(lists.place), bool)
    for u in order[n_weak:].tolist():
        for term in units[u]:
            docs, values = lists.single[term]
            scores[docs] += values
            alive[docs] = True
    docs = np.flatnonzero(alive & np.repeat(live, STRIP)[: len(alive)])
    for place in range(n_weak - 1, -1, -1):
        docs = docs[scores[docs] + rest[place] >= least]
        if not len(docs):
            return none
        for term in units[order[place]]:
            own, values = lists.single[term]
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            scores[docs] += np.where(own[at] == docs, values[at], 0)
    docs = docs[scores[docs] >= least]
    docs = docs[np.lexsort((lists.place[docs], -scores[docs]))[:top]]
    return docs, scores[docs]


def _search_rows(found: Pass, least: dict[int, int], top: int):
    """A group function: a block's impacts and documents to the hits of all queries."""

    def hits(lists: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        items, at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids = pd.array(np.zeros(0), dtype="Int64")
        if len(lists) and len(docs):
            without = np.asarray(docs["without_id"].iloc[0], np.int64)
            own = np.asarray(docs["doc_ids"].iloc[0], np.int64)
            ready = _ready(own, without, lists)
            ids = pd.array(own, dtype="Int64")
            ids[without] = pd.NA
            for query in found.queries:
                best, values = search_block(query, ready, least.get(query.item, 1), top)
                items.append(np.full(len(best), query.item))
                at.append(best)
                scores.append(values)
        return pd.DataFrame({"item": np.concatenate(items), "doc_id": ids[np.concatenate(at)], "score": np.concatenate(scores)})

    return hits


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    """item, rank, doc_id, score of the `top` best hits of each query; ranked in parts first."""
    order = [F.col("score").desc(), F.col("doc_id")]
    parts = hits.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    inside = Window.partitionBy("item", "_part").orderBy(*order)
    parts = parts.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top)
    whole = Window.partitionBy("item").orderBy(*order)
    return parts.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def _one_pass(index: DataFrame, texts: list[tuple[int, np.ndarray]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    spark = index.sparkSession
    wanted = np.unique(np.concatenate([t for _, t in texts]))
    terms = F.broadcast(spark.createDataFrame([(t,) for t in wanted.tolist()], "term long"))
    lists = index.where("term is not null").join(terms, "term", "left_semi").select("block", *_LISTS)
    holders = {x.term: x.n for x in lists.groupBy("term").agg(F.sum(F.size("docs")).alias("n")).collect()}
    found = _pass(texts, holders, n_docs, n_terms)
    docs = index.where("term is null").select(F.col("block").alias("of_block"), *_DOCS)
    grouped = lists.groupBy("block").cogroup(docs.select("of_block", "sizes").groupBy("of_block"))
    ready = written(grouped.applyInPandas(_impact_rows(found), IMPACTS), "impacts")

    def search(first: bool, least: dict[int, int]) -> DataFrame:
        among = lambda block: (F.pmod(F.xxhash64(block), F.lit(FIRST_BLOCKS)) == 0) == F.lit(first)
        rows = docs.where(among("of_block")).drop("sizes").groupBy("of_block")
        hits = ready.where(among("block")).groupBy("block").cogroup(rows).applyInPandas(_search_rows(found, least, top), FOUND)
        return written(_ranked(hits, top), "hits").drop("rank")

    early = search(True, {})
    full = early.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == top)
    least = {x.item: x.least for x in full.collect()}
    return _ranked(early.unionByName(search(False, least)), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents with the highest scores above 0 for each row of `items`.

    docs: doc_id, text; items: item_id, text. Equal scores come by ascending doc_id, a null one first. A null text
    has no terms, and a query without terms, or whose terms no document holds, has no rows. Rows of `items` with equal
    item_id are queries of their own. Equal documents each count, and each have a rank. Other columns are ignored; an
    empty table on either side gives no rows. Terms are compared by 64-bit hashes.

    Queries are taken in passes of QUERIES_PER_PASS; each one's terms, weights and 50th score are all that goes to
    every task.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    every = F.filter("sizes", lambda n: n > 0)
    counts = index.where("term is null").select(F.sum(F.size(every)), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    n_docs, n_terms = (int(x or 0) for x in counts)
    queries = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "queries")
    found = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    held: list[tuple[int, np.ndarray]] = []

    def flushed() -> DataFrame:
        hits = _one_pass(index, held, n_docs, n_terms, top)
        return found.unionByName(hits)

    for row in queries.select("item", "text").toLocalIterator():
        terms = query_terms(row.text)
        if not len(terms) or not n_docs:
            continue
        if held and (len(held) == QUERIES_PER_PASS or sum(len(t) for _, t in held) + len(terms) > TERMS_PER_PASS):
            found, held = flushed(), []
        held.append((row.item, terms))
    if held:
        found = flushed()
    return found.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
