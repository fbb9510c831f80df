"""Approximate nearest neighbours by NN-descent and greedy graph search, nearness being the inner product.

Equal vectors are one node. Nodes are dealt into buckets by a hash of their id, and every step is a grouping by
bucket: what a node has to tell another is sent to the other's bucket, where numpy works on all its nodes at once.

The graph starts from blocks: nodes in the order of a few random projections, cut every BLOCK nodes, several times over.
NN-descent then improves it. In each round a node gathers the vectors of some neighbours and of some nodes that
have it as a neighbour, compares them with each other, and tells each what it found nearer than its
farthest neighbour. A query starts from its own node and keeps a pool of the nearest nodes seen. In each round the
nearest ones not yet expanded send their neighbours. The search ends when all of the pool is expanded. Graph and search
compare vectors in 8 bits per component; the best of the pool are compared again exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import written
from .words import mix

NEIGHBOURS = 32
REVERSE = 16  # nodes that have a node as a neighbour, among those it sends to a search
BLOCK = 1024
BLOCK_NEIGHBOURS = 16
ORDERS = 8
ROUNDS = 3
SAMPLE = 12  # neighbours of either direction that a node gathers in a round
POOL = 224
EXPAND = 64
SEARCH_ROUNDS = 40  # more than any search took; a search that is still open then keeps what it has
EXACT = 64  # of a pool, compared again
NODES_PER_BUCKET = 1024
SEED = 3

SCHEMA = "bucket long, kind int, open long, data binary"
NODES, LISTS, EDGES, QUERIES = range(4)

EDGE = np.dtype([("to", "<i8"), ("of", "<i8"), ("score", "<f4")])
LIST = np.dtype([("id", "<i8"), ("of", "<i8", (NEIGHBOURS,)), ("score", "<f4", (NEIGHBOURS,))])
ADJACENT = np.dtype([("id", "<i8"), ("of", "<i8", (NEIGHBOURS + REVERSE,))])


def _node(d: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("scale", "<f4"), ("code", "i1", (d,))])


def _message(d: int) -> np.dtype:
    return np.dtype([("to", "<i8"), ("of", "<i8"), ("floor", "<f4"), ("scale", "<f4"), ("code", "i1", (d,))])


def _query(d: int) -> np.dtype:
    return np.dtype(
        [("id", "<i8"), ("scale", "<f4"), ("code", "i1", (d,))]
        + [("of", "<i8", (POOL,)), ("score", "<f4", (POOL,)), ("open", "?", (POOL,))]
    )


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids) % np.uint64(buckets)).astype(np.int64)


def _rows(kind: int, buckets: np.ndarray, records: np.ndarray, open_: int = 0) -> pd.DataFrame:
    """Records packed by bucket."""
    order = np.argsort(buckets, kind="stable")
    numbers, starts = np.unique(buckets[order], return_index=True)
    ends = [*starts[1:].tolist(), len(records)]
    data = [records[order[a:b]].tobytes() for a, b in zip(starts.tolist(), ends)]
    return pd.DataFrame({"bucket": numbers, "kind": kind, "open": open_, "data": data})


def _records(rows: pd.DataFrame, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows["data"][rows["kind"] == kind]), dtype)


def _phase(frames: list[DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    together = frames[0]
    for frame in frames[1:]:
        together = together.unionByName(frame)
    return together.groupBy("bucket").applyInPandas(work, SCHEMA)


def _per_row(frame: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(len(part)):
                yield work(part.iloc[k : k + 1])

    return frame.mapInPandas(each, SCHEMA)


def _firsts(keys: np.ndarray, most: int) -> np.ndarray:
    """Of sorted keys, which are among the first `most` of their run."""
    if not len(keys):
        return np.zeros(0, bool)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys)))) < most


def _best(edges: np.ndarray, most: int) -> np.ndarray:
    """Distinct edges, the best `most` of each target, by target and falling score; equal scores by id."""
    edges = edges[np.lexsort((edges["of"], edges["to"]))]
    new = np.ones(len(edges), bool)
    new[1:] = (edges["to"][1:] != edges["to"][:-1]) | (edges["of"][1:] != edges["of"][:-1])
    edges = edges[new & (edges["to"] != edges["of"])]
    edges = edges[np.lexsort((edges["of"], -edges["score"], edges["to"]))]
    return edges[_firsts(edges["to"], most)]


def _edges(to: np.ndarray, of: np.ndarray, score: np.ndarray | float = 0.0) -> np.ndarray:
    found = np.empty(len(to), EDGE)
    found["to"], found["of"], found["score"] = to, of, score
    return found


def _flat(lists: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """The edges of lists; `chosen` picks columns per row."""
    of, score = lists["of"], lists["score"]
    if chosen is not None:
        of, score = (np.take_along_axis(x, chosen, axis=1) for x in (of, score))
    to = np.repeat(lists["id"], of.shape[1])
    return _edges(to, of.ravel(), score.ravel())[of.ravel() >= 0]


def _lists(edges: np.ndarray) -> np.ndarray:
    """One list per target, filled up with -1; edges come from _best()."""
    ids, starts, counts = np.unique(edges["to"], return_index=True, return_counts=True)
    found = np.zeros(len(ids), LIST)
    found["id"], found["of"], found["score"] = ids, -1, -np.inf
    row = np.repeat(np.arange(len(ids)), counts)
    column = np.arange(len(edges)) - np.repeat(starts, counts)
    found["of"][row, column], found["score"][row, column] = edges["of"], edges["score"]
    return found


def _floats(records: np.ndarray) -> np.ndarray:
    return records["code"].astype(np.float32) * records["scale"][:, None]


# Preparation


def prepared(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(key, vec) with each vector as the bytes of its doubles, and their length.

    Null, empty and zero vectors and those that hold null, NaN or infinity are left out. Shorter vectors get zeros.
    """
    value = F.col(column).cast("array<double>")
    ok = F.col(key).isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    ok = ok & F.exists(value, lambda x: x != 0)
    rows = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("id"), value.alias("v"))
    size = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
            vecs = [np.pad(x, (0, size - len(x))).tobytes() for x in np.split(flat + 0.0, ends[:-1])] if len(column) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(pack, "id long, vec binary"), size


# The graph


def _as_nodes(d: int, buckets: int) -> Callable:
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, d)
            found = np.empty(len(v), _node(d))
            found["id"] = batch.column(0).to_numpy()
            found["scale"] = np.maximum(np.abs(v).max(axis=1) / 127, np.finfo(np.float32).tiny)
            found["code"] = np.clip(np.rint(v / found["scale"][:, None].astype(np.float64)), -127, 127)
            if len(v):
                rows = _rows(NODES, bucket_of(found["id"], buckets), found)
                yield pa.RecordBatch.from_pandas(rows.astype({"kind": "int32"}), preserve_index=False)

    return nodes


def _block_edges(nodes: DataFrame, d: int, buckets: int, count: int, order: int) -> DataFrame:
    """Each node's nearest in a block of nodes that follow each other in one order of random projections."""
    planes = np.random.default_rng([SEED, order]).standard_normal((max(1, count // BLOCK).bit_length(), d)).astype(np.float32)
    dtype = _node(d)

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            records = np.frombuffer(b"".join(part["data"]), dtype)
            sides = _floats(records) @ planes.T
            norm = np.linalg.norm(_floats(records), axis=1) * np.linalg.norm(planes[-1])
            signs = (sides[:, :-1] > 0) @ (2.0 ** np.arange(len(planes) - 1))
            place = signs + (np.clip(sides[:, -1] / norm, -1, 1) + 1) / 2.001
            yield pd.DataFrame({"place": place, "id": records["id"], "node": [x.tobytes() for x in records]})

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, dtype)

        def found(block: np.ndarray) -> pd.DataFrame:
            v = _floats(block)
            scores = v @ v.T
            np.fill_diagonal(scores, -np.inf)
            most = min(BLOCK_NEIGHBOURS, len(block) - 1)
            best = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most else np.zeros((len(block), 0), int)
            edges = _edges(np.repeat(block["id"], most), block["id"][best.ravel()], np.take_along_axis(scores, best, 1).ravel())
            # A node alone still gets a row, so that it has a list.
            edges = edges if most else _edges(block["id"], block["id"])
            return _rows(EDGES, bucket_of(edges["to"], buckets), edges)

        for part in parts:
            held = np.concatenate([held, np.frombuffer(b"".join(part["node"]), dtype)])
            while len(held) >= 2 * BLOCK:
                yield found(held[:BLOCK])
                held = held[BLOCK:]
        for half in np.array_split(held, max(1, -(-len(held) // (BLOCK + BLOCK // 2)))):
            if len(half):
                yield found(half)

    places = nodes.mapInPandas(keyed, "place double, id long, node binary")
    parts = max(1, count // (8 * BLOCK))
    ordered = places.repartitionByRange(parts, "place", "id").sortWithinPartitions("place", "id")
    return ordered.mapInPandas(nearest, SCHEMA)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    before, edges = _records(rows, LISTS, LIST), _records(rows, EDGES, EDGE)
    ids = np.unique(np.concatenate([before["id"], edges["to"]]))
    lists = _lists(_best(np.concatenate([_flat(before), edges]), NEIGHBOURS))
    lone = np.setdiff1d(ids, lists["id"])  # nodes without any neighbour keep an empty list
    empty = np.zeros(len(lone), LIST)
    empty["id"], empty["of"], empty["score"] = lone, -1, -np.inf
    lists = np.concatenate([lists, empty])
    return _rows(LISTS, np.full(len(lists), int(rows["bucket"].iloc[0])), lists)


def _sampled(lists: np.ndarray, round_: int, salt: int) -> np.ndarray:
    """SAMPLE places of each list, drawn anew in each round, the same whenever it is repeated."""
    draws = mix(lists["id"][:, None].astype(np.uint64) * np.uint64(NEIGHBOURS) + np.arange(NEIGHBOURS, dtype=np.uint64) + np.uint64(1000 * round_ + salt))
    return np.argsort(draws, axis=1)[:, :SAMPLE]


def _improved(nodes: DataFrame, lists: DataFrame, d: int, buckets: int, round_: int) -> DataFrame:
    """One round of NN-descent."""

    def request(rows: pd.DataFrame) -> pd.DataFrame:
        own = _records(rows, LISTS, LIST)
        edges = _flat(own, _sampled(own, round_, 1))
        return _rows(EDGES, bucket_of(edges["of"], buckets), _edges(edges["of"], edges["to"]))

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        own, lists = _records(rows, NODES, _node(d)), _records(rows, LISTS, LIST)
        asked = _records(rows, EDGES, EDGE)
        # Of the many that may ask a popular node, those with the least hash get an answer.
        asked = asked[np.lexsort((mix(asked["of"] + round_), asked["to"]))]
        asked = asked[_firsts(asked["to"], 2 * SAMPLE)]
        back = _flat(lists, _sampled(lists, round_, 2))
        sender = np.concatenate([asked["to"], back["to"]])
        target = np.concatenate([asked["of"], back["of"]])
        pairs = np.unique(np.stack([target, sender], axis=1), axis=0)
        pairs = pairs[_firsts(pairs[:, 0], 4 * SAMPLE)]
        own, lists = own[np.argsort(own["id"])], lists[np.argsort(lists["id"])]
        at = np.searchsorted(own["id"], pairs[:, 1])
        found = np.empty(len(pairs), _message(d))
        found["to"], found["of"] = pairs[:, 0], pairs[:, 1]
        found["scale"], found["code"] = own["scale"][at], own["code"][at]
        found["floor"] = lists["score"][np.searchsorted(lists["id"], pairs[:, 1]), -1]
        return _rows(EDGES, bucket_of(found["to"], buckets), found)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        messages = _records(rows, EDGES, _message(d))
        messages = messages[np.lexsort((mix(messages["of"] + round_), messages["to"]))]
        messages = messages[_firsts(messages["to"], 2 * SAMPLE)]
        begins = np.flatnonzero(np.concatenate([[True], messages["to"][1:] != messages["to"][:-1]]))
        found = []
        vectors = _floats(messages)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(messages)]):
            scores = vectors[a:b] @ vectors[a:b].T
            np.fill_diagonal(scores, -np.inf)
            i, j = np.nonzero(scores > messages["floor"][a:b, None])
            found.append(_edges(messages["of"][a + i], messages["of"][a + j], scores[i, j]))
        edges = _best(np.concatenate(found), NEIGHBOURS)
        return _rows(EDGES, bucket_of(edges["to"], buckets), edges)

    messages = _phase([nodes, lists, _per_row(lists, request)], send)
    return _phase([lists, _phase([messages], join)], _merge)


def neighbour_graph(nodes: DataFrame, d: int, buckets: int, count: int) -> DataFrame:
    edges = [_block_edges(nodes, d, buckets, count, order) for order in range(ORDERS)]
    lists = written(_phase(edges, _merge), "lists")
    for round_ in range(ROUNDS):
        lists = written(_improved(nodes, lists, d, buckets, round_), "lists")
    return lists


# The search


def _adjacency(lists: DataFrame, buckets: int) -> DataFrame:
    def back(rows: pd.DataFrame) -> pd.DataFrame:
        edges = _flat(_records(rows, LISTS, LIST))
        return _rows(EDGES, bucket_of(edges["of"], buckets), _edges(edges["of"], edges["to"], edges["score"]))

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        own = _records(rows, LISTS, LIST)
        own = own[np.argsort(own["id"])]
        edges = _best(_records(rows, EDGES, EDGE), REVERSE)
        found = np.empty(len(own), ADJACENT)
        found["id"], found["of"][:, :NEIGHBOURS], found["of"][:, NEIGHBOURS:] = own["id"], own["of"], -1
        ids, starts, counts = np.unique(edges["to"], return_index=True, return_counts=True)
        row = np.repeat(np.searchsorted(own["id"], ids), counts)
        found["of"][row, NEIGHBOURS + np.arange(len(edges)) - np.repeat(starts, counts)] = edges["of"]
        return _rows(LISTS, np.full(len(found), int(rows["bucket"].iloc[0])), found)

    return written(_phase([lists, _per_row(lists, back)], both), "adjacency")


def _open_rows(states: np.ndarray, bucket: int) -> pd.DataFrame:
    return _rows(QUERIES, np.full(len(states), bucket), states, int(states["open"].sum()))


def _to_expand(states: np.ndarray) -> np.ndarray:
    """Which places of each pool are expanded next: the first EXPAND open ones."""
    return states["open"] & (np.cumsum(states["open"], axis=1) <= EXPAND)


def _searched(nodes: DataFrame, lists: DataFrame, queries: DataFrame, d: int, buckets: int) -> DataFrame:
    """Pools of the nearest nodes for each query node (bucket, QUERIES, ids)."""
    adjacency = _adjacency(lists, buckets)

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        wanted = np.unique(_records(rows, QUERIES, np.dtype("<i8")))
        own, near = _records(rows, NODES, _node(d)), _records(rows, LISTS, LIST)
        own, near = own[np.argsort(own["id"])], near[np.argsort(near["id"])]
        at, list_at = np.searchsorted(own["id"], wanted), np.searchsorted(near["id"], wanted)
        states = np.zeros(len(wanted), _query(d))
        for name in ("id", "scale", "code"):
            states[name] = own[name][at]
        states["of"], states["score"] = -1, -np.inf
        most = min(POOL, NEIGHBOURS)
        states["of"][:, :most], states["score"][:, :most] = near["of"][list_at, :most], near["score"][list_at, :most]
        states["open"] = states["of"] >= 0
        return _open_rows(states, int(rows["bucket"].iloc[0]))

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        states = _records(rows, QUERIES, _query(d))
        chosen = _to_expand(states)
        ids = np.repeat(states["id"], chosen.sum(axis=1))
        edges = _edges(states["of"][chosen], ids)
        return _rows(EDGES, bucket_of(edges["to"], buckets), edges)

    def look_up(rows: pd.DataFrame) -> pd.DataFrame:
        own, asked = _records(rows, LISTS, ADJACENT), _records(rows, EDGES, EDGE)
        own = own[np.argsort(own["id"])]
        near = own["of"][np.searchsorted(own["id"], asked["to"])]
        pairs = np.stack([np.repeat(asked["of"], near.shape[1]), near.ravel()], axis=1)
        pairs = np.unique(pairs[(pairs[:, 1] >= 0) & (pairs[:, 0] != pairs[:, 1])], axis=0)
        return _rows(EDGES, bucket_of(pairs[:, 0], buckets), pairs)

    pair = np.dtype([("to", "<i8"), ("of", "<i8")])

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        """Send each query's vector once to every bucket that holds some of its new candidates."""
        states, found = _records(rows, QUERIES, _query(d)), np.unique(_records(rows, EDGES, pair))
        states = states[np.argsort(states["id"])]
        at = np.searchsorted(states["id"], found["to"])
        pool = np.empty(states["of"].size, pair)
        pool["to"], pool["of"] = np.repeat(states["id"], POOL), states["of"].ravel()
        new = ~np.isin(found, pool)
        found, at = found[new], at[new]
        buckets_of = bucket_of(found["of"], buckets)
        order = np.lexsort((found["of"], at, buckets_of))
        found, at, buckets_of = found[order], at[order], buckets_of[order]
        ends = np.flatnonzero(np.concatenate([(at[1:] != at[:-1]) | (buckets_of[1:] != buckets_of[:-1]), [True]])) if len(at) else []
        data, numbers, begin = [], [], 0
        for end in ends:
            state = states[at[begin]]
            head = np.zeros(1, _message(d))
            head["to"], head["of"], head["floor"] = state["id"], end + 1 - begin, state["score"][-1]
            head["scale"], head["code"] = state["scale"], state["code"]
            data.append(head.tobytes() + found["of"][begin : end + 1].tobytes())
            numbers.append(int(buckets_of[begin]))
            begin = end + 1
        packed = pd.DataFrame({"bucket": numbers, "data": data}).groupby("bucket")["data"].apply(b"".join)
        return pd.DataFrame({"bucket": packed.index.to_numpy(np.int64), "kind": EDGES, "open": 0, "data": packed.to_list()})

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        own = _records(rows, NODES, _node(d))
        own = own[np.argsort(own["id"])]
        vectors, size, found = _floats(own), _message(d).itemsize, []
        for data in rows["data"][rows["kind"] == EDGES]:
            at = 0
            while at < len(data):
                head = np.frombuffer(data, _message(d), 1, at)
                ids = np.frombuffer(data, "<i8", int(head["of"][0]), at + size)
                at += size + ids.nbytes
                scores = vectors[np.searchsorted(own["id"], ids)] @ _floats(head)[0]
                near = scores > head["floor"][0]
                found.append(_edges(np.full(int(near.sum()), head["to"][0]), ids[near], scores[near]))
        edges = np.concatenate(found) if found else np.zeros(0, EDGE)
        return _rows(EDGES, bucket_of(edges["to"], buckets), edges)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        states, found = _records(rows, QUERIES, _query(d)), _records(rows, EDGES, EDGE)
        states = states[np.argsort(states["id"])].copy()
        states["open"] &= ~_to_expand(states)
        row = np.concatenate([np.repeat(np.arange(len(states)), POOL), np.searchsorted(states["id"], found["to"])])
        of = np.concatenate([states["of"].ravel(), found["of"]])
        scores = np.concatenate([states["score"].ravel(), found["score"]])
        open_ = np.concatenate([states["open"].ravel(), np.ones(len(found), bool)])
        order = np.lexsort((of, -scores, row))
        order = order[_firsts(row[order], POOL)]
        shape = (len(states), POOL)
        states["of"], states["score"], states["open"] = (x[order].reshape(shape) for x in (of, scores, open_))
        return _open_rows(states, int(rows["bucket"].iloc[0]))

    states = written(_phase([nodes, lists, queries], start), "searches")
    for _ in range(SEARCH_ROUNDS):
        if not states.agg(F.sum("open")).first()[0]:
            break
        near = _phase([adjacency, _per_row(states, expand)], look_up)
        scores = _phase([nodes, _phase([states, near], ask)], score)
        states = written(_phase([states, scores], merge), "searches")
    return states


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found for each row of `queries` among the other rows of `vectors`.

    Nearness is the largest inner product, in doubles; ties go to the smaller id. `queries` are rows of `vectors`.
    Null, empty and zero vectors, those that hold null, NaN or infinity, and rows without an id take no part; shorter
    vectors count as filled up with zeros. Rows with one id and one vector count once. Other columns are ignored;
    an empty table gives no rows.
    """
    rows, d = prepared(vectors, key, column)
    rows = written(rows.distinct(), "vectors")
    # A node is named by its least id; of equal vectors only the k + 1 least ids can be among the nearest.
    by_vector = Window.partitionBy("vec").orderBy("id")
    members = rows.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    members = members.withColumn("node", F.min("id").over(Window.partitionBy("vec")))
    members = written(members, "members")
    classes = members.where("place = 1").select("id", "vec")
    count = classes.count()
    buckets = max(1, count // NODES_PER_BUCKET)
    nodes = written(classes.mapInArrow(_as_nodes(d, buckets), SCHEMA), "nodes")
    asked = queries.select(F.col(key).cast("long").alias("id")).distinct().join(rows, "id")
    asked = written(asked.join(classes.withColumnRenamed("id", "node"), "vec").select("id", "vec", "node"), "asked")

    def wanted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["node"].to_numpy(np.int64)
            if len(ids):
                yield _rows(QUERIES, bucket_of(ids, buckets), ids)

    def pools(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            states = _records(part, QUERIES, _query(d))
            of = np.concatenate([states["id"][:, None], states["of"][:, :EXACT]], axis=1)  # a query's own copies are near, too
            found = pd.DataFrame({"node": np.repeat(states["id"], of.shape[1]), "near": of.ravel()})
            yield found[found["near"] >= 0]

    lists = neighbour_graph(nodes, d, buckets, count)
    states = _searched(nodes, lists, asked.select("node").distinct().mapInPandas(wanted, SCHEMA), d, buckets)
    pairs = states.mapInPandas(pools, "node long, near long")
    vecs = lambda name, to: classes.select(F.col("id").alias(name), F.col("vec").alias(to))
    pairs = pairs.join(vecs("near", "near_vec"), "near").join(vecs("node", "vec"), "node")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(j).to_pylist()), np.float64).reshape(-1, d) for j in (2, 3))
            scores = pa.array((x * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["node", "near", "score"])

    scored = pairs.select("node", "near", "vec", "near_vec").mapInArrow(exact, "node long, near long, score double")
    # Equal queries share a pool: its best k + 1 rows serve all of them, each without itself.
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    near = scored.join(members.select(F.col("node").alias("near"), F.col("id").alias("vec_id")), "near")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    found = asked.select(F.col("id").alias("query_id"), "node").join(near.select("node", "vec_id", "score"), "node")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
