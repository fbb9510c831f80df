"""Near-duplicate passages by compact windows of token min-hashes.

Under a hash function, each run of a document's tokens (word shingles) has a least token. All runs with the same
least token at the same place form one compact window: the longest run around it in which it is the least. These
windows are the nodes of the Cartesian tree of the hashes, and only nodes of at least a passage's length matter, so a
document of n tokens has about 2n / length of them. Two passages share a least token as often as their
Jaccard similarity says; equal passages always do, under every function.

Windows with equal least tokens are brought together, an interval join finds the stretches of a pair of documents that
enough functions agree on, and each stretch is verified on the tokens themselves.

Of the windows under one key, only the least document's meets the others. Where it turns out not to hold the passage of
another, all windows of the key get finer keys from the tokens around the least one, and meet again under these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written
from .words import mix, run_hashes, shingles_of, slices, text_bytes, words_of

SHINGLE = 5
WORDS = 50  # of a passage, at least
SIMILARITY = 0.75
FUNCTIONS = 4
ENOUGH = 2  # functions that must agree on a stretch
SLACK = 8  # tokens by which insertions may move a passage
# Windows and collisions per task that compares them.
PER_BUCKET = 1 << 16
# Windows that a task gathers before it hands them on.
PER_FLUSH = 1 << 17
# Stretches are broadcast up to so many (two places each), and joined by a shuffle of the texts beyond.
BROADCAST_STRETCHES = 1 << 20
# Stretches of one document that are cut out in one go.
STRETCHES_PER_ROW = 1000

WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("left", "<i4"), ("at", "<i4"), ("right", "<i4")])
# A window under a finer key; `open` if it still looks for a document that holds its passage.
FINER = np.dtype([*WINDOW.descr, ("open", "?")])
# The low bits of a key say which function it is of.
_FUNCTION_BITS = np.uint64(7)
# Least tokens of either side of a window's own that become a finer key each.
SKETCHES = 4


def least_places(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Places that hold the least value (the first of equals) of some run of `size` values in one text, ascending.

    Prefix minima and suffix minima of blocks of `size` values give the least of every run.
    """
    n = len(values)
    if n < size:
        return np.zeros(0, np.int64)
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, size)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[: n - size + 1], forward[size - 1 : n])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    least = least[starts]
    # A run has another least place than the one before if a lesser value entered on its right, or if the least left.
    follows = np.concatenate([[False], starts[1:] == starts[:-1] + 1])
    before = np.concatenate([least[:1], least[:-1]])
    entered = follows & (least < before)
    left = ~follows | (values[np.maximum(starts - 1, 0)] == before)
    found = np.zeros(n, bool)
    found[starts[entered] + size - 1] = True
    starts, least = starts[left & ~entered], least[left & ~entered]
    for k in range(size):
        hit = values[starts + k] == least
        found[starts[hit] + k] = True
        starts, least = starts[~hit], least[~hit]
    return np.flatnonzero(found)


def _bounding(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the last one before it that is not greater and the next lesser one, of the same text; -1 and n if none.

    What lies beyond a greater neighbour's own bound is all that is left to look at, so all values step from bound to bound at once.
    """
    n = len(values)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    new = np.append(True, text[1:] != text[:-1])[:n]
    before[new] = -1
    after[np.append(new[1:], True)[:n]] = n
    todo = np.flatnonzero(~new)
    while len(todo := todo[values[before[todo]] > values[todo]]):
        before[todo] = before[before[todo]]
        todo = todo[before[todo] >= 0]
    todo = np.flatnonzero(after < n)
    while len(todo := todo[values[after[todo]] >= values[todo]]):
        after[todo] = after[after[todo]]
        todo = todo[after[todo] < n]
    return before, after


def compact_windows(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(place, left, right) of all compact windows of at least `size` values; left and right are included.

    A place that bounds such a window bounds a longer one itself, so the tree is built over the places alone.
    """
    places = least_places(values, first, size)
    text = np.searchsorted(first, places, side="right") - 1
    held = values[places]
    before, after = _bounding(held, text)
    left, right = first[text], first[text + 1] - 1
    inner = before >= 0
    left[inner] = places[before[inner]] + 1
    inner = after < len(places)
    right[inner] = places[after[inner]] - 1
    enough = right - left + 1 >= size
    return places[enough], left[enough], right[enough]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a, b in slices(offsets):
        found = shingles_of(words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), SHINGLE)
        yield a, found.hashes, found.first


def _packed(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows (bucket, windows); buckets go by the keys' highest bits.

    Windows lie there byte by byte, the first bytes of all of them first, as the many zeros are then together and cost nothing.
    """
    rows = np.concatenate(held)
    bucket = (rows["key"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rows), np.int64)
    order = np.argsort(bucket, kind="stable")
    numbers, starts = np.unique(bucket[order], return_index=True)
    ends = [*starts[1:].tolist(), len(rows)]
    planes = np.ascontiguousarray(rows[order].view(np.uint8).reshape(len(rows), rows.itemsize).T)
    blobs = [planes[:, a:b].tobytes() for a, b in zip(starts.tolist(), ends)]
    return pa.RecordBatch.from_pydict({"bucket": numbers, "windows": pa.array(blobs, pa.binary())})


def _unpacked(blobs: pd.Series, kind: np.dtype) -> np.ndarray:
    planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1) for x in blobs], axis=1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _windows(size: int, functions: int, bits: int) -> Callable:
    """Rows (bucket, windows): packed windows of the task's documents."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, hashes, first in _tokens(*text_bytes(batch.column(1))):
                # Each function has the texts once more, behind those of the function before.
                values = np.concatenate([mix(hashes + np.uint64(101 + j)) for j in range(functions)])
                firsts = np.append((first[:-1] + len(hashes) * np.arange(functions)[:, None]).ravel(), len(values))
                at, left, right = compact_windows(values, firsts, size)
                text = np.searchsorted(firsts, at, side="right") - 1
                function, of = np.divmod(text, len(first) - 1)
                found = np.empty(len(at), WINDOW)
                found["key"] = (values[at] & ~_FUNCTION_BITS) | function.astype(np.uint64)
                found["doc"] = ids[row + of]
                for name, x in (("left", left), ("at", at), ("right", right)):
                    found[name] = x - firsts[text]
                held.append(found)
                if sum(map(len, held)) > PER_FLUSH:
                    yield _packed(held, bits)
                    held = []
        if held:
            yield _packed(held, bits)

    return windows


COLLISIONS = "key long, a long, a_left int, a_at int, a_right int, b long, b_left int, b_at int, b_right int"


def _collide(rows: pd.DataFrame) -> pd.DataFrame:
    """For each key in several documents: the first window of the least document (a) with each window (b), itself too."""
    windows = _unpacked(rows["windows"], WINDOW)
    windows = windows[np.lexsort((windows["at"], windows["doc"], windows["key"]))]
    keys = windows["key"]
    begins = np.concatenate([[True], keys[1:] != keys[:-1]])
    of = np.cumsum(begins) - 1
    least = windows[begins][of]
    several = np.bincount(of, least["doc"] != windows["doc"])[of] > 0
    found = {"key": windows["key"][several].astype(np.int64)}
    for name, side in (("a", least[several]), ("b", windows[several])):
        found |= {name: side["doc"], f"{name}_left": side["left"], f"{name}_at": side["at"], f"{name}_right": side["right"]}
    return pd.DataFrame(found)


def _fits(collisions: DataFrame, size: int) -> DataFrame:
    """a, b, function, shift, begin, end of the collisions of two documents that leave room for a passage.

    begin and end (included) bound the stretch of document a around the common token that fits both
    windows; document b has it `shift` tokens later.
    """
    before = F.least(F.expr("a_at - a_left"), F.expr("b_at - b_left"))
    after = F.least(F.expr("a_right - a_at"), F.expr("b_right - b_at"))
    function = F.col("key").bitwiseAND(F.lit(int(_FUNCTION_BITS))).cast("int")
    return collisions.where((F.col("a") != F.col("b")) & (before + after + 1 >= size)).select(
        "a", "b", function.alias("function"), F.expr("b_at - a_at").alias("shift"),
        (F.col("a_at") - before).alias("begin"), (F.col("a_at") + after).alias("end"),
    )


STRETCHES = "a long, b long, a_begin int, a_end int, b_begin int, b_end int"


def _agreed(size: int, enough: int) -> Callable:
    def agreed(rows: pd.DataFrame) -> pd.DataFrame:
        """The interval join: stretches of a pair that windows of enough functions cover.

        Collisions of a pair whose shifts lie close together belong to one alignment. Each function's
        stretches are merged, and a sweep counts the functions at every place. Ends are exclusive.
        """
        rows = rows.sort_values(["a", "b", "shift"], ignore_index=True)
        a, b, shift, function = (rows[c].to_numpy() for c in ("a", "b", "shift", "function"))
        new = np.ones(len(rows), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(shift) > SLACK)
        aligned = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        low, high = shift[heads], shift[np.append(heads[1:], len(rows)) - 1]

        order = np.lexsort((rows["begin"], function, aligned))
        unit = (aligned * (int(_FUNCTION_BITS) + 1) + function)[order]
        wide = np.int64(rows["end"].max() + 2)
        begin, end = rows["begin"].to_numpy()[order] + unit * wide, rows["end"].to_numpy()[order] + 1 + unit * wide
        reach = np.maximum.accumulate(end)
        opens = np.concatenate([[True], begin[1:] > reach[:-1]])
        closes = np.concatenate([opens[1:], [True]])
        units = unit[opens] // (int(_FUNCTION_BITS) + 1)
        places = np.concatenate([begin[opens] % wide, reach[closes] - unit[closes] * wide])
        units = np.concatenate([units, units])
        steps = np.repeat([1, -1], len(places) // 2)
        order = np.lexsort((-steps, places, units))
        places, units, steps = places[order], units[order], steps[order]
        count = np.cumsum(steps)
        first, last = (count == enough) & (steps > 0), (count == enough - 1) & (steps < 0)
        begin, end, units = places[first], places[last], units[first]
        keep = end - begin >= size
        begin, end, units = begin[keep], end[keep], units[keep]
        head = heads[units]
        found = {"a": a[head], "b": b[head], "a_begin": begin, "a_end": end}
        return pd.DataFrame(found | {"b_begin": np.maximum(begin + low[units], 0), "b_end": end + high[units]})

    return agreed


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, begin, end, tokens) for the stretches (a list of begins, one of ends) of each text."""
    for batch in batches:
        ids, begins, ends = (batch.column(k).to_pylist() for k in (0, 2, 3))
        for row, hashes, first in _tokens(*text_bytes(batch.column(1))):
            rows = []
            for k in range(len(first) - 1):
                tokens = hashes[first[k] : first[k + 1]]
                for begin, end in zip(begins[row + k], ends[row + k]):
                    rows.append((ids[row + k], begin, end, tokens[begin:end].tobytes()))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "begin", "end", "tokens"])


# What a miss takes off the score of a run, in which a hit counts 1. With the first, both runs of a pair that
# just reach SIMILARITY score 0; the others find what is closer inside a run that fails.
PENALTIES = (2 * SIMILARITY / (1 - SIMILARITY), 25.0, 1e9)


def _best_run(hits: np.ndarray, penalty: float) -> tuple[int, int]:
    sums = np.concatenate([[0], np.cumsum(np.where(hits, 1.0, -penalty))])
    least = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - least))
    begin = int(np.flatnonzero(sums[: end + 1] == least[end])[-1])
    return begin, end


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y."""
    if not len(y):
        return np.zeros(len(x), bool)
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def verified(x: np.ndarray, y: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int, float]]:
    """Passages that the tokens x and y share: (begin, end) in x, (begin, end) in y, exact Jaccard similarity."""
    hits = _held(x, y)
    before = np.append(0, np.cumsum(hits))
    # A run of `size` tokens with a score above 0 has more hits than these, the more so under higher penalties.
    too_few = size * PENALTIES[0] / (1 + PENALTIES[0])
    todo = [(0, len(x), 0)]
    while todo:
        a, b, level = todo.pop()
        if before[b] - before[a] <= too_few:
            continue
        begin, end = _best_run(hits[a:b], PENALTIES[level])
        begin, end = a + begin, a + end
        if end - begin < size:
            if level + 1 < len(PENALTIES):
                todo.append((a, b, level + 1))
            continue
        todo += [(a, begin, level), (end, b, level)]
        low, high = _best_run(_held(y, x[begin:end]), PENALTIES[level])
        similarity = 0.0
        if high - low >= size:
            mine, theirs = np.unique(x[begin:end]), np.unique(y[low:high])
            shared = len(np.intersect1d(mine, theirs, assume_unique=True))
            similarity = shared / (len(mine) + len(theirs) - shared)
        if similarity >= SIMILARITY:
            yield begin, end, low, high, similarity
        elif level + 1 < len(PENALTIES):
            todo.append((begin, end, level + 1))


PASSAGES = (
    "doc_id long, start_word int, end_word int, first_doc_id long, first_start_word int, first_end_word int, similarity double"
)


def _verify(size: int) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PASSAGES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            a, b, a_begin, b_begin = (batch.column(k).to_pylist() for k in range(4))
            left, right = batch.column(4), batch.column(5)
            rows = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(side[k].as_buffer(), np.uint64) for side in (left, right))
                for begin, end, low, high, similarity in verified(x, y, size):
                    here = (b[k], b_begin[k] + low, b_begin[k] + high + SHINGLE - 1)
                    there = (a[k], a_begin[k] + begin, a_begin[k] + end + SHINGLE - 1)
                    rows.append((*here, *there, similarity))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return verify


def _stretch_tokens(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """doc, begin, end, tokens for each distinct stretch (doc, begin, end), as a written table."""
    stretches = written(stretches.distinct(), "stretches")
    parts = stretches.groupBy("doc").agg(F.ceil(F.count("*") / STRETCHES_PER_ROW).alias("parts"))
    part = F.pmod(F.xxhash64("begin", "end"), F.col("parts"))
    lists = stretches.join(parts, "doc").groupBy("doc", part.alias("part"))
    lists = lists.agg(F.collect_list(F.struct("begin", "end")).alias("of")).select(F.col("doc").alias("doc_id"), "of.begin", "of.end")
    if stretches.count() <= BROADCAST_STRETCHES:
        lists = F.broadcast(lists)
    cut = docs.join(lists, "doc_id").select("doc_id", "text", "begin", "end")
    tokens = written(cut.mapInArrow(_cut, "doc long, begin int, end int, tokens binary"), "tokens")
    discard(stretches)
    return tokens


def _agreements(fits: DataFrame, size: int, enough: int) -> DataFrame:
    """The stretches of a written table of fits, which is deleted."""
    of_pair = F.pmod(F.xxhash64("a", "b"), F.lit(fits.count() // PER_BUCKET + 1))
    agreed = written(fits.groupBy(of_pair).applyInPandas(_agreed(size, enough), STRETCHES), "agreed")
    discard(fits)
    return agreed


def _verified(docs: DataFrame, stretches: DataFrame, size: int) -> DataFrame:
    """The passages of a written table of stretches, which is deleted."""
    sides = [stretches.select(F.col(s).alias("doc"), F.col(f"{s}_begin").alias("begin"), F.col(f"{s}_end").alias("end")) for s in "ab"]
    table = _stretch_tokens(docs, sides[0].unionByName(sides[1]))
    tokens, joined = table.dropDuplicates(["doc", "begin", "end"]), stretches
    for side in "ab":
        named = {"doc": side, "begin": f"{side}_begin", "end": f"{side}_end", "tokens": f"{side}_tokens"}
        joined = joined.join(tokens.withColumnsRenamed(named), [side, f"{side}_begin", f"{side}_end"])
    columns = ("a", "b", "a_begin", "b_begin", "a_tokens", "b_tokens")
    passages = written(joined.select(*columns).mapInArrow(_verify(size), PASSAGES), "passages")
    discard(table, stretches)
    return passages


# What the least document of a key does not hold


def _unsettled(collisions: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    """The collisions whose common token no verified passage of the same two documents covers."""
    collisions = collisions[collisions["a"] != collisions["b"]]
    if not len(passages) or not len(collisions):
        return collisions[[*_NAMES]]
    pairs = mix(mix(passages["doc_id"].to_numpy()) + passages["first_doc_id"].to_numpy().astype(np.uint64))
    ids = np.unique(pairs)
    wide = np.int64(max(collisions["b_at"].max(), passages["end_word"].max()) + 2)
    begin = np.searchsorted(ids, pairs) * wide + passages["start_word"].to_numpy()
    end = begin + (passages["end_word"] - passages["start_word"]).to_numpy() - SHINGLE + 1
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    pairs = mix(mix(collisions["b"].to_numpy()) + collisions["a"].to_numpy().astype(np.uint64))
    pair = np.searchsorted(ids, pairs)
    known = ids[np.minimum(pair, len(ids) - 1)] == pairs
    place = pair * wide + collisions["b_at"].to_numpy()
    last = np.searchsorted(begin, place, side="right") - 1
    covered = known & (last >= 0) & (reach[last] > place)
    return collisions.loc[~covered, [*_NAMES]]


_NAMES = [x.split()[0] for x in COLLISIONS.split(", ")]


def _useful(windows: np.ndarray) -> np.ndarray:
    """The open windows and the first of each key, by key, document and place; no other can be a key's first."""
    order = np.argsort(windows["key"])
    keys = windows["key"][order]
    same = keys[1:] == keys[:-1]
    # Most keys have one window; only the others' windows are brought in order.
    places = np.flatnonzero(np.append(False, same) | np.append(same, False))
    several = np.sort(order[places])
    order[places] = several[np.lexsort((windows["at"][several], windows["doc"][several], windows["key"][several]))]
    useful = windows["open"][order]
    useful[:1] = True
    useful[1:] |= ~same
    return windows[order[useful]]


FITS = "a long, b long, function int, shift int, begin int, end int"


def _meet(size: int) -> Callable:
    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        """What `_fits` gives for each open window and the first window of the least document of its key, repeats included."""
        windows = _useful(_unpacked(rows["windows"], FINER))
        begins = np.concatenate([[True], windows["key"][1:] != windows["key"][:-1]])
        least = windows[begins][np.cumsum(begins) - 1]
        a, b = least[here := windows["open"] & (least["doc"] != windows["doc"])], windows[here]
        before = np.minimum(a["at"] - a["left"], b["at"] - b["left"])
        after = np.minimum(a["right"] - a["at"], b["right"] - b["at"])
        found = {"a": a["doc"], "b": b["doc"], "function": np.zeros(len(a), np.int32), "shift": b["at"] - a["at"]}
        found |= {"begin": a["at"] - before, "end": a["at"] + after}
        return pd.DataFrame(found)[before + after + 1 >= size]

    return meet


def _least_of(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of each row of `values` from each begin to its end, included: that of two runs of the greatest power of two."""
    found = np.empty((len(values), len(begin)), values.dtype)
    wide = end - begin + 1
    step, widest = 1, wide.max(initial=0)
    while step <= widest:
        here = np.flatnonzero((wide >= step) & (wide < 2 * step))
        found[:, here] = np.minimum(values[:, begin[here]], values[:, end[here] - step + 1])
        values = np.minimum(values[:, :-step], values[:, step:])
        step *= 2
    return found


def _finer(size: int, bits: int) -> Callable:
    """Rows (bucket, windows): given windows under finer keys.

    A window of the first function gets the content of each run of `size` tokens that its least token is least of, so
    equal passages meet under a key that nothing else has. All windows get the least tokens, under SKETCHES other
    functions, of both sides; one of the two sides lies in the passage.
    """
    half = size // 2 + 1

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2).offsets.to_numpy()
            given = [batch.column(k).values.to_numpy(zero_copy_only=False) for k in range(2, 7)]
            for row, hashes, first in _tokens(*text_bytes(batch.column(1))):
                ends = lists[row : row + len(first)]
                text = np.repeat(np.arange(len(first) - 1), np.diff(ends))
                key, left, at, right, open_ = (x[ends[0] : ends[-1]] for x in given)
                # Rows of equal doc_ids may be other texts.
                inside = right < np.diff(first)[text]
                key, left, at, right, open_, text = (x[inside] for x in (key, left, at, right, open_, text))

                def hold(keys: np.ndarray, which: np.ndarray) -> None:
                    found = np.empty(len(keys), FINER)
                    found["key"], found["doc"] = keys & ~_FUNCTION_BITS, ids[row + text[which]]
                    for name, x in (("left", left), ("at", at), ("right", right), ("open", open_)):
                        found[name] = x[which]
                    held.append(found)

                of = np.flatnonzero(key & int(_FUNCTION_BITS) == 0)
                begin = np.maximum(left[of], at[of] - size + 1)
                runs = np.minimum(at[of], right[of] - size + 1) - begin + 1
                run = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                begin = np.repeat(first[text[of]] + begin, runs) + run
                hold(run_hashes(hashes, begin, begin + size), np.repeat(of, runs))
                values = np.stack([mix(hashes + np.uint64(201 + j)) for j in range(SKETCHES)])
                sides = mix(key.astype(np.uint64) + np.arange(2 * SKETCHES, dtype=np.uint64)[:, None])
                place = first[text] + at
                sides[:SKETCHES] += _least_of(values, place - np.minimum(at - left, half - 1), place)
                sides[SKETCHES:] += _least_of(values, place, place + np.minimum(right - at, half - 1))
                hold(mix(sides).ravel(), np.tile(np.arange(len(at)), 2 * SKETCHES))
                if sum(map(len, held)) > PER_FLUSH:
                    yield _packed([_useful(np.concatenate(held))], bits)
                    held = []
        if held:
            yield _packed([_useful(np.concatenate(held))], bits)

    return finer


def _together(reported: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    """The reported rows with those of `more`, least first document first, that add something.

    A row of which more than SLACK words are in no row yet is added; one that holds a row of the same pair takes its place.
    """
    more = more.sort_values(["doc_id", "first_doc_id", "start_word", "end_word"], ascending=[True, True, True, False], ignore_index=True)
    touched = reported["doc_id"].isin(more["doc_id"])
    seen: dict[int, list[tuple]] = {}
    for row in [*reported[touched].itertuples(index=False, name=None)]:
        seen.setdefault(row[0], []).append(row)
    for row in more.itertuples(index=False, name=None):
        doc, begin, end, first, low, high, _ = row
        rows = seen.setdefault(doc, [])
        pair = [x for x in rows if x[3] == first]
        if any(x[1] <= begin and end <= x[2] and x[4] <= low and high <= x[5] for x in pair):
            continue
        held = [x for x in pair if begin <= x[1] and x[2] <= end and low <= x[4] and x[5] <= high]
        free = np.ones(end - begin, bool)
        for x in rows:
            free[max(x[1] - begin, 0) : max(x[2] - begin, 0)] = False
        if held or free.sum() > SLACK:
            seen[doc] = [x for x in rows if x not in held] + [row]
    rows = pd.DataFrame([x for rows in seen.values() for x in rows], columns=reported.columns)
    return pd.concat([reported[~touched], rows.astype(reported.dtypes)]) if len(rows) else reported


def _second_stars(docs: DataFrame, collisions: DataFrame, passages: DataFrame, size: int) -> DataFrame:
    """Passages around tokens that the least document of the key shares without the passage."""
    parts = F.lit(collisions.count() // PER_BUCKET + 1)
    of_doc = lambda rows, doc: rows.groupBy(F.pmod(F.xxhash64(doc), parts))
    open_ = of_doc(collisions, "b").cogroup(of_doc(passages, "doc_id")).applyInPandas(_unsettled, COLLISIONS)
    open_ = written(open_, "open")
    windows = collisions.join(open_.select("key").distinct(), "key", "left_semi")
    windows = windows.select("key", F.col("b").alias("doc"), "b_left", "b_at", "b_right").distinct()
    places = open_.select(F.col("b").alias("doc"), "b_at", F.lit(True).alias("open")).distinct()
    windows = windows.join(places, ["doc", "b_at"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    windows = written(windows, "unsettled")
    discard(open_, collisions)
    amount = windows.count()
    if not amount:
        discard(windows)
        return passages
    bits = max(0, (amount * (2 * SKETCHES + size // FUNCTIONS) // PER_BUCKET).bit_length())
    listed = [F.col(f"of.{c}").alias(c) for c in ("key", "b_left", "b_at", "b_right", "open")]
    parts_of = windows.groupBy("doc").agg(F.ceil(F.count("*") / STRETCHES_PER_ROW).alias("parts"))
    part = F.pmod(F.xxhash64("key", "b_at"), F.col("parts")).alias("part")
    lists = windows.join(parts_of, "doc").groupBy("doc", part).agg(F.collect_list(F.struct("key", "b_left", "b_at", "b_right", "open")).alias("of"))
    lists = lists.select(F.col("doc").alias("doc_id"), *listed)
    # One way at any size: lists small enough for a broadcast on a small table are not on a large one.
    finer = docs.join(lists.hint("merge"), "doc_id").select("doc_id", "text", "key", "b_left", "b_at", "b_right", "open")
    finer = finer.mapInArrow(_finer(size, bits), "bucket long, windows binary")
    fits = written(finer.groupBy("bucket").applyInPandas(_meet(size), FITS).distinct(), "fits")
    discard(windows)
    more = _verified(docs, _agreements(fits, size, 1), size)
    return of_doc(passages, "doc_id").cogroup(of_doc(more, "doc_id")).applyInPandas(_together, PASSAGES)


def repeated_passages(docs: DataFrame, *, words: int = WORDS, functions: int = FUNCTIONS, enough: int = ENOUGH) -> DataFrame:
    """doc_id, start_word, end_word, first_doc_id, first_start_word, first_end_word, similarity.

    One row for each passage of at least `words` words that a document shares with the least document that has the
    same least token, or, where that document lacks the passage, with the least that has it; ends are exclusive, words count from 0. A passage in n documents makes n - 1 rows. Passages that
    repeat only inside one document are not reported. Null, empty and short texts have none. Rows without a doc_id are
    passed over; rows with equal doc_ids are one document. Other columns are ignored; an empty table gives no rows.
    """
    size = words - SHINGLE + 1
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    n_windows = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * functions // (3 * size)
    bits = max(0, (n_windows // PER_BUCKET).bit_length())
    windows = docs.mapInArrow(_windows(size, functions, bits), "bucket long, windows binary")
    collisions = written(windows.groupBy("bucket").applyInPandas(_collide, COLLISIONS), "collisions")
    fits = written(_fits(collisions, size), "fits")
    passages = _verified(docs, _agreements(fits, size, enough), size)
    return _second_stars(docs, collisions, passages, size)
