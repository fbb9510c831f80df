"""Alignment of two tokenizers' tokens over the same bytes, by sparse products.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback. Both encode a text with a
space put before it. A token-byte incidence matrix has a row per token and a column per byte. The product of A's
matrix with B's transposed one, row by row (Gustavson), has an entry for each pair of tokens that share bytes:
how many they share. Bytes at which tokens of both sides end cut the text into groups, and the product of the
token-group matrices has an entry for each pair in one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .token_output import Encoder
from .words import slices, text_bytes

# Bytes of text that are encoded at once; longer texts are cut where both sides' tokens surely end.
SLICE = 1 << 18
# Pairs of ids that are sent to every task with their counts (17 bytes each), the most frequent ones; the others are joined.
SENT_PAIRS = 1 << 20
# Shared-group entries that are made at once.
ENTRIES = 1 << 18


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has the columns at[first[i] : first[i + 1]], and as many values."""

    first: np.ndarray
    at: np.ndarray
    values: np.ndarray
    n_columns: int

    @property
    def n_rows(self) -> int:
        return len(self.first) - 1


def incidence(ends: np.ndarray) -> Csr:
    """Rows for consecutive runs of columns that end at `ends`: each has a 1 in every column of its run."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends).astype(np.int64), np.arange(n), np.ones(n, np.int64), n)


def transposed(m: Csr) -> Csr:
    """Rows become columns: entries are dealt out by column, in row order."""
    rows = np.repeat(np.arange(m.n_rows), np.diff(m.first))
    order = np.argsort(m.at, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(m.at, minlength=m.n_columns)))
    return Csr(first, rows[order], m.values[order], m.n_rows)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """How many products of entries each row of a·b sums up: the length of its merged rows of b."""
    lengths = np.append(0, np.cumsum(np.diff(b.first)[a.at]))
    return lengths[a.first[1:]] - lengths[a.first[:-1]]


def product(a: Csr, b: Csr) -> Csr:
    """a·b by Gustavson: row i adds up b's rows that a's row i names, times a's values there."""
    lengths = np.diff(b.first)[a.at]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.arange(total) + np.repeat(b.first[a.at] - ends + lengths, lengths)
    rows = np.repeat(np.repeat(np.arange(a.n_rows), np.diff(a.first)), lengths)
    columns, values = b.at[places], np.repeat(a.values, lengths) * b.values[places]
    keys = rows * np.int64(max(b.n_columns, 1)) + columns
    if np.any(keys[1:] < keys[:-1]):
        order = np.argsort(keys, kind="stable")
        rows, columns, values, keys = rows[order], columns[order], values[order], keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if total else np.zeros(0, np.int64)
    sums = np.add.reduceat(values, new) if total else values
    first = np.append(0, np.cumsum(np.bincount(rows[new], minlength=a.n_rows)))
    return Csr(first, columns[new], sums, b.n_columns)


def entries(m: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of each entry."""
    return np.repeat(np.arange(m.n_rows), np.diff(m.first)), m.at, m.values


class Aligned(NamedTuple):
    """Tokens of a stretch of bytes on both sides, and where they end. The last token of both ends at its end."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray

    def group_ends(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, shared bytes) for every pair of tokens that share bytes."""
        return entries(product(incidence(self.a_ends), transposed(incidence(self.b_ends))))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) for the overlapping pairs whose byte ranges end together."""
        a, b, _ = self.overlaps()
        together = self.a_ends[a] == self.b_ends[b]
        return a[together], b[together]

    def group_matrices(self) -> tuple[Csr, Csr]:
        """Token-group incidence of A, and the transposed one of B."""
        groups = self.group_ends()
        sides = []
        for ends in (self.a_ends, self.b_ends):
            n = len(ends)
            sides.append(Csr(np.arange(n + 1), np.searchsorted(groups, ends), np.ones(n, np.int64), len(groups)))
        return sides[0], transposed(sides[1])

    def n_shared(self) -> np.ndarray:
        """How many B tokens share the group of each A token."""
        return product_sizes(*self.group_matrices())

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) for every pair in one group, some rows of the product at a time."""
        a, b = self.group_matrices()
        ends = np.cumsum(product_sizes(a, b))
        row = 0
        while row < a.n_rows:
            last = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + ENTRIES, side="right"))
            last = max(last, row + 1)
            part = Csr(a.first[row : last + 1] - a.first[row], a.at[a.first[row] : a.first[last]], a.values[a.first[row] : a.first[last]], a.n_columns)
            rows, columns, _ = entries(product(part, b))
            yield rows + row, columns
            row = last


class PlainEncoder(Encoder):
    """Side A: as the library encodes with the special tokens' strings taken as plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = None


class PieceEncoder(Encoder):
    """Side B: texts in stretches that begin with spaces, each encoded once.

    No piece of the model has a space behind another character, so tokens never reach over the start of a
    run of spaces. The model puts a space before what it encodes; a stretch gives its first space for it.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes: list[bytes] = []
        for i in range(size):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        if any(b" " in x.lstrip(b" ") for x in self.bytes):
            raise ValueError("a piece holds a space behind other characters: stretches can't be encoded alone")
        self.bad = size  # stands for a stretch whose tokens do not give back its bytes
        self.token_bytes = np.array([*map(len, self.bytes), 0], np.int64)
        self._forget()

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = data.tobytes()
        pieces = [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist())]
        found = self.model.encode([x[1:].decode() for x in pieces], num_threads=1)
        spell = self.bytes.__getitem__
        for k, (piece, ids) in enumerate(zip(pieces, found)):
            if piece == b" ":  # nothing is left to encode
                found[k] = ids = [self.model.piece_to_id("▁")]
            if b"".join(map(spell, ids)) != piece:
                found[k] = [self.bad]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts, np.arange(len(found))


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that is not empty."""
    full = np.diff(offsets) > 0
    moved = offsets + np.append(0, np.cumsum(full))
    out = np.full(len(data) + int(full.sum()), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[moved[:-1][full]] = False
    out[keep] = data
    return out, moved


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places before a lone space between visible ASCII and an ASCII letter: a token begins there on either side."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    letter = data[2:] | np.uint8(32)
    before, lone = (data[:-2] > 32) & (data[:-2] < 127), data[1:-1] == 32
    return np.flatnonzero(before & lone & (letter >= 97) & (letter <= 122)) + 1


def _parts(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of parts, the text of each part): texts longer than `size` are cut into parts of about that."""
    cuts, of = [np.zeros(1, np.int64)], []
    for text in range(len(offsets) - 1):
        a, b = int(offsets[text]), int(offsets[text + 1])
        inner = np.zeros(0, np.int64)
        if b - a > size:
            at = safe_cuts(data[a:b])
            inner = np.unique(at[np.minimum(np.searchsorted(at, np.arange(size, b - a, size)), len(at) - 1)]) + a if len(at) else inner
        cuts.append(np.append(inner, b))
        of += [text] * (len(inner) + 1)
    return np.concatenate(cuts), np.array(of, np.int64)


def _stream(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


class Part(NamedTuple):
    """What a part of a text adds: counts, its groups as bytes, and its linked id pairs with how often each occurs."""

    n_a: int
    n_b: int
    n_groups: int
    n_shared: int
    groups: bytes
    pairs: np.ndarray
    times: np.ndarray


def _labels(n: int, ends: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids 0 to n as text, followed by the one or the other sign: rows of bytes and their lengths."""
    texts = [str(i).encode() + end for end in ends for i in range(n)]
    width = max(map(len, texts))
    table = np.frombuffer(b"".join(x.ljust(width) for x in texts), np.uint8).reshape(-1, width)
    return table, np.fromiter(map(len, texts), np.int64, len(texts))


class Aligner:
    """Aligns texts slice by slice."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = PlainEncoder(a_path), PieceEncoder(b_path)
        self.n_a, self.n_b = len(self.a.token_bytes), self.b.bad + 1
        tables = _labels(self.n_a, (b",", b"|")), _labels(self.n_b, (b",", b";"))
        width = max(t.shape[1] for t, _ in tables)
        self.labels = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t, _ in tables])
        self.lengths = np.concatenate([n for _, n in tables])

    def texts(self, data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[Part | None]:
        """One Part for each text, None where it has no tokens or a side does not give its bytes back."""
        data, offsets = _spaced(data, offsets)
        bounds, of = _parts(data, offsets, size)
        held: list[Part | None] = []
        at = 0
        for x, y in slices(bounds, size):
            for k, part in enumerate(self.parts(data[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x]), x):
                if of[k] != at:
                    yield _joined(held)
                    held, at = [], int(of[k])
                held.append(part)
        if len(of):
            yield _joined(held)

    def aligned(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Aligned, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all parts, where each part's tokens begin on either side, and which parts give their bytes back."""
        a_ids, a_first = self.a(data, offsets)
        b_ids, b_first = self.b(data, offsets)
        bad = np.zeros(len(offsets), np.int64)
        np.cumsum(np.bincount(np.searchsorted(b_first, np.flatnonzero(b_ids == self.b.bad), side="right") - 1, minlength=len(offsets) - 1), out=bad[1:])
        good = np.diff(bad) == 0
        if not good.all():  # without their tokens the others' ends are right again, as if these parts were empty
            a_ids, b_ids = (ids[np.repeat(good, np.diff(first))] for ids, first in ((a_ids, a_first), (b_ids, b_first)))
            a_first, b_first = (np.append(0, np.cumsum(np.diff(first) * good)) for first in (a_first, b_first))
        found = Aligned(a_ids, _stream(a_ids, self.a.token_bytes), b_ids, _stream(b_ids, self.b.token_bytes))
        sizes = np.diff(offsets) * good
        ends = np.append(0, found.a_ends)[a_first]
        same = (np.diff(ends) == sizes) & (np.diff(np.append(0, found.b_ends)[b_first]) == sizes)
        if not same.all():
            raise ValueError("tokens do not give back the bytes of their text")
        return found, a_first, b_first, good

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> list[Part | None]:
        found, a_first, b_first, good = self.aligned(data, offsets)
        groups = found.group_ends()
        text_ends = np.append(0, found.a_ends)[a_first]
        group_first = np.searchsorted(groups, text_ends, side="right")
        # Linked id pairs of each part, with their number.
        a, b = found.links()
        of = np.searchsorted(a_first, a, side="right") - 1
        keys = found.a_ids[a].astype(np.int64) * self.n_b + found.b_ids[b]
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1]))) if len(of) else np.zeros(0, np.int64)
        times, of, keys = np.diff(np.append(new, len(of))), of[new], keys[new]
        key_first = np.searchsorted(of, np.arange(len(offsets)))
        # Each group's ids as text: A's tokens before B's, commas between and signs behind the last of either.
        a_group, b_group = np.searchsorted(groups, found.a_ends), np.searchsorted(groups, found.b_ends)
        a_last, b_last = groups[a_group] == found.a_ends, groups[b_group] == found.b_ends
        codes = np.concatenate([found.a_ids + a_last * self.n_a, 2 * self.n_a + found.b_ids + b_last * self.n_b]).astype(np.int64)
        place = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        codes = codes[place]
        lengths = self.lengths[codes]
        text = self.labels[codes][np.arange(self.labels.shape[1]) < lengths[:, None]].tobytes()
        text_first = np.append(0, np.cumsum(lengths))[a_first + b_first]
        shared = np.append(0, np.cumsum(found.n_shared()))[a_first]
        out: list[Part | None] = []
        for k in range(len(offsets) - 1):
            if not good[k] or offsets[k] == offsets[k + 1]:
                out.append(None)
                continue
            x, y = key_first[k], key_first[k + 1]
            out.append(
                Part(
                    int(a_first[k + 1] - a_first[k]), int(b_first[k + 1] - b_first[k]), int(group_first[k + 1] - group_first[k]),
                    int(shared[k + 1] - shared[k]), text[text_first[k] : text_first[k + 1]], keys[x:y], times[x:y],
                )
            )
        return out


def _joined(parts: list[Part | None]) -> Part | None:
    """The parts of one text as one."""
    if len(parts) == 1 or any(x is None for x in parts):
        return parts[0] if len(parts) == 1 else None
    keys, at = np.unique(np.concatenate([x.pairs for x in parts]), return_inverse=True)
    times = np.bincount(at, weights=np.concatenate([x.times for x in parts])).astype(np.int64)
    return Part(*(sum(x[i] for x in parts) for i in range(4)), b"".join(x.groups for x in parts), keys, times)


DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_shared long, groups_sha256 string, pairs array<long>, times array<long>"


def _digest_task(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            done = 0
            for x, y in slices(offsets, 4 * SLICE):
                parts = list(aligner.texts(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]))
                yield _rows(batch.column(0).slice(x, y - x), parts)
                done = y
            assert done == batch.num_rows

    return run


def _rows(ids: pa.Array, parts: list[Part | None]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    counts = [pa.array([x[i] if x else 0 for x in parts], pa.int64()) for i in range(4)]
    sums = pa.array([hashlib.sha256(x.groups[:-1]).hexdigest() if x else "" for x in parts], pa.string())
    first = pa.array(np.cumsum([0, *(len(x.pairs) if x else 0 for x in parts)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(first, pa.array(np.concatenate([none, *(x[i] for x in parts if x)]), pa.int64())) for i in (5, 6)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_shared", "groups_sha256", "pairs", "times"]
    return pa.RecordBatch.from_arrays([ids, *counts, sums, *lists], names=names)


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row_id, doc_id, n_a, n_b, n_groups, n_shared, groups_sha256, pairs, times: one row for each row of `docs`, written once.

    pairs and times are the distinct linked id pairs (A id times B's number of ids, plus one, plus B id) and how many links of the
    document have them; n_shared counts the pairs of tokens in one group. Texts that are null, empty, or that a side
    does not give back byte by byte (one with U+2581, say) have no tokens. Null and equal doc_ids are rows of their own;
    other columns are ignored; an empty table gives an empty one. A long text is cut where both sides' tokens
    begin for certain, which changes nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digest_task(a_path, b_path), DIGESTS)
    return written(rows.select(F.monotonically_increasing_id().alias("row_id"), "*"), "alignments")


def link_counts(digested: DataFrame, n_b: int) -> DataFrame:
    """pair, count, best: how many links of the whole corpus hold an id pair, and whether none of its B id has more."""
    pairs = digested.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = written(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pair-counts")
    b_id = F.pmod("pair", F.lit(n_b))
    most = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    # One row for each id of B's vocabulary at most.
    return counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


LINKED = "row_id long, n_best long, count_sum long, rest array<long>, rest_times array<long>"


def _count_task(keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = (pa.concat_arrays([batch.column(i)]) for i in (1, 2))
            first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            pairs, times = lists.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            links, totals = (np.append(0, np.cumsum(np.where(known, x[at] * times, 0) if len(keys) else np.zeros(len(pairs), np.int64))) for x in (best, counts))
            left = np.append(0, np.cumsum(~known))[first].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~known])) for x in (pairs, times)]
            sums = [pa.array(np.diff(x[first])) for x in (links, totals)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *rest], names=["row_id", "n_best", "count_sum", "rest", "rest_times"])

    return run


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared: one row for each row of `docs`.

    Links are pairs of tokens that share bytes and end together, so each group has one. An id pair's count is the number of links with
    it in all documents; n_best counts a document's links whose pair no other pair of its B id exceeds, count_sum adds
    up their counts. The `sent_pairs` most frequent pairs go to every task, so that no join has their many rows; links of
    the others are joined with their counts. See `digests` for odd rows.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() + 1
    digested = digests(docs, a_path, b_path)
    counts = written(link_counts(digested, n_b), "link-counts")
    sent = counts.orderBy(F.col("count").desc(), "pair").limit(sent_pairs).toArrow().sort_by("pair")
    keys, of, best = (sent[x].to_numpy().astype(np.int64) for x in ("pair", "count", "best"))
    linked = digested.select("row_id", "pairs", "times").mapInArrow(_count_task(keys, of, best), LINKED)
    numbers = ("row_id", "n_best", "count_sum")
    if len(keys) < sent_pairs:
        totals = linked.select(*numbers)
    else:
        linked = written(linked, "linked")
        rest = linked.select("row_id", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row_id", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
        found = rest.join(counts, "pair").select("row_id", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("count") * F.col("times")).alias("count_sum"))
        totals = linked.select(*numbers).unionByName(found).groupBy("row_id").agg(*(F.sum(x).alias(x) for x in numbers[1:]))
    n_links = F.aggregate("times", F.lit(0).cast("long"), lambda total, n: total + n).alias("n_links")
    columns = ["doc_id", "n_a", "n_b", "n_groups", n_links, "n_best", "count_sum", "groups_sha256", "n_shared"]
    return digested.join(totals, "row_id").select(*columns)


LINKS = "doc_id long, a int, b int, shared int"


def token_links(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap") -> DataFrame:
    """doc_id, a, b, shared: the links themselves, as numbers of tokens in a document's own order on either side.

    kind "overlap": tokens that share bytes, and how many; "group": tokens in one group (shared is 0). The result has
    a row per link; groups without an inner common end make many of the second kind. Rows as in `digests`.
    """
    if kind not in ("overlap", "group"):
        raise ValueError("links are of kind 'overlap' or 'group'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            data, offsets = _spaced(data, offsets)
            bounds, text = _parts(data, offsets, SLICE)
            before = np.zeros(2, np.int64)  # tokens of the open text in earlier slices
            for x, y in slices(bounds, SLICE):
                found, a_first, b_first, _ = aligner.aligned(data[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x])
                of = text[x:y]
                opens = np.searchsorted(of, of)  # the first part of each part's text
                bases = [first[opens] - np.where(of == of[0], n, 0) for first, n in zip((a_first, b_first), before)]
                overlaps = [found.overlaps()] if kind == "overlap" else ((a, b, np.zeros(len(a))) for a, b in found.shared_groups())
                for a, b, shared in overlaps:
                    part = np.searchsorted(a_first, a, side="right") - 1
                    numbers = (a - bases[0][part], b - bases[1][part], shared)
                    ids = batch.column(0).take(pa.array(of[part]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(n.astype(np.int32)) for n in numbers)], names=["doc_id", "a", "b", "shared"])
                runs_on = y < len(text) and text[y] == of[-1]
                before = np.array([first[-1] - base[-1] for first, base in zip((a_first, b_first), bases)]) * runs_on

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKS)
