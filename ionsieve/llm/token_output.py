"""Token ids as fixed-length sequences in Arrow files.

Each shard is one Arrow IPC file. Its batches hold two fixed-size lists, `ids`
(uint16 where the vocabulary has at most 65,536 entries, else uint32) and `mask` (true for a token, false for padding), so sequence i of
batch b is found by arithmetic and read without a copy from a mapped file. A
second Arrow file beside it says where each document lies in the shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import new_folder, written
from .words import exact_values, run_hashes, slices, text_bytes

SEQUENCE = 2048
ROWS_PER_BATCH = 64
SHARD_BYTES = 64 << 20
END_ID = 2
# Pieces that a task remembers; beyond it the memory is emptied and fills again.
REMEMBERED = 1_000_000
# Bytes of text that are encoded at once.
SLICE = 1 << 19

# Pieces that are encoded as one text.
TOGETHER = 8192

# First bytes of characters of which piece_cuts() knows that they are no space: visible ASCII, letters and signs.
_SEEN = np.zeros(256, bool)
_SEEN[33:127] = _SEEN[0xC3:0xE0] = True

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def piece_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which texts may be cut without changing their ids.

    The vocabulary's splitter always breaks before a single space that a visible
    character follows, between an ASCII letter or digit and most punctuation, and on both sides of
    a line feed between two visible ASCII characters.
    """
    n = len(data)
    alnum = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123)):
        alnum[a:b] = True
    points = np.zeros(256, bool)
    points[list(b".,!|%$&*#;:?")] = True
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1 : n - 1] |= (data[1:-1] == 32) & _SEEN[data[2:]]
        cut[0] = data[0] == 32
        cut[1:n] |= points[data[1:]] & alnum[data[:-1]]
    if n > 2:
        lone = (data[1:-1] == 10) & alnum[data[2:]] & (data[:-2] > 32) & (data[:-2] < 127)
        cut[1 : n - 1] |= lone
        cut[2:n] |= lone
    cut[offsets] = True
    return np.flatnonzero(cut)


class Store:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.buffer, self.size = np.zeros(1 << 16, kind), 0

    @property
    def values(self) -> np.ndarray:
        return self.buffer[: self.size]

    def append(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.buffer):
            self.buffer = np.concatenate([self.values, np.zeros(self.size + 2 * len(more), self.buffer.dtype)])
        self.buffer[self.size : self.size + len(more)] = more
        self.size += len(more)


class Encoder:
    """Encodes texts piece by piece and remembers the ids of pieces it has met."""

    def __init__(self, path: str) -> None:
        import re

        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(re.escape(x.encode()) for x in added)) if added else None
        vocabulary = self.tokenizer.get_vocab()  # each character of an entry stands for one byte
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # by the piece's 64-bit hash
        self.first, self.ids = Store(np.int64), Store(np.uint32)
        self.first.append(np.zeros(1, np.int64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the n+1 places where each text's ids begin."""
        if len(self.known) > REMEMBERED:
            self._forget()
        cuts = self._cuts(data, offsets)
        hashes = run_hashes(exact_values(data), cuts[:-1], cuts[1:])
        hashes, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        slots = list(map(self.known.get, hashes.tolist()))
        slot = np.array([-1 if x is None else x for x in slots], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, counts, order = self._learn(data, cuts[at[new]], cuts[at[new] + 1])
            slot[new[order]] = len(self.known) + np.arange(len(new))
            self.known.update(zip(hashes[new].tolist(), slot[new].tolist()))
            self.first.append(self.first.values[-1] + np.cumsum(counts))
            self.ids.append(ids)
        first = self.first.values
        begin = first[slot]
        lengths = (first[slot + 1] - begin)[which]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[which] - ends + lengths, lengths)
        begins = np.concatenate([[0], ends])
        return self.ids.values[places], begins[np.searchsorted(cuts, offsets)]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """As piece_cuts(), with each added token's text in a piece of its own."""
        cuts, raw = piece_cuts(data, offsets), data.tobytes()
        if self.added is None or not self.added.search(raw):
            return cuts
        cut = np.zeros(len(data) + 1, bool)
        cut[cuts] = True
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            last = a
            for found in self.added.finditer(raw[a:b]):
                begin, end = a + found.start(), a + found.end()
                # The library splits there first: a last space before it follows no visible character any more.
                cut[max(last + 1, begin - 1) : end] = False
                cut[[begin, end]] = True
                last = end
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces data[begin:end], how many each has, and the order in which the pieces come there.

        Pieces that begin with a space and a visible character are encoded as one text: the splitter
        breaks before each, and the tokens' lengths in bytes say which belong to which.
        """
        spaced = (data[begins] == 32) & (ends - begins > 1) & _SEEN[data[np.minimum(begins + 1, len(data) - 1)]]
        order = np.argsort(~spaced, kind="stable")
        n = int(spaced.sum())
        begins, sizes = begins[order], (ends - begins)[order]
        last = np.cumsum(sizes)
        text = data[np.arange(last[-1]) + np.repeat(begins - last + sizes, sizes)].tobytes()
        # Texts: pieces 0 to n some at a time, each of the others alone.
        heads = np.append(np.arange(0, n, TOGETHER), np.arange(n, len(sizes) + 1))
        bounds = np.append(0, last)[heads].tolist()
        found = self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(bounds, bounds[1:])], add_special_tokens=False)
        ids = [np.array(x.ids, np.uint32) for x in found]
        together = np.concatenate([np.zeros(0, np.uint32), *ids[: -(-n // TOGETHER)]])
        counts = np.diff(np.searchsorted(np.cumsum(self.token_bytes[together]), last[:n]) + 1, prepend=0)
        alone = [len(x) for x in ids[-(-n // TOGETHER) :]]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.append(counts, alone).astype(np.int64), order


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def shard_writer(folder: str, tokenizer: str, end_id: int, length: int) -> Callable:
    """A task that writes its rows, already in order, as one shard and returns a manifest row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        final = f"{root}/shard-{shard:07d}"
        part = f"{final}.attempt-{context.taskAttemptId()}"
        encode = Encoder(tokenizer)
        kind = np.uint16 if max(len(encode.token_bytes) - 1, end_id) < 1 << 16 else np.uint32
        schema = _schema(length, pa.from_numpy_dtype(kind))
        n_docs = n_tokens = 0
        rest = np.zeros(0, kind)

        def lists(ids: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
            kinds = schema.types
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((ids, mask), kinds)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        with (
            files.open_output_stream(f"{part}.ids") as to_ids,
            pa.ipc.new_file(to_ids, schema) as sequences,
            files.open_output_stream(f"{part}.docs") as to_docs,
            pa.ipc.new_file(to_docs, _INDEX) as index,
        ):
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                for a, b in slices(offsets, SLICE):
                    ids, begins = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ids = np.insert(ids, begins[1:], np.uint32(end_id))
                    counts = np.diff(begins) + 1
                    starts = n_tokens + np.cumsum(counts) - counts
                    rows = [batch.column(0).slice(a, b - a), pa.array(starts), pa.array(counts)]
                    index.write_batch(pa.RecordBatch.from_arrays(rows, schema=_INDEX))
                    n_docs, n_tokens = n_docs + b - a, n_tokens + len(ids)
                    rest = np.concatenate([rest, ids.astype(kind)])
                    block = length * ROWS_PER_BATCH
                    while len(rest) >= block:
                        sequences.write_batch(lists(rest[:block], np.ones(block, bool)))
                        rest = rest[block:]
            if len(rest):
                size = -(-len(rest) // length) * length
                mask = np.arange(size) < len(rest)
                sequences.write_batch(lists(np.pad(rest, (0, size - len(rest))), mask))
        for kind in ("ids", "docs"):
            files.move(f"{part}.{kind}", f"{final}.{kind}")
        path = f"{folder}/shard-{shard:07d}"
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]}
        )

    return write


def write_sequences(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    *,
    end_id: int = END_ID,
    length: int = SEQUENCE,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write `docs` (doc_id, text) in ascending doc_id order; returns the manifest of shards.

    A null text is empty and yields the end id alone. A null doc_id comes first. Rows with equal doc_id
    are all written, in the order of a hash of their text. Other columns are ignored. An empty table
    gives shards without documents. An added token's name in a text is that token, as the library has it.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "sequences")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    write = shard_writer(folder, tokenizer, end_id, length)
    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document from the files of `manifest`: its place in the whole stream and a checksum."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    shards = placed.select("path", "base").repartition(max(1, manifest.count()), "path")
    return shards.mapInArrow(_read_shards, DOCUMENTS)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for path, base in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            yield from _read_shard(path, base)


def _read_shard(path: str, base: int) -> Iterator[pa.RecordBatch]:
    files, root = _open(path)

    def opened(name: str):
        if isinstance(files, fs.LocalFileSystem):
            return pa.ipc.open_file(pa.memory_map(name))
        return pa.ipc.open_file(files.open_input_file(name))

    sequences, index = opened(f"{root}.ids"), opened(f"{root}.docs")
    begin, values, batch = 0, np.zeros(0, np.uint16), 0  # values are the ids from place `begin` on
    for k in range(index.num_record_batches):
        rows = index.get_batch(k)
        starts, counts = (rows.column(j).to_numpy() for j in (1, 2))
        sums = []
        for start, count in zip(starts.tolist(), counts.tolist()):
            crc, at, left = 0, start, count
            while left:
                if at >= begin + len(values):
                    begin += len(values)
                    values = sequences.get_batch(batch).column(0).flatten().to_numpy()
                    batch += 1
                    continue
                take = values[at - begin : at - begin + left]
                crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                at, left = at + len(take), left - len(take)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(starts + base), rows.column(2), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_sequence(path: str, row: int, length: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence `row` of a shard: found by arithmetic; ids are mapped rather than copied where local."""
    files, root = _open(path)
    name = f"{root}.ids"
    local = isinstance(files, fs.LocalFileSystem)
    source = pa.ipc.open_file(pa.memory_map(name) if local else files.open_input_file(name))
    batch, at = divmod(row, ROWS_PER_BATCH)
    columns = source.get_batch(batch)
    ids, mask = (columns.column(j).flatten().slice(at * length, length) for j in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)
