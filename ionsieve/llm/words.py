"""Words and shingles of many texts at once, as hashes in numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. A-Z are lower-cased
first. Hashes have 64 bits and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Texts are taken in slices of about this many bytes (never cut), so that the work arrays stay small.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together, at least one text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(1 << 18, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps)
    return _TABLES["up"], _TABLES["down"]


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "lower" not in _TABLES:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _TABLES.update(lower=lower, space=space, value=mix(lower.astype(np.uint64) + np.uint64(1)))
    return _TABLES["lower"], _TABLES["space"], _TABLES["value"]


def exact_values(data: np.ndarray) -> np.ndarray:
    """A random-looking value for each byte, upper and lower case apart."""
    if "exact" not in _TABLES:
        _TABLES["exact"] = mix(np.arange(256) + 1001)
    return _TABLES["exact"][data]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run values[start:end]."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    """Words of consecutive texts. Text d has the words first[d] to first[d+1]."""

    hashes: np.ndarray
    starts: np.ndarray  # in bytes
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray, *, fold: bool = True) -> Words:
    """The words of every text; `fold` takes A-Z as a-z."""
    _, space, value = _byte_tables()
    inside = ~space[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = run_hashes(value[data] if fold else exact_values(data), starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


class Shingles(NamedTuple):
    """Shingles of consecutive texts, in text order, repeats included."""

    hashes: np.ndarray
    first: np.ndarray


def shingles_of(words: Words, k: int = 5) -> Shingles:
    """Hashes of k consecutive words; a shorter text is one shingle, an empty one none."""
    counts = words.counts
    amounts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(amounts)])
    out = np.zeros(first[-1], np.uint64)
    odd = mix(np.arange(1, k + 1)) | np.uint64(1)
    h, n = words.hashes, len(words.hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled += h[j : n - k + 1 + j] * odd[j]
        text = np.repeat(np.arange(len(counts)), counts)[: n - k + 1]
        at = np.arange(n - k + 1)
        at, text = (x[at + k <= words.first[text + 1]] for x in (at, text))
        out[at - words.first[text] + first[text]] = mix(rolled[at])
    for short in range(1, k):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            total = np.zeros(len(texts), np.uint64)
            for j in range(short):
                total += h[words.first[texts] + j] * odd[j]
            out[first[texts]] = mix(total + np.uint64(short))
    return Shingles(out, first)
