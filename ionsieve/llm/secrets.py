"""Secrets in texts: known forms, and strings that a primed compressor cannot shorten.

A long mixed string near a word like `auth` or `session` is a candidate. It is compressed with zstandard, primed with
common identifiers and the text around the candidate. What it adds in bytes, against its length, is its novelty: names,
words and repeats are nearly free, random keys cost their whole length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_bytes

# Fixed patterns of the known forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# A candidate: this many characters of the set below, a digit and a letter among them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_CANDIDATE = 16
SENSITIVE = re.compile(r"auth|bearer|cookie|credential|key|passphrase|passw|private|pwd|secret|session|signature|token", re.I | re.A)
NEAR = 48  # characters before a candidate in which a sensitive word counts
AROUND = 256  # characters on either side that prime the compressor
NOVELTY = 0.8  # added bytes by length

IDENTIFIERS = b" ".join(
    b"access_key account address application authorization authenticate base64 bearer certificate client_id "
    b"client_secret config connection container content-type cookie credentials database default description "
    b"environment endpoint expires function header identifier import include instance integer interface localhost "
    b"location message method namespace object options package parameter password private_key properties protocol "
    b"public_key reference repository request resource response return schema secret_key security server service "
    b"session_id signature string template timestamp transaction undefined update username value version "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0000000000 example.com https:// http://".split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the known forms; kind is a place in KINDS."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), m.end(), 0))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        if kind == 1 and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end() - m.start() >= LEAST[KINDS[kind]]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], x[2]))


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that text[start:end] adds to its primed surroundings, by its own length in bytes."""
    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    primer = zstandard.ZstdCompressionDict(
        IDENTIFIERS + b" " + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_dict_id=False)
    value = text[start:end].encode()
    return (len(squeeze.compress(value)) - len(squeeze.compress(b""))) / len(value)


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that do not compress and touch no known span."""
    found, k = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(known) and known[k][1] <= start:
            k += 1
        value = m[0]
        if (k < len(known) and known[k][0] < end) or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
            continue
        if SENSITIVE.search(text, max(0, start - NEAR), start) and novelty(text, start, end) >= NOVELTY:
            found.append((start, end, 3))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def _with_long_run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a run of at least 16 candidate characters."""
    member = np.zeros(256, bool)
    member[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
    spread = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    inside = np.zeros(len(data) + len(offsets), bool)  # one free place before each text and at the end
    inside[spread] = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    places = offsets[:-1] + np.arange(len(offsets) - 1)
    return np.unique(np.searchsorted(places, starts[ends - starts >= LEAST_CANDIDATE], side="right") - 1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        data, offsets = text_bytes(batch.column(1))
        # Every known form but a short assignment holds a run of 16; every assignment holds a colon or an equals sign.
        marks = np.concatenate([[0], np.cumsum((data == 58) | (data == 61))])
        look = np.diff(marks[offsets]) > 0
        look[_with_long_run(data, offsets)] = True
        counts = np.zeros((3, n), np.int64)
        digests, texts = [nothing] * n, [""] * n
        for k in np.flatnonzero(look).tolist():
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            for _, _, kind in base:
                counts[kind, k] += 1
            digests[k] = hashlib.sha256(_joined(base).encode()).hexdigest()
            texts[k] = _joined(sorted(base + novel_spans(text, base), key=lambda x: (x[0], x[2])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of `docs`.

    `spans` lists kind:start:end in code points, by start and then kind. Null and empty texts have none. Null and equal
    doc_ids are ordinary rows; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
