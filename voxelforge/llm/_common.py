"""Shared helpers of the training-data operators: Arrow text buffers, words and shingles as NumPy hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..tables import materialize, new_path, release, shared_dir, shuffle_partitions  # noqa: F401  the operators' way to them

#: ASCII white space as the contracts define it, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that a kernel works on at once; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


#: Bounds of an Arrow batch on its way to a Python worker: long texts can't make it large.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4_000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to the bounds above; lower limits stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets (rebased to 0); null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds about ``limit`` bytes of ``col``, one row at least."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(col))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A word: ASCII letters, digits and every byte of a non-ASCII character, after lower-casing.
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
WORD_SQL = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
_is_word = np.zeros(256, bool)
_is_word[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True
_BASE, _powers = 0x9E3779B97F4A7C15 | 1, {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for ``n`` positions."""
    if _powers.get("n", 0) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in (("p", _BASE), ("i", inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
        _powers["n"] = size
    return _powers["p"][:n], _powers["i"][:n]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-cased UTF-8 texts: 64-bit hash, start and end byte of each word, and word offsets by text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_table(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, off)


def shingle_hashes(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one text, and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    whole = np.ones(n, bool)
    for e in woff[1:-1]:
        whole[max(0, e - k + 1) : e] = False
    at = np.flatnonzero(whole)
    return mix(h[at]), at


def lowered(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(arr, ""))
