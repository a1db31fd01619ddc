"""Vectorised word scanning of Arrow string columns.

Every helper works on one Arrow batch inside a Spark task.  A batch is cut
into slices of at most ``SLICE_BYTES`` of text (one document at least), so a
task's memory follows the slice and the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random unsigned 64-bit integers."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(seed))


class _Powers:
    """Growing tables of powers of one odd multiplier and of its inverse."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n).bit_length())
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, self.base)]), dtype=_U)
                self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, self.inverse)]), dtype=_U)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(_BASE, _BASE_INV)
_WORDS = _Powers(_U(0xC2B2AE3D27D4EB4F), _U(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)))


def word_bytes(pattern: str) -> np.ndarray:
    """256 booleans: the bytes that words consist of.

    ``space``: words ``[^\\x20\\x09-\\x0D]+``; ``alnum``: words
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower case.  Both
    classes treat every byte of a multi-byte UTF-8 character alike.
    """
    b = np.arange(256)
    if pattern == "space":
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    if pattern == "alnum":
        low = np.where((b >= 65) & (b <= 90), b + 32, b)
        return ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (b >= 128)
    raise ValueError(f"unknown word pattern: {pattern}")


@dataclass
class Words:
    """The words of consecutive documents of a batch.

    ``first`` is the batch row of the first document; ``bounds[i]`` is the
    index of the first word of document ``first + i`` and has one more entry
    than there are documents.  ``start`` and ``end`` are byte positions in
    ``data``.
    """

    first: int
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.bounds))


def _string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row edges in them) of consecutive slices of a string column."""
    if len(column) == 0:
        return
    data, offsets = _string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        stop = min(stop, n)
        lo, hi = int(offsets[row]), int(offsets[stop])
        yield row, data[lo:hi], offsets[row : stop + 1] - lo
        row = stop


def span_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a scrambled polynomial over keyed bytes."""
    up, down = _BYTES.get(len(part) + 1)
    total = np.zeros(len(part) + 1, dtype=_U)
    np.cumsum(value[part] * up[: len(part)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xA0761D6478BD642F))


def span_strings(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans as an Arrow array, without a Python string for each."""
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[at].tobytes()))


def byte_values(lower: bool, seed: int = 7) -> np.ndarray:
    value = keyed(256, seed)
    if lower:
        value[65:91] = value[97:123]
    return value


def scan(column: pa.Array, pattern: str, lower: bool, seed: int = 7) -> Iterator[Words]:
    """The words of every row of a string column with a 64-bit hash each.

    A word's hash depends on its bytes (A-Z folded if ``lower``) and on
    ``seed`` only.
    """
    inside, value = word_bytes(pattern), byte_values(lower, seed)
    for row, part, edge in slices(column):
        is_word = inside[part]
        before = np.zeros(len(part), dtype=bool)
        before[1:] = is_word[:-1]
        before[edge[:-1][edge[:-1] < len(part)]] = False
        start = np.flatnonzero(is_word & ~before)
        after = np.zeros(len(part), dtype=bool)
        after[:-1] = is_word[1:]
        after[edge[1:][edge[1:] > 0] - 1] = False
        end = np.flatnonzero(is_word & ~after) + 1
        yield Words(row, np.searchsorted(start, edge), start, end, span_hashes(part, start, end, value), part)


def windows(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay inside one document.

    Returns (word index of each run's start, hash, document index).
    """
    count = len(words.hash)
    if count < width:
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64)
    up, down = _WORDS.get(count + 1)
    total = np.zeros(count + 1, dtype=_U)
    np.cumsum((mix64(words.hash + _U(seed)) if seed else words.hash) * up[:count], out=total[1:])
    all_h = (total[width:] - total[:-width]) * down[: count - width + 1]
    doc = words.doc_of_word()
    at = np.flatnonzero(doc[: count - width + 1] == doc[width - 1 :])
    return at, mix64(all_h[at] + _U(width)), doc[at]
