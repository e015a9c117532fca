"""Words of whole Arrow text columns as numpy arrays, without a Python loop over words.

A word is ``[^\\x20\\x09-\\x0D]+``. All of these separators are single bytes that never occur inside a
UTF-8 character, so words are found and hashed on the bytes. A hash is a polynomial over random
64-bit values of the bytes, taken from running sums, and then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, which bounds the memory of the arrays.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_U = np.uint64
_random = np.random.default_rng(20240229)
_BASE = int(_random.integers(1 << 62, dtype=np.int64)) * 2 + 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
#: The same, with A-Z taken for a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
_PLACE = (_random.integers(1, 1 << 62, 64, dtype=np.int64).astype(_U) << _U(1)) | _U(1)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse, modulo 2^64."""
    have = _powers[which]
    if len(have) < n:
        base = _BASE if which == "up" else _BASE_INVERSE
        while len(have) < n:
            step = _U(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the place where each row starts (n + 1 values); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a worker, with all it holds, for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows with about ``limit`` bytes of text, one row at least."""
    try:
        yield from _cut(batches, column, limit)
    finally:
        give_back()


def _cut(batches, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
            yield batch.slice(row, last - row)
            row = last


@dataclass
class Words:
    """Words of a column: place of each in the bytes, hash, and where each row's words start."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray  # n + 1 offsets into the words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of bytes."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * _power("up", len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    return mix(h + (ends - starts).astype(_U) * _PLACE[63])


def edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True  # a row's first byte never continues a word
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    stops[:-1] &= ~solid[1:] | first[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(texts: pa.Array, fold: bool) -> Words:
    """The words of every row; ``fold`` takes A-Z for a-z in the hashes."""
    data, at = text_bytes(texts)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, _U), np.zeros(len(at), np.int64))
    starts, ends = edges(data, at)
    hashes = hash_ranges(data, starts, ends, FOLDED_VALUES if fold else BYTE_VALUES)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, at))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, row after row, and the offsets of the rows.

    A row with fewer words, but with one at least, has its whole sequence as its only shingle; k is at most 20.
    """
    counts = w.counts
    n = len(w.hashes)
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    if n == 0:
        return np.zeros(0, _U), offsets
    sums = np.zeros(n, _U)
    padded = np.concatenate([w.hashes, np.zeros(k, _U)])
    for j in range(k):
        sums += padded[j:j + n] * _PLACE[j]
    place = np.arange(n) - np.repeat(w.rows[:-1], counts)
    left = np.repeat(counts, counts) - place
    keep = (left >= k) | (place == 0)
    out = sums[keep]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = w.hashes[w.rows[row]:w.rows[row + 1]]
        # The length takes part, so that no run of k words has the same sum by construction.
        out[offsets[row]:offsets[row] + 1] = np.append(own * _PLACE[:len(own)], _PLACE[40 + len(own):41 + len(own)]).sum(
            dtype=_U)
    return mix(out), offsets
