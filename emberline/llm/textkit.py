"""Vectorised text kernels shared by the Arrow-side operators.

Everything here works on a flat ``uint8`` buffer of UTF-8 text plus document
offsets, so no Python object is made for a single word.  Hashes are 64-bit
polynomial hashes over randomly mapped bytes, computed from one prefix sum and
finished with a mixer; they are equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one kernel call; a longer document is one call.
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: A second map of bytes, where 64 bits are too few to stand for a string.
_BYTE_B = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

#: ASCII white space (0x20 and 0x09 to 0x0D) as a lookup table over bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
            _inv = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INV, np.uint64)], dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(buf: np.ndarray, other: bool = False) -> np.ndarray:
    """Prefix sums P with hash(buf[s:e]) = mix((P[e]-P[s]) * base^-s); `other` takes the second map of bytes."""
    p, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_B if other else _BYTE)[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [starts, ends)."""
    _, inv = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def hash_bytes(text: bytes) -> int:
    """The hash that span_hash gives to one whole byte string."""
    buf = np.frombuffer(text, np.uint8)
    return int(span_hash(prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0])


def tokens(buf: np.ndarray, offs: np.ndarray, delim: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each document where its words begin.

    offs has one more entry than there are documents; words never cross it.
    """
    word = ~delim[buf]
    brk = np.zeros(len(buf) + 1, dtype=bool)
    brk[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | brk[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | brk[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one document, or of all its words as one run if it has fewer."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        out *= _SHINGLE
        out += words[j : len(words) - k + 1 + j]
    return mix(out + np.uint64(k))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string or binary column; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if big else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges [a, b) of at most `most` bytes each, or of one longer document."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of a batch: document range, bytes and offsets of the text column."""
    buf, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
    for a, b in slices(offs):
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
