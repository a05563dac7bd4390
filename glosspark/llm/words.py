"""Words of many texts at once, as exact codes (numpy and Arrow, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside` bytes; a run ends where its text does."""
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(inside))]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def coded(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(code, start, end, text index) of every run of `inside` bytes in the texts
    raw[offsets[i]:offsets[i+1]], and the distinct runs that the codes number. Codes are equal
    only where the runs are, byte by byte."""
    s, e = spans(inside, offsets)
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=ends[1:])
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    named = runs.dictionary_encode()
    return named.indices.to_numpy(zero_copy_only=False).astype(np.int64), s, e, np.searchsorted(offsets, s, "right") - 1, named.dictionary


def digests(distinct: pa.Array) -> np.ndarray:
    """(n, 2) uint64: two independent 64-bit hashes of each entry (BLAKE2b, so that no pattern in
    the bytes makes different entries meet)."""
    raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in distinct.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each pair (both below 2^32) among the distinct pairs, and the distinct pairs packed as first << 32 | second."""
    packed, rank = np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)
    return rank.astype(np.int64), packed
