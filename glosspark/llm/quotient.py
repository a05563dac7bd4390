"""Counting quotient filters without loss, as compact bytes.

A key of 2 * `half` bits goes through an invertible permutation. The leading bits of what comes
out are its quotient, which is stored by place only; all other bits are stored in full as the
remainder. So a filter gives back every key with its exact count, and filters over parts of the
data are merged as sorted lists. The leading `bucket_bits` of the quotient name the bucket: the
range of keys that one filter holds.
"""

from __future__ import annotations

import numpy as np

from glosspark.llm.common import mix64
from glosspark.llm.packed import expand, squeeze

SCHEMA = "bucket int, q int, n int, occupied binary, ends binary, low binary, right binary, counts binary"
COLUMNS = ("bucket", "q", "n", "occupied", "ends", "low", "right", "counts")
_ROUND_KEYS = mix64(np.arange(1, 5, dtype=np.uint64))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _round(x: np.ndarray, key: np.uint64, half: int) -> np.ndarray:
    return mix64(x * _ODD + key) >> np.uint64(64 - half)


def permute(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A balanced Feistel network over two halves of `half` bits."""
    for key in _ROUND_KEYS:
        left, right = right, left ^ _round(right, key, half)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of `permute`."""
    for key in _ROUND_KEYS[::-1]:
        left, right = right ^ _round(left, key, half), left
    return left, right


def tally(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None):
    """Sorted distinct keys with their summed counts."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(at, len(left)))
    else:
        total = np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
    return left[at], right[at], total


def _narrow(x: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(raw: bytes, bits: int, n: int) -> np.ndarray:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, bucket_bits: int) -> list[dict]:
    """Filters, one per bucket, of sorted distinct permuted keys."""
    bucket = left >> np.uint64(half - bucket_bits)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(left)]))) if len(left) else ():
        q = min(half - bucket_bits, int(hi - lo).bit_length())
        rest = half - bucket_bits - q
        quotient = ((left[lo:hi] >> np.uint64(rest)) & np.uint64((1 << q) - 1)).astype(np.int64)
        occupied = np.zeros(1 << q, np.uint8)
        occupied[quotient] = 1
        ends = np.ones(hi - lo, np.uint8)
        ends[:-1] = quotient[1:] != quotient[:-1]
        rows.append({"bucket": int(bucket[lo]), "q": q, "n": int(hi - lo), "occupied": np.packbits(occupied).tobytes(), "ends": np.packbits(ends).tobytes(),
                     "low": _narrow(left[lo:hi] & np.uint64((1 << rest) - 1), rest), "right": _narrow(right[lo:hi], half), "counts": squeeze(counts[lo:hi])})
    return rows


def decode(row: dict, half: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted permuted keys of a filter and their counts."""
    q, n = row["q"], row["n"]
    rest = half - bucket_bits - q
    ends = np.unpackbits(np.frombuffer(row["ends"], np.uint8), count=n)
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(row["occupied"], np.uint8), count=1 << q))[run].astype(np.uint64)
    left = (np.uint64(row["bucket"]) << np.uint64(half - bucket_bits)) | (quotient << np.uint64(rest)) | _widen(row["low"], rest, n)
    return left, _widen(row["right"], half, n), expand(row["counts"])


def merge(rows: list[dict], half: int, bucket_bits: int):
    """Sorted distinct permuted keys of filters of one bucket, counts added."""
    parts = [decode(r, half, bucket_bits) for r in rows]
    return tally(*(np.concatenate(x) for x in zip(*parts)))
