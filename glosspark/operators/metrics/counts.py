"""Integer counts of one prediction/reference pair, taken in Arrow batches next to the scan.

A function here gets texts and gives the few whole numbers that the formulas of `pairwise`, `corpus` and
`staged` read: clipped n-gram matches, common subsequence, edit distance, aligned words and chunks. Every
group of numbers is its own column, so a query pays only for those it reads. A null text gives nulls.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from glosspark.functions.porter import stem
from glosspark.operators.metrics.batched import ROWS, Pairs
from glosspark.operators.metrics.blocked import BITS
from glosspark.operators.metrics.blocked import edit_distance as edit_distance_in_blocks
from glosspark.operators.metrics.blocked import lcs_length as common_length_in_blocks

#: Java's `(?U)\s`, as in `functions.text.words`; `str.split` cuts at four control characters more.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = re.compile(f"[^{_SPACE}]+")
_ODD_SPACE = "[" + "".join(c for c in _SPACE if ord(c) > 127) + "]"
_CONTROL = re.compile("[\x1c-\x1f]")
ROUGE_WORD = re.compile("[a-z0-9]+")
MEMO = 1 << 16


def split_words(text: str) -> list[str]:
    return WORD.findall(text) if _CONTROL.search(text) else text.split()


def matches(h: list, r: list, orders: int) -> list[int]:
    """sum over n-grams of min(count in h, count in r), for n = 1 to `orders`."""
    if h == r:
        return [max(len(h) - n + 1, 0) for n in range(1, orders + 1)]
    found = []
    for n in range(1, orders + 1):
        a, b = (h, r) if n == 1 else (list(zip(*[x[i:] for i in range(n)])) for x in (h, r))
        sa, sb = set(a), set(b)
        both = sa & sb
        m = len(both)
        if len(sa) < len(a) and len(sb) < len(b):       # a side without repeats meets each value once
            ca, cb = Counter(a), Counter(b)
            m = sum([min(ca[g], cb[g]) for g in both])
        found.append(m)
        if m == 0:                                      # no longer n-gram can meet either
            return found + [0] * (orders - n)
    return found


def _trimmed(h: list, r: list) -> tuple[int, list, list]:
    """Common tokens at both ends (how many), and what is left between them."""
    n, k = min(len(h), len(r)), 0
    while k < n and h[k] == r[k]:
        k += 1
    e = 0
    while e < n - k and h[-1 - e] == r[-1 - e]:
        e += 1
    return k + e, h[k:len(h) - e], r[k:len(r) - e]


def _bits(h: list) -> dict:
    masks: dict = {}
    for j, t in enumerate(h):
        masks[t] = masks.get(t, 0) | (1 << j)
    return masks


def common_length(h: list, r: list) -> int:
    """Length of the longest common subsequence, one bit per token of h."""
    ends, h, r = _trimmed(h, r)
    if not h or not r:
        return ends
    if len(h) > BITS:
        return ends + common_length_in_blocks(h, r)
    masks, full = _bits(h), (1 << len(h)) - 1
    v = full
    for t in r:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return ends + len(h) - v.bit_count()


def edit_distance(h: list, r: list) -> int:
    """Least number of inserted, deleted and replaced tokens, one bit per token of h."""
    _, h, r = _trimmed(h, r)
    if not h or not r:
        return max(len(h), len(r))
    if len(h) > BITS:
        return edit_distance_in_blocks(h, r)
    masks, full, last = _bits(h), (1 << len(h)) - 1, 1 << (len(h) - 1)
    up, down, d = full, 0, len(h)
    for t in r:
        x = masks.get(t, 0) | down
        same = (((x & up) + up) ^ up) | x
        plus, minus = (down | ~(same | up)) & full, same & up
        if plus & last:
            d += 1
        elif minus & last:
            d -= 1
        plus, minus = (plus << 1) | 1, minus << 1
        up, down = (minus | ~(same | plus)) & full, plus & same & full
    return d


def aligned(h: list, r: list) -> tuple[int, int]:
    """Words aligned, k-th from last with k-th from last, and the chunks they form (1 for none)."""
    if h == r:
        return len(h), 1
    places: dict = {}
    for j, t in enumerate(r):
        places.setdefault(t, []).append(j)
    m, chunks, after = 0, 1, None
    for i in range(len(h) - 1, -1, -1):
        free = places.get(h[i])
        if free:
            j = free.pop()
            if after is not None and after != (i + 1, j + 1):
                chunks += 1
            m, after = m + 1, (i, j)
    return m, chunks


def _spaced(h: pa.Array, r: pa.Array) -> Pairs:
    return Pairs(h, r, _ODD_SPACE, WORD.findall)


def _bleu(h: pa.Array, r: pa.Array) -> tuple:
    p = _spaced(h, r)
    return *p.matches(4), p.hl, p.rl


def _edits(h: pa.Array, r: pa.Array) -> tuple:
    p = _spaced(h, r)
    return p.edit_distance(edit_distance), p.rl


def _alignment(h: pa.Array, r: pa.Array) -> tuple:
    p = _spaced(h, r)
    return *p.aligned(), p.hl, p.rl


def _rouge(h: pa.Array, r: pa.Array) -> tuple:
    p = Pairs(h, r)
    return *p.matches(2), p.common_length(common_length), p.hl, p.rl


def _overlap(h: list, r: list) -> tuple:
    return *matches(h, r, 2), common_length(h, r), len(h), len(r)


def _stems(longer_than: int):
    memo: dict = {}

    def run(h: str, r: str) -> tuple:
        if len(memo) > MEMO:
            memo.clear()
        sides = ROUGE_WORD.findall(h), ROUGE_WORD.findall(r)
        for t in {*sides[0], *sides[1]}:
            if t not in memo:
                memo[t] = t if len(t) <= longer_than else stem(t)
        return _overlap(*([memo[t] for t in side] for side in sides))
    return run


def _counted(one, names: list[str], h, r):
    """Struct column of whole numbers `names`, by one(h, r) per row."""
    kind = pa.struct([(n, pa.int32()) for n in names])

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [None if x is None or y is None else one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
        cols = zip(*(row or (None,) * len(names) for row in rows)) if rows else ([] for _ in names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], fields=list(kind))
    return F.arrow_udf(run, ", ".join(f"{n} int" for n in names))(h, r)


def _counted_in_arrays(many, names: list[str], h, r):
    """The same by many(h, r) for `ROWS` rows at a time."""
    kind = pa.struct([(n, pa.int32()) for n in names])

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        null = pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        a, b = a.fill_null(""), b.fill_null("")
        parts = [many(a.slice(k, ROWS), b.slice(k, ROWS)) for k in range(0, len(a), ROWS)]
        cols = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int64) for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int32(), mask=null) for c in cols], fields=list(kind))
    return F.arrow_udf(run, ", ".join(f"{n} int" for n in names))(h, r)


def bleu_counts(h, r):
    """Texts -> m1..m4 (clipped matches), hl, rl (words)."""
    return _counted_in_arrays(_bleu, ["m1", "m2", "m3", "m4", "hl", "rl"], h, r)


def rouge_counts(h, r, stems_longer_than: int | None = None):
    """Lower-cased texts -> m1, m2, lcs, hn, rn over runs of a-z and 0-9, or over their stems."""
    names = ["m1", "m2", "lcs", "hn", "rn"]
    return _counted_in_arrays(_rouge, names, h, r) if stems_longer_than is None else _counted(_stems(stems_longer_than), names, h, r)


def edit_counts(h, r):
    """Texts -> d (word edit distance), rl."""
    return _counted_in_arrays(_edits, ["d", "rl"], h, r)


def alignment_counts(h, r):
    """Lower-cased texts -> m (aligned words), chunks, hl, rl."""
    return _counted_in_arrays(_alignment, ["m", "chunks", "hl", "rl"], h, r)
