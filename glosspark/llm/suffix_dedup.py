"""Exact substring dedup over bytes with longest-previous-factor arrays.

A byte goes if it lies in a string of `length` bytes that also starts earlier (smaller
doc_id, or same document at an earlier offset); strings are judged on the input.

1. Every window of `length` bytes chooses an anchor by its content alone: the first of its
   `GRAM`-byte grams with the least hash. Windows in a row with one anchor form a piece, about
   30 windows each. Equal windows have equal anchors, so pieces go by anchor hash to buckets.
2. There, pieces equal in all bytes (by hash) are settled: all but the earliest are covered.
   Where an anchor has different pieces, the earliest of each is asked for.
3. The texts of those pieces are gathered by anchor, and each bucket orders their suffixes
   (rank doubling up to `length` bytes). The earlier match of a window that reaches furthest is at
   the previous or next smaller position in suffix order; the longer of the two common prefixes
   is its longest previous factor (counted up to `length`). Windows whose factor reaches
   `length` are covered.
   An anchor with more than `HOT` different pieces (a passage that many documents share, met
   in many contexts) sends its windows as hashes instead, settled by the earliest place, so no
   task holds such a group's text; repeats inside a slice are settled before sending.

Defined cases: a null or empty text has no bytes; documents shorter than `length` lose
nothing; rows with equal doc_id and text are one document and get the same answer; rows
sharing a doc_id with other texts, and null doc_ids (last), are ordered by a hash of the
text; texts of any length are read in segments; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.llm import packed as P
from glosspark.llm.common import FIRST, SECOND

LENGTH = 100
GRAM = 40
SLICE = 1 << 20             # bytes of text a task handles at a time
PIECES = 3_000_000          # per bucket, about
HOT = 512                   # different pieces of one anchor
SUFFIX_BYTES = 2 << 20      # ordered at a time (or one anchor's pieces)

PIECE, COVERED, ASK, ASK_HOT, TEXT, PLACE = range(6)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:len(x)] = x
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """First window, number of windows, anchor hash and content hash of every piece."""
    n = len(raw)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < length:
        return none
    prefix = FIRST.prefix(raw)
    at = np.arange(n - gram + 1)
    h = FIRST.ranges(prefix, at, at + gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    good = np.ones(n - length + 1, bool)
    for end in offsets[1:-1]:
        good[max(0, end - length + 1):end] = False
    start = np.flatnonzero(good)
    if not len(start):
        return none
    a = anchor[start]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)))
    i = np.flatnonzero(first)
    count = np.diff(np.append(i, len(start)))
    s = start[i]
    return s, count, h[a[i]], SECOND.ranges(SECOND.prefix(raw), s, s + count + length - 1)


def _segments(off: np.ndarray, lo: int, hi: int, length: int):
    """(from, to, first position) for a slice: a text longer than a slice in overlapping parts."""
    if hi - lo > 1 or off[hi] - off[lo] <= SLICE:
        yield off[lo], off[hi], 0
        return
    for at in range(off[lo], off[hi], SLICE):
        yield at, min(off[hi], at + SLICE + length - 1), at - off[lo]


def _anchors(length: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            did, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tie"))
            for lo, hi in P.slices(off, SLICE):
                for a, b, base in _segments(off, lo, hi, length):
                    local = np.append(np.maximum(off[lo:hi], a), b) - a if hi - lo == 1 else off[lo:hi + 1] - a
                    s, n, h, d = pieces(raw[a:b], local, length, gram)
                    doc = np.searchsorted(local, s, "right") - 1
                    pos = s - local[doc] + base
                    i, t = did[lo:hi], tie[lo:hi]
                    late = P.not_first(h, d, i[doc], t[doc], pos)
                    rows = P.forward(COVERED, buckets, i, t, doc[late], pos[late], n[late])
                    k = ~late
                    rows += P.blocks(PIECE, buckets, i, t, doc[k], pos[k], h[k], d[k], n[k])
                    if rows:
                        yield P.table(rows, P.BLOCK_ARROW)
    return run


def _settle(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        did, tie, pos, h, d, n = P.unblock([r for r in rows if r["kind"] == PIECE], np.uint64, np.uint64)
        late = P.not_first(h, d, did, tie, pos)
        out = P.replies(COVERED, buckets, did[late], tie[late], pos[late], n[late])
        di, ti, po, _, _, no = P.unblock([r for r in rows if r["kind"] == COVERED])
        out += P.replies(COVERED, buckets, di, ti, po, no)
        first = np.flatnonzero(~late)
        order = first[np.lexsort((d[first], h[first]))]
        if len(order):
            # how many different contents each anchor has (equal rows of one document count once)
            newh = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            newd = newh | np.concatenate(([True], d[order][1:] != d[order][:-1]))
            at = np.flatnonzero(newh)
            kinds = np.repeat(np.add.reduceat(newd.astype(np.int64), at), np.diff(np.append(at, len(order))))
            for kind, pick in ((ASK, order[(kinds > 1) & (kinds <= HOT) & newd]), (ASK_HOT, order[(kinds > HOT) & newd])):
                out += P.replies(kind, buckets, did[pick], tie[pick], pos[pick], n[pick], h[pick])
        return pa.Table.from_pylist(out, schema=P.BLOCK_ARROW)
    return run


def _fetch(length: int, buckets: int):
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            did, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tie"))
            for lo, hi in P.slices(off, SLICE):
                ask, hot = [], []
                for i in range(lo, hi):
                    for g in batch.column("got")[i].as_py():
                        pos, n, h = P.places(g["pos"]), P.expand(g["n"]), np.frombuffer(g["h"], np.uint64)
                        if g["kind"] == COVERED:
                            yield P.table(P.forward(COVERED, buckets, did[i:i + 1], tie[i:i + 1], np.zeros(len(pos), np.int64), pos, n), P.BLOCK_ARROW)
                        else:
                            (ask if g["kind"] == ASK else hot).append((np.full(len(pos), i - lo), pos, n, h))
                i, t = did[lo:hi], tie[lo:hi]
                if ask:
                    doc, pos, n, h = (np.concatenate(x) for x in zip(*ask))
                    to = (h % np.uint64(buckets)).astype(np.int64)
                    start = off[lo + doc] + pos
                    rows = []
                    for b in np.unique(to):
                        m = to == b
                        o = np.lexsort((pos[m], doc[m]))
                        got = P.blocks(TEXT, 1, i, t, doc[m][o], pos[m][o], h[m][o], n=n[m][o])[0]
                        s, e = start[m][o], start[m][o] + n[m][o] + length - 1
                        got["d"] = b"".join(raw[x:y].tobytes() for x, y in zip(s, e))
                        rows.append(got | {"bucket": int(b)})
                    yield P.table(rows, P.BLOCK_ARROW)
                if hot:
                    doc, pos, n, _ = (np.concatenate(x) for x in zip(*hot))
                    o = np.lexsort((pos, doc))
                    doc, pos, n = doc[o], pos[o], n[o]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    doc, pos = np.repeat(doc, n), np.repeat(pos, n) + step
                    a, b = off[lo], off[hi]
                    at = off[lo + doc] + pos - a
                    u = FIRST.ranges(FIRST.prefix(raw[a:b]), at, at + length)
                    v = SECOND.ranges(SECOND.prefix(raw[a:b]), at, at + length)
                    late = P.not_first(u, v, i[doc], t[doc], pos)
                    rows = P.forward(COVERED, buckets, i, t, doc[late], pos[late], np.ones(int(late.sum()), np.int64))
                    k = ~late
                    yield P.table(rows + P.blocks(PLACE, buckets, i, t, doc[k], pos[k], u[k], v[k]), P.BLOCK_ARROW)
    return run


class Suffixes:
    """Suffixes of `raw` at `starts` ordered by their first `length` bytes (rank doubling); every
    start has `length` bytes left. The ranks by 8, 16, 32... bytes stay, for common prefixes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, length: int):
        n = len(raw)
        self.starts, self.length, self.ranks = starts, length, []
        pad = np.zeros(n + 8, np.uint8)
        pad[:n] = raw
        self.code = np.zeros(n, np.uint64)                     # the next eight bytes of every place
        for i in range(8):
            self.code = (self.code << np.uint64(8)) | pad[i:n + i]
        have = min(8, length)
        key = self.code >> np.uint64(8 * (8 - have))
        while have < length:
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            self.ranks.append((have, rank.astype(np.int32)))
            step = min(have, length - have)
            key = rank * n
            key[:n - step] += rank[step:]
            have += step
        r = key[starts]
        self.order = np.argsort(r, kind="stable")
        self.same = np.concatenate((np.zeros(min(1, len(r)), bool), r[self.order][1:] == r[self.order][:-1]))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to `length`, of suffixes x[i] and y[i] of `starts`."""
        x, y = self.starts[x], self.starts[y]
        end = len(self.code) - 1
        got = np.zeros(len(x), np.int64)
        for size, rank in reversed(self.ranks):
            a, b = np.minimum(x + got, end), np.minimum(y + got, end)
            got += np.where((rank[a] == rank[b]) & (got < self.length), size, 0)
        differ = self.code[np.minimum(x + got, end)] ^ self.code[np.minimum(y + got, end)]
        for k in range(7, -1, -1):                              # bytes before the first that differs
            differ >>= np.uint64(8) * (k < 7)
            got += differ == 0
        return np.minimum(got, self.length)


def previous_smaller(values: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """For every index in `ask` the nearest index before it with a smaller value, -1 if none: up a
    tree of block minima to the first block on the left that holds one, and down to its last."""
    tree = [values]
    top = np.iinfo(values.dtype).max
    while len(tree[-1]) > 1:
        low = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], top)
        tree.append(np.minimum(low[::2], low[1::2]))
    out, want = np.full(len(ask), -1, np.int64), values[ask]
    live, at = np.arange(len(ask)), ask.astype(np.int64)
    found = []                                                  # (queries, block) per level
    for low in tree[:-1]:
        left = (at & 1 == 1) & (low[at - 1] < want[live])
        found.append((live[left], at[left] - 1))
        live, at = live[~left], at[~left] >> 1
    q, block = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in range(len(found) - 1, -1, -1):
        if level + 1 < len(found):                              # from the level above to the later half that holds one
            right = np.minimum(2 * block + 1, len(tree[level]) - 1)
            block = np.where((right == 2 * block + 1) & (tree[level][right] < want[q]), right, 2 * block)
        q, block = np.concatenate((q, found[level][0])), np.concatenate((block, found[level][1]))
    out[q] = block
    return out


def previous_factors(suffixes: Suffixes, position: np.ndarray, ask: np.ndarray | None = None) -> np.ndarray:
    """Longest previous factors, up to the suffixes' length: the longest common prefix of a suffix
    with one at a smaller position. In suffix order that is the nearest suffix before or after it
    with a smaller position. With `ask`, only those of the places in suffix order; the result
    follows `ask`, else the suffixes."""
    order = suffixes.order
    places = np.arange(len(order)) if ask is None else ask
    by_order = position[order]
    before = previous_smaller(by_order, places)
    after = len(order) - 1 - previous_smaller(by_order[::-1], len(order) - 1 - places)
    got = np.zeros(len(places), np.int64)
    for other, there in ((before, before >= 0), (after, after < len(order))):
        got[there] = np.maximum(got[there], suffixes.common(order[places[there]], order[other[there]]))
    if ask is not None:
        return got
    out = np.zeros(len(order), np.int64)
    out[order] = got
    return out


def repeats(suffixes: Suffixes, position: np.ndarray) -> np.ndarray:
    """True for a suffix whose longest previous factor reaches the suffixes' length. Only one with a
    neighbour of that common prefix can, so the others are not asked for."""
    out = np.zeros(len(position), bool)
    run = suffixes.same.copy()
    run[:-1] |= suffixes.same[1:]
    ask = np.flatnonzero(run)
    if len(ask):
        out[suffixes.order[ask]] = previous_factors(suffixes, position, ask) >= suffixes.length
    return out


def _suffixes(length: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        di, ti, po, _, _, no = P.unblock([r for r in rows if r["kind"] == COVERED])
        out = P.replies(COVERED, buckets, di, ti, po, no)

        did, tie, pos, h, d, _ = P.unblock([r for r in rows if r["kind"] == PLACE], np.uint64, np.uint64)
        late = P.not_first(h, d, did, tie, pos)
        out += P.replies(COVERED, buckets, *P.runs(did[late], tie[late], pos[late]))

        texts = [r for r in rows if r["kind"] == TEXT]
        raw = np.frombuffer(b"".join(r["d"] for r in texts), np.uint8)
        did, tie, pos, h, _, n = P.unblock(texts)
        size = n + length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(h, kind="stable")      # pieces of an anchor together
        edges = np.concatenate((np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))), [len(h)])) if len(h) else [0]
        total = np.concatenate(([0], np.cumsum(size[order])))
        lo = 0
        while lo < len(edges) - 1:
            hi = max(lo + 1, int(np.searchsorted(total[edges], total[edges[lo]] + SUFFIX_BYTES, "right")) - 1)
            pick = order[edges[lo]:edges[hi]]
            lo = hi
            part = np.concatenate([raw[begin[p]:begin[p] + size[p]] for p in pick])
            head = np.cumsum(size[pick]) - size[pick]
            m = n[pick]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            starts, a, b, c = np.repeat(head, m) + step, np.repeat(did[pick], m), np.repeat(tie[pick], m), np.repeat(pos[pick], m) + step
            by_place = np.lexsort((c, b, a))
            place = np.empty(len(a), np.int64)
            new = np.ones(len(a), bool)
            x = by_place
            new[1:] = (a[x][1:] != a[x][:-1]) | (b[x][1:] != b[x][:-1]) | (c[x][1:] != c[x][:-1])
            place[x] = np.cumsum(new)
            late = repeats(Suffixes(part, starts, length), place)
            out += P.replies(COVERED, buckets, *P.runs(a[late], b[late], c[late]))
        return pa.Table.from_pylist(out, schema=P.BLOCK_ARROW)
    return run


OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _remove(length: int):
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            removed, spans, kept = [], [], []
            for i, got in enumerate(batch.column("got")):
                text = raw[off[i]:off[i + 1]]
                got = got.as_py()
                if not got:
                    removed.append(0), spans.append(0), kept.append(text.tobytes())
                    continue
                gone = np.zeros(len(text) + 1, np.int32)
                for g in got:
                    s = P.places(g["pos"])
                    np.add.at(gone, s, 1)
                    np.subtract.at(gone, s + P.expand(g["n"]) + length - 1, 1)
                out = np.cumsum(gone)[:-1] > 0
                removed.append(int(out.sum()))
                spans.append(int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])))
                kept.append(text[~out].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=OUT.names)
    return run


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row: kept holds the remaining bytes."""
    gram = gram or max(1, min(GRAM, length * 2 // 5))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = P.bucket_count(2 * size // (length - gram + 2), PIECES, spark)
    texts, keys = P.keyed(docs, id_col, text_col)
    first = (texts.select("did", "tie", "text").mapInArrow(_anchors(length, gram, buckets), P.BLOCK_SCHEMA)
             .groupBy("bucket").applyInArrow(_settle(buckets), P.BLOCK_SCHEMA))
    late = (P.with_answers(texts, first, keys, "inner").mapInArrow(_fetch(length, 4 * buckets), P.BLOCK_SCHEMA)
            .groupBy("bucket").applyInArrow(_suffixes(length, buckets), P.BLOCK_SCHEMA))
    return P.with_answers(texts, late, keys, "left").mapInArrow(_remove(length), OUT)
