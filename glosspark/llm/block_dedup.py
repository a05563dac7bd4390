"""Substring dedup with fixed-block anchors.

The words of every document are cut into non-overlapping reference blocks of `block` words;
their hashes are indexed and probed with every rolling window of `block` words. A repeat of
`window` words (at least 2 * block) holds a whole reference block of its earlier copy, so a
probe of the later copy hits it. Hits are extended to maximal exact repeats: the
windows of `window` words around hits are compared by 96 bits (64 and 32 of independent hashes
of their words, which are BLAKE2b digests), all but the earliest of equal windows are covered, and overlapping
covered windows join up. A covered word is removed.

Both exchanges move packed places (`packed.py`). Windows that repeat inside one slice of a
task are settled there, so however many documents share a passage, the task of its bucket
sees it once per slice. Both exchanges answer per document, and the texts are dealt by
document once for both readings.

Defined cases: a null or empty text has no words and stays empty; documents shorter than a
window lose nothing; rows with equal doc_id and text are one document and get the same
answer; rows sharing a doc_id with other texts, and null doc_ids (last), are ordered by a
hash of the text; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.llm import packed as P
from glosspark.llm.common import mix64, rolling, word_hashes

WINDOW = 20
BLOCK = 10
SLICE = 4 << 20             # bytes of text a task handles at a time
PLACES = 2_000_000          # per bucket, about

PROBE, HIT, PLACE, COVERED = range(4)


def _probes(window: int, block: int, buckets: int):
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            did, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tie"))
            for lo, hi in P.slices(off, SLICE):
                h, doc, pos, size = word_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                r = rolling(h, block)
                ok = (doc[:len(r)] == doc[block - 1:]) & (size[doc[:len(r)]] >= window)
                at = np.flatnonzero(ok)
                r = r[at]
                rows = P.blocks(PROBE, buckets, did[lo:hi], tie[lo:hi], doc[at], pos[at], (r >> np.uint64(32)).astype(np.uint32), route=r)
                if rows:
                    yield P.table(rows, P.BLOCK_ARROW)
    return run


def _hits(block: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        did, tie, pos, h, _, _ = P.unblock(group.to_pylist(), np.uint32)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        if not len(at):
            return pa.Table.from_pylist([], schema=P.BLOCK_ARROW)
        anchors = np.add.reduceat((pos[order] % block == 0).astype(np.int64), at)
        size = np.diff(np.append(at, len(h)))
        hit = order[np.repeat((size > 1) & (anchors > 0), size)]
        return pa.Table.from_pylist(P.replies(HIT, buckets, did[hit], tie[hit], pos[hit]), schema=P.BLOCK_ARROW)
    return run


def _windows(window: int, block: int, buckets: int):
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            did, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tie"))
            got = batch.column("got")
            for lo, hi in P.slices(off, SLICE):
                (h, g), doc, pos, size = word_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], both=True)
                n = len(h) - window + 1
                if n <= 0:
                    continue
                head = np.cumsum(size) - size
                hits = [head[i] + P.places(x["pos"]) for i in range(hi - lo) for x in got[lo + i].as_py()]
                x = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                # a hit at x is inside the windows that start in [x - (window - block), x]
                open_ = np.zeros(len(h) + 2, np.int64)
                np.add.at(open_, np.maximum(x - (window - block), 0), 1)
                np.subtract.at(open_, x + 1, 1)
                at = np.flatnonzero((np.cumsum(open_)[:n] > 0) & (doc[:n] == doc[window - 1:]))
                a = rolling(h, window)[at]
                b = (rolling(g, window)[at] >> np.uint64(32)).astype(np.uint32)
                d, p, i, t = doc[at], pos[at], did[lo:hi], tie[lo:hi]
                late = P.not_first(a, b, i[d], t[d], p)
                rows = P.forward(COVERED, buckets, i, t, d[late], p[late])
                keep = ~late
                rows += P.blocks(PLACE, buckets, i, t, d[keep], p[keep], a[keep], b[keep])
                if rows:
                    yield P.table(rows, P.BLOCK_ARROW)
    return run


def _covered(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        did, tie, pos, h, d, _ = P.unblock([r for r in rows if r["kind"] == PLACE], np.uint64, np.uint32)
        late = P.not_first(h, d, did, tie, pos)
        di, ti, po, _, _, _ = P.unblock([r for r in rows if r["kind"] == COVERED])
        found = P.runs(np.concatenate((did[late], di)), np.concatenate((tie[late], ti)), np.concatenate((pos[late], po)))
        return pa.Table.from_pylist(P.replies(COVERED, buckets, *found), schema=P.BLOCK_ARROW)
    return run


OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                    T.StructField("kept", T.StringType())])


def _remove(window: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, got in zip(batch.column("text"), batch.column("got")):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for g in got.as_py() or ():
                    s = P.places(g["pos"])
                    np.add.at(gone, s, 1)
                    np.subtract.at(gone, s + P.expand(g["n"]) + window - 1, 1)
                out = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
                kept.append(b" ".join(w for w, x in zip(words, out) if not x) if out.any() else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array([k.decode("utf-8") for k in kept], pa.string())], names=OUT.names)
    return run


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(id, n_words, n_removed, kept) per row: kept holds the remaining words joined by a space."""
    if window < 2 * block:
        raise ValueError("a window must hold a whole block at any offset: window >= 2 * block")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = P.bucket_count(size // 6, PLACES, spark)
    texts, keys = P.keyed(docs, id_col, text_col)
    hits = (texts.select("did", "tie", "text").mapInArrow(_probes(window, block, buckets), P.BLOCK_SCHEMA)
            .groupBy("bucket").applyInArrow(_hits(block, buckets), P.BLOCK_SCHEMA))
    late = (P.with_answers(texts, hits, keys, "inner").mapInArrow(_windows(window, block, buckets), P.BLOCK_SCHEMA)
            .groupBy("bucket").applyInArrow(_covered(buckets), P.BLOCK_SCHEMA))
    return P.with_answers(texts, late, keys, "left").mapInArrow(_remove(window), OUT)
