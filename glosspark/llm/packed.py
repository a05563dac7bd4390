"""Hashed places in documents, moved between tasks in packed blocks.

A place is (document, position) with one or two hashes. A task cuts its documents into
slices of bounded size and sends, per slice and bucket of the hash, one row with its
places delta-coded, at about six bytes a place instead of a row each. Spark shuffles
the blocks by bucket; the number of buckets follows the size of the input, so a bucket
stays a few million places. Answers go back the same way, in blocks by a hash of the document,
and are merged there into one row per document.

Documents are ordered by (did, tie): did is doc_id (a null last), tie a hash of the text
where doc_ids repeat or are null, else 0. Rows equal in both are one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import mix64

BLOCK_SCHEMA = "bucket int, kind int, ids binary, ties binary, per binary, pos binary, h binary, d binary, n binary"
BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("ids", "ties", "per", "pos", "h", "d", "n")])
ANSWER_SCHEMA = "did long, tie long, got array<struct<kind:int,pos:binary,n:binary,h:binary>>"
ANSWER_ARROW = pa.schema([("did", pa.int64()), ("tie", pa.int64()), ("got", pa.list_(pa.struct(
    [("kind", pa.int32()), ("pos", pa.binary()), ("n", pa.binary()), ("h", pa.binary())])))])
LAST_ID = (1 << 63) - 1


def keyed(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, list[str]]:
    """(id, did, tie, text) of every row, a null text being empty, and the columns that name a
    document. Readings that join on these columns share one exchange of the texts."""
    ids = docs.select(F.col(id_col).alias("i"))
    odd = ids.groupBy("i").count().filter(F.col("i").isNull() | (F.col("count") > 1)).limit(1).count() > 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    tie = F.xxhash64(text) if odd else F.lit(0).cast("long")
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("did"),
                     tie.alias("tie"), text.alias("text"))
    return df, ["did", "tie"] if odd else ["did"]


def bucket_count(places: int, per_bucket: int, spark) -> int:
    return max(int(spark.sparkContext.defaultParallelism), math.ceil(places / per_bucket))


# --- coding ------------------------------------------------------------------

def squeeze(x: np.ndarray) -> bytes:
    """Non-negative integers in 1, 2 or 4 bytes each, whichever is least in all; the
    largest value of that width stands for one listed at the end (8 bytes)."""
    x = np.asarray(x, np.int64)
    costs = {w: w * len(x) + 8 * int(np.count_nonzero(x >= (1 << 8 * w) - 1)) for w in (1, 2, 4)}
    w = min(costs, key=costs.get)
    top = (1 << 8 * w) - 1
    return bytes([w]) + len(x).to_bytes(8, "little") + np.minimum(x, top).astype(f"<u{w}").tobytes() + x[x >= top].astype("<i8").tobytes()


def expand(raw: bytes) -> np.ndarray:
    w, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.frombuffer(raw, f"<u{w}", n, 9).astype(np.int64)
    out[out == (1 << 8 * w) - 1] = np.frombuffer(raw, "<i8", offset=9 + w * n)
    return out


def gaps(pos: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of ascending positions; a group's first place (`first`) keeps its position."""
    g = np.empty(len(pos), np.int64)
    if len(pos):
        g[0] = pos[0]
        g[1:] = np.where(first[1:], pos[1:], pos[1:] - pos[:-1])
    return g


def ungap(g: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.cumsum(g)
    ends = np.cumsum(per)
    starts = ends - per
    base = np.where(starts > 0, total[np.maximum(starts, 1) - 1], 0)
    return total - np.repeat(base, per)


def blocks(kind: int, buckets: int, did, tie, doc, pos, h, d=None, n=None, route=None) -> list[dict]:
    """Rows of BLOCK_SCHEMA. did, tie: per document of the slice; doc, pos, h, d, n: per place,
    by document and position. Places go by `route` (h unless given)."""
    if not len(h):
        return []
    b = ((h if route is None else route) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, doc, pos, h = b[order], doc[order], pos[order], h[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    rows = []
    for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(b)]))):
        dd = doc[lo:hi]
        first = np.concatenate(([True], dd[1:] != dd[:-1]))
        at = np.flatnonzero(first)
        row = {"bucket": int(b[lo]), "kind": kind, "ids": did[dd[at]].tobytes(),
               "ties": tie[dd[at]].tobytes() if tie.any() else b"", "per": squeeze(np.diff(np.append(at, hi - lo))),
               "pos": squeeze(gaps(pos[lo:hi], first)), "h": h[lo:hi].tobytes(),
               "d": b"" if d is None else d[order[lo:hi]].tobytes(), "n": b"" if n is None else squeeze(n[order[lo:hi]])}
        rows.append(row)
    return rows


def forward(kind: int, buckets: int, did, tie, doc, pos, n=None) -> list[dict]:
    """One row that carries answers already known through the exchange."""
    if not len(doc):
        return []
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    at = np.flatnonzero(first)
    lead = did[doc[at]]
    return [{"bucket": int(lead[0] % buckets), "kind": kind, "ids": lead.tobytes(), "ties": tie[doc[at]].tobytes() if tie.any() else b"",
             "per": squeeze(np.diff(np.append(at, len(doc)))), "pos": squeeze(gaps(pos, first)), "h": b"", "d": b"",
             "n": b"" if n is None else squeeze(n)}]


def unblock(rows: list[dict], h_type=np.uint64, d_type=None):
    """did, tie, pos, h, d, n of all places of the rows."""
    did, tie, pos, h, d, n = [], [], [], [], [], []
    for r in rows:
        per = expand(r["per"])
        ids = np.frombuffer(r["ids"], np.int64)
        ties = np.frombuffer(r["ties"], np.int64) if r["ties"] else np.zeros(len(ids), np.int64)
        did.append(np.repeat(ids, per))
        tie.append(np.repeat(ties, per))
        pos.append(ungap(expand(r["pos"]), per))
        h.append(np.frombuffer(r["h"], h_type))
        d.append(np.frombuffer(r["d"], d_type) if d_type is not None else np.zeros(0, np.uint64))
        n.append(expand(r["n"]) if r["n"] else np.zeros(0, np.int64))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(did, np.int64), cat(tie, np.int64), cat(pos, np.int64), cat(h, h_type), cat(d, d_type or np.uint64), cat(n, np.int64)


def replies(kind: int, groups: int, did, tie, pos, n=None, h=None) -> list[dict]:
    """Rows of BLOCK_SCHEMA with answers, by a hash of the document."""
    if not len(did):
        return []
    order = np.lexsort((pos, tie, did))
    did, tie, pos = did[order], tie[order], pos[order]
    first = np.concatenate(([True], (did[1:] != did[:-1]) | (tie[1:] != tie[:-1])))
    at = np.flatnonzero(first)
    doc = np.cumsum(first) - 1
    route = mix64(did[at].view(np.uint64) ^ mix64(tie[at].view(np.uint64)))[doc]
    return blocks(kind, groups, did[at], tie[at], doc, pos, np.zeros(len(did), np.uint8) if h is None else h[order],
                  n=None if n is None else n[order], route=route)


def _merge(group: pa.Table) -> pa.Table:
    """One row per document with its answers by kind."""
    found: dict = {}
    for r in group.to_pylist():
        per = expand(r["per"])
        ids = np.frombuffer(r["ids"], np.int64).tolist()
        ties = np.frombuffer(r["ties"], np.int64).tolist() if r["ties"] else [0] * len(ids)
        pos, cut = ungap(expand(r["pos"]), per), np.cumsum(per)[:-1]
        n = np.split(expand(r["n"]), cut) if r["n"] else None
        width = len(r["h"]) // max(1, len(pos))
        h = np.split(np.frombuffer(r["h"], np.dtype(f"V{width}")), cut) if width > 1 else None
        for i, p in enumerate(np.split(pos, cut)):
            found.setdefault((ids[i], ties[i]), {}).setdefault(r["kind"], []).append((p, None if n is None else n[i], None if h is None else h[i]))
    out = []
    for (did, tie), kinds in found.items():
        got = []
        for kind, parts in kinds.items():
            pos = np.concatenate([p for p, _, _ in parts])
            order = np.argsort(pos, kind="stable")
            got.append({"kind": kind, "pos": squeeze(np.diff(pos[order], prepend=0)),
                        "n": squeeze(np.concatenate([x for _, x, _ in parts])[order]) if parts[0][1] is not None else b"",
                        "h": np.concatenate([x for _, _, x in parts])[order].tobytes() if parts[0][2] is not None else b""})
        out.append({"did": did, "tie": tie, "got": got})
    return pa.Table.from_pylist(out, schema=ANSWER_ARROW)


def runs(did, tie, pos):
    """Consecutive positions of a document as (did, tie, first, how many)."""
    if not len(did):
        return did, tie, pos, pos
    order = np.lexsort((pos, tie, did))
    did, tie, pos = did[order], tie[order], pos[order]
    new = np.concatenate(([True], (did[1:] != did[:-1]) | (tie[1:] != tie[:-1]) | (pos[1:] > pos[:-1] + 1)))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos)) - 1
    return did[at], tie[at], pos[at], pos[last] - pos[at] + 1


def places(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw))


def table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def with_answers(texts: DataFrame, replied: DataFrame, keys: list[str], how: str) -> DataFrame:
    """(id, did, tie, text, got): the texts with the list of their answers. The answers are the
    hashed side, so the texts are not sorted."""
    got = replied.groupBy("bucket").applyInArrow(_merge, ANSWER_SCHEMA).select(*keys, "got")
    return texts.join(got.hint("shuffle_hash"), keys, how).select("id", "did", "tie", "text", "got")


# --- earliest place of each hash ----------------------------------------------

def not_first(h, d, did, tie, pos) -> np.ndarray:
    """True where an equal (h, d) is found at an earlier place."""
    order = np.lexsort((pos, tie, did, d, h))
    new = np.ones(len(h), bool)
    hs, ds = h[order], d[order]
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    a, b = order, order[head]
    out = np.zeros(len(h), bool)
    out[order] = (did[a] != did[b]) | (tie[a] != tie[b]) | (pos[a] != pos[b])
    return out


# --- texts in tasks -----------------------------------------------------------

def text_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow text column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int):
    """Index ranges of documents with at most `limit` bytes together (or one document)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi
