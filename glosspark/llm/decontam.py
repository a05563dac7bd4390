"""Benchmark decontamination with a Wu-Manber search over words.

Test strings are windows of `WINDOW` consecutive words of an item (a shorter item
is one string). Words are numbers of the items' vocabulary.
For each length the search keeps a shift table over hashed blocks of two words (how far the
window may move; blocks that share an entry take the smaller shift), buckets of test strings
by their last block, ordered inside by a hash of the whole string, and compares candidates word
by word. A text is searched from many places at once, each going on by its own shifts.

The strings of a benchmark are broadcast in blocks of at most `BLOCK_BYTES` of
item text; a larger benchmark takes several passes over the documents, each
adding to the hits of the last one, so memory stays bounded. A test string is a place in
the items' word numbers, so tables take below 20 bytes for a byte of benchmark text.

Defined cases: null texts have no words and an item without words no window; a
word run inside several overlapping occurrences counts once; windows shared by
items count for each of them; repeated item_ids count once, a null item_id is
left out of the list but its windows still hit; repeated documents are treated
alike; an empty benchmark hits nothing; other columns are kept, but for those that the
result itself has and `_hit`, `_items`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.llm.common import by_rows, checkpointed, mix64, sharing
from glosspark.llm.packed import slices, text_parts
from glosspark.llm.words import coded

WINDOW = 10
BLOCK_BYTES = 8 << 20
SLICE = 4 << 20             # bytes of text searched at a time (or one text)
STRETCH = 256               # ends of windows that one cursor covers

#: bytes: A-Z to a-z, other ASCII but digits and letters to a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Code and text index of every word, and the distinct words."""
    folded = np.frombuffer(_FOLD, np.uint8)[raw]
    code, _, _, doc, distinct = coded(folded, offsets, folded != 32)
    return code, doc, distinct


def _block(words: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the last `width` (1 or 2) words before `end`."""
    key = words[end - 1].astype(np.uint64)
    return mix64(key | words[end - 2].astype(np.uint64) << np.uint64(32) if width == 2 else key)


class WuManber:
    """Search for test strings of one length: words[start:start + length] for every start, each
    belonging to an item."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        m, self.m = length, length
        self.words, self.block = words, min(2, length)
        same, first, of = np.unique(words[starts[:, None] + np.arange(m)], axis=0, return_index=True, return_inverse=True)
        at, of = starts[first], of.ravel()
        del same
        self.bits = np.uint64(64 - max(8, int(2 * len(starts)).bit_length()))
        self.far = m - self.block + 1
        self.shift = np.full(1 << (64 - int(self.bits)), self.far, np.min_scalar_type(self.far))
        for end in range(self.block, m + 1):                    # shifts fall, so the least stays
            self.shift[_block(words, at + end, self.block) >> self.bits] = m - end
        key = self._bucketed(words, at + m)
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], at[order].astype(np.int32)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack((rank[of], items), 1), axis=0)
        self.items = pairs[:, 1].astype(np.int32)
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)).astype(np.int32)

    def _bucketed(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bucket of the last block, then a hash of the whole string before `end`."""
        whole = np.zeros(len(end), np.uint64)
        for k in range(self.m, 0, -1):
            whole = mix64(whole + words[end - k].astype(np.uint64) + np.uint64(1))
        slot = _block(words, end, self.block) >> self.bits
        return slot << self.bits | whole >> (np.uint64(64) - self.bits)

    def search(self, words: np.ndarray, head: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, string) of every occurrence in texts of `number` words from `head` on. Words
        that no string has are -1."""
        m, none = self.m, np.zeros(0, np.int64)
        room = np.maximum(number - m + 1, 0)
        parts = -(-room // STRETCH)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(head + m, parts) + k * STRETCH
        stop = np.minimum(end + STRETCH, np.repeat(head + number + 1, parts))
        possible = []
        while len(end):
            d = self.shift[_block(words, end, self.block) >> self.bits].astype(np.int64)
            unknown = words[end - 1] < 0
            if self.block == 2:
                unknown |= words[end - 2] < 0
            d[unknown] = self.far
            possible.append(end[d == 0])
            end = end + np.maximum(d, 1)
            live = end < stop
            end, stop = end[live], stop[live]
        end = np.concatenate(possible) if possible else none
        key = self._bucketed(words, end)
        lo, hi = (np.searchsorted(self.key, key, side) for side in ("left", "right"))
        ends, strings = [none], [none]
        while len(end):                                         # strings of one key, nearly always one
            some = lo < hi
            end, lo, hi = end[some], lo[some], hi[some]
            same = np.ones(len(end), bool)
            for k in range(m):
                same &= words[end - m + k] == self.words[self.at[lo] + k]
            ends.append(end[same])
            strings.append(lo[same])
            lo = lo + 1
        return np.concatenate(ends), np.concatenate(strings)


class Searches:
    """Test strings of every length from (item_id, text) rows."""

    def __init__(self, rows, window: int = WINDOW):
        rows = [(i, t) for i, t in rows if t]
        self.names = list(dict.fromkeys(i for i, _ in rows))
        number = {i: k for k, i in enumerate(self.names)}
        raw, off = text_parts(pa.array([t for _, t in rows], pa.large_string()))
        code, doc, distinct = _words(raw, off)
        self.known, words = distinct, code.astype(np.int32)
        size = np.bincount(doc, minlength=len(rows))
        head = np.cumsum(size) - size
        item = np.array([number[i] for i, _ in rows], np.int64)
        self.by_length = []
        for m in np.unique(np.minimum(size[size > 0], window)):
            pick = np.flatnonzero(np.minimum(size, window) == m)
            n = size[pick] - m + 1
            starts = np.repeat(head[pick], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.by_length.append(WuManber(words, starts, np.repeat(item[pick], n), int(m)))

    def find(self, raw: np.ndarray, offsets: np.ndarray):
        """Of the texts raw[offsets[i]:offsets[i+1]]: the first word and the number of words, whether
        each word is hit, and the distinct (text, item) pairs."""
        code, doc, distinct = _words(raw, offsets)
        number = np.bincount(doc, minlength=len(offsets) - 1)
        head = np.cumsum(number) - number
        number_of = pc.fill_null(pc.index_in(distinct, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        words = number_of[code]
        change = np.zeros(len(words) + 1, np.int32)
        pairs = []
        for s in self.by_length:
            end, string = s.search(words, head, number)
            np.add.at(change, end - s.m, 1)
            np.subtract.at(change, end, 1)
            met = np.unique(np.stack((doc[end - 1], string), 1), axis=0) if len(end) else np.zeros((0, 2), np.int64)
            a, n = s.item_from[met[:, 1]], s.item_from[met[:, 1] + 1] - s.item_from[met[:, 1]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.unique(np.stack((np.repeat(met[:, 0], n), s.items[np.repeat(a, n) + step].astype(np.int64)), 1), axis=0))
        return head, number, np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)

    def search(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Marks the hit words of one text and adds its items."""
        raw = np.frombuffer(b" ".join(words), np.uint8)
        _, _, got, pairs = self.find(raw, np.array([0, len(raw)]))
        for k in np.flatnonzero(got):
            hit[k] = 1
        items.update(self.names[i] for i in pairs[:, 1])


def tables(rows, window: int = WINDOW) -> list[Searches]:
    """Search tables from (item_id, text) rows."""
    return [Searches(rows, window)]


def _pass(docs: DataFrame, shared, text_col: str) -> DataFrame:
    """One block of the benchmark: adds to `_hit` (a byte per word) and `_items`."""
    schema = T.StructType(docs.schema.fields)
    at = docs.columns.index

    def run(batches):
        searches = shared()
        for batch in by_rows(batches):
            cols = list(batch.columns)
            raw, off = text_parts(pc.fill_null(cols[at(text_col)], ""))
            hits, items = cols[at("_hit")], cols[at("_items")]
            out_hits, out_items = [], []
            for lo, hi in slices(off, SLICE):
                head, number, hit, pairs = searches.find(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                edge = np.searchsorted(pairs[:, 0], np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    got, old = hit[head[k]:head[k] + number[k]], hits[lo + k].as_py()
                    out_hits.append((got if old is None else got | (np.frombuffer(old, np.uint8) > 0)).astype(np.uint8).tobytes())
                    found = {searches.names[i] for i in pairs[edge[k]:edge[k + 1], 1]} - {None}
                    out_items.append(sorted(found.union(items[lo + k].as_py() or ())))
            cols[at("_hit")] = pa.array(out_hits, batch.schema.field("_hit").type)
            cols[at("_items")] = pa.array(out_items, batch.schema.field("_items").type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    spark = docs.sparkSession
    ask = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = ask.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs.drop("_hit", "_items", "n_words", "n_hit", "n_items", "items", "contaminated") \
        .withColumns({"_hit": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>")})
    for k in range(blocks):
        part = ask if blocks == 1 else ask.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = Searches([tuple(r) for r in part.collect()], window)   # at most about block_bytes of text
        out = _pass(out, sharing(spark, found), text_col)
        if k < blocks - 1:
            out = checkpointed(out)
    n = F.octet_length("_hit").cast("long")
    clean = F.octet_length(F.translate(F.decode("_hit", "UTF-8"), "\u0001", "")).cast("long")
    return out.withColumns({
        "n_words": n, "n_hit": n - clean, "n_items": F.size("_items").cast("long"),
        "items": F.col("_items"), "contaminated": n > clean,
    }).drop("_hit", "_items")
