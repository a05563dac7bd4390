"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted per slice of a task and added up. The vocabulary goes into blocked Bloom
filters, one per word length, of at most `FILTER_BYTES` together; they are broadcast. Every word
probes the filters with its edits: all deletions (into the filter of the length below) and all
replacements by a later letter (into that of its own length). An insertion is the deletion
of the other word and a replacement by an earlier letter the other word's by a later one, so every
near pair is probed from exactly one side. Only probes that a filter accepts are shuffled, to a join with the
vocabulary itself, which removes the false ones. Where the vocabulary outgrows `FILTER_BYTES` the filters
accept more, and the join grows, but the result stays the same.

A word's hash is the sum of a hash per (place, letter), so an edit's hash follows from prefix and
suffix sums without building the edited word; only accepted edits are built.

Forms point to words at least `factor` times as frequent, so following them ends after
log(largest count) / log(factor) steps, which are halved by pointer jumping.

Defined cases: null text has no words; a null doc_id is an empty string where it is hashed; rows that
are repeated count again; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm import packed as P
from glosspark.llm.common import checkpointed, mix64, sharing, small_side
from glosspark.llm.words import LOWER, coded, ranked

MIN_LETTERS, MIN_COUNT = 6, 5
FACTOR = 5                  # a form is this many times as frequent
EVERY = 199                 # one occurrence in so many (by its hash) loses a letter
SLICE = 4 << 20             # bytes of text a task handles at a time
FILTER_BYTES = 32 << 20     # of all filters together, at most
WORD_BITS = 16              # of filter per word, where they fit
SEGMENT = 8192              # 64-bit blocks that one task fills
PROBES = 1 << 21            # edits hashed at a time

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: Letters of the words: a-z and U+00C0-U+00FF.
LETTERS = np.concatenate((np.arange(97, 123), np.arange(0xC0, 0x100))).astype(np.uint64)


def _inside(raw: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0-U+00FF, which are those that UTF-8 starts with the byte C3."""
    lead = raw == 0xC3
    out = _ASCII_LETTER[raw] | lead
    out[1:] |= lead[:-1]
    return out


def _dropped(word: bytes, h: int) -> str:
    letters = word.decode()
    k = h % len(letters)
    return letters[:k] + letters[k + 1:]


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counts(least: int):
    """(id string, text) -> (word, n): words of at least `least` letters of each slice, those
    whose hash says so without one letter."""
    def run(batches):
        for batch in batches:
            raw, off = P.text_parts(batch.column("text"))
            ids = [zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()]
            for lo, hi in P.slices(off, SLICE):
                part = LOWER[raw[off[lo]:off[hi]]]
                code, _, _, doc, words = coded(part, off[lo:hi + 1] - off[lo], _inside(part))
                if not len(code):
                    continue
                text = words.cast(pa.large_string())
                long = pc.utf8_length(text).to_numpy() >= least
                some = long[code]
                entry, pairs = ranked(doc[some], code[some])
                n = np.bincount(entry, minlength=len(pairs))
                of, at = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), (pairs >> np.uint64(32)).astype(np.int64)
                spelled, crc = words.to_pylist(), zlib.crc32
                h = np.fromiter((crc(spelled[w], ids[lo + d]) for w, d in zip(of.tolist(), at.tolist())), np.uint32, len(of))
                hit = h % EVERY == 0
                left = np.bincount(of[~hit], n[~hit], len(words)).astype(np.int64)
                stay = np.flatnonzero(left)
                yield pa.RecordBatch.from_arrays([text.take(pa.array(stay)).cast(pa.string()), pa.array(left[stay])], schema=_COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array([_dropped(spelled[w], int(x)) for w, x in zip(of[hit], h[hit])], pa.string()), pa.array(n[hit])], schema=_COUNTS)
    return run


# --- blocked Bloom filters -----------------------------------------------------

_PLACE, _LETTER = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def place_hash(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix64(place.astype(np.uint64) * _PLACE + letter.astype(np.uint64) * _LETTER + np.uint64(1))


def by_length(words: list[str]):
    """(length, indexes, matrix of code points) for each length among the words."""
    size = np.array([len(w) for w in words], np.int64)
    for m in np.unique(size):
        at = np.flatnonzero(size == m)
        cells = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), m).astype(np.uint64)
        yield int(m), at, cells


def places_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and the bits it sets there."""
    x = mix64(h)
    one = np.uint64(1)
    mask = one << (x & np.uint64(63))
    for k in (6, 12, 18):
        mask |= one << ((x >> np.uint64(k)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mask


def _hashed(sizes: dict):
    """Words -> their hashes, by length and segment of the filter."""
    schema = pa.schema([("length", pa.int32()), ("segment", pa.int32()), ("h", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for m, _, cells in by_length(batch.column("word").to_pylist()):
                h = place_hash(np.arange(m)[None, :], cells).sum(axis=1, dtype=np.uint64)
                seg = places_of(h, sizes[m])[0] // SEGMENT
                order = np.argsort(seg, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(seg[order])) + 1):
                    rows.append({"length": m, "segment": int(seg[part[0]]), "h": h[part].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def _filled(sizes: dict):
    """Hashes of one segment -> its bits."""
    def run(group: pa.Table) -> pa.Table:
        m, segment = group.column("length")[0].as_py(), group.column("segment")[0].as_py()
        block, mask = places_of(np.frombuffer(b"".join(group.column("h").to_pylist()), np.uint64), sizes[m])
        bits = np.zeros(min(SEGMENT, sizes[m] - segment * SEGMENT), np.uint64)
        np.bitwise_or.at(bits, block - segment * SEGMENT, mask)
        return pa.table({"length": pa.array([m], pa.int32()), "segment": pa.array([segment], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})
    return run


def bloom_filters(vocab: DataFrame) -> dict[int, np.ndarray]:
    """Length -> the 64-bit blocks of the filter of all words of that length."""
    per = {r["m"]: r["c"] for r in vocab.groupBy(F.length("word").alias("m")).agg(F.count(F.lit(1)).alias("c")).collect()}
    share = min(1.0, 8 * FILTER_BYTES / max(1, WORD_BITS * sum(per.values())))
    sizes = {m: max(1, int(c * WORD_BITS * share) // 64) for m, c in per.items()}
    out = {m: np.zeros(n, np.uint64) for m, n in sizes.items()}
    made = (vocab.select("word").mapInArrow(_hashed(sizes), "length int, segment int, h binary")
            .groupBy("length", "segment").applyInArrow(_filled(sizes), "length int, segment int, bits binary"))
    for r in made.toLocalIterator():
        at = r["segment"] * SEGMENT
        bits = np.frombuffer(bytes(r["bits"]), np.uint64)
        out[r["length"]][at:at + len(bits)] = bits
    return out


def _accepted(filters: dict, m: int, h: np.ndarray) -> np.ndarray:
    if m not in filters:
        return np.zeros(h.shape, bool)
    block, mask = places_of(h, len(filters[m]))
    return filters[m][block] & mask == mask


def edits(cells: np.ndarray, filters: dict):
    """(row, edited word) of the deletions and later-letter replacements that the filters accept."""
    n, m = cells.shape
    own = place_hash(np.arange(m)[None, :], cells)
    whole = own.sum(axis=1, dtype=np.uint64)
    before = np.cumsum(own, axis=1, dtype=np.uint64) - own
    moved = np.zeros((n, m), np.uint64)                 # hash of what follows a place, one place earlier
    moved[:, :-1] = place_hash(np.arange(m - 1)[None, :], cells[:, 1:])
    after = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    first = np.ones((n, m), bool)                       # equal letters in a row give one deletion
    first[:, 1:] = cells[:, 1:] != cells[:, :-1]
    rows, at = np.nonzero(_accepted(filters, m - 1, before + after) & first)
    for r, i in zip(rows.tolist(), at.tolist()):
        yield r, np.delete(cells[r], i)
    step = max(1, PROBES // max(1, n * len(LETTERS)))
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        put = place_hash(np.arange(lo, hi)[:, None], LETTERS[None, :])[None]
        h = (whole[:, None] - own[:, lo:hi])[:, :, None] + put
        ok = _accepted(filters, m, h) & (LETTERS[None, None, :] > cells[:, lo:hi, None])
        for r, i, k in zip(*(x.tolist() for x in np.nonzero(ok))):
            word = cells[r].copy()
            word[lo + i] = LETTERS[k]
            yield r, word


def _probe(share):
    """(word, n) -> (edit, word, n) for the edits that the filters accept."""
    schema = pa.schema([("edit", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        filters = share()
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            edit, of = [], []
            for m, at, cells in by_length(words):
                rows = max(1, PROBES // (m * len(LETTERS)))
                for lo in range(0, len(at), rows):
                    for r, word in edits(cells[lo:lo + rows], filters):
                        edit.append(word.astype("<u4").tobytes().decode("utf-32-le"))
                        of.append(int(at[lo + r]))
            yield pa.RecordBatch.from_arrays([pa.array(edit, pa.string()), pa.array([words[i] for i in of], pa.string()), pa.array([n[i] for i in of], pa.int64())], schema=schema)
    return run


def vocabulary(docs: DataFrame, id_col="doc_id", text_col="text", letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of `letters` code points or more that are found `least` times or more."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_counts(letters), "word string, n long").filter(F.length("word") >= letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, other, m): every pair of words one edit apart, in both directions, with their counts."""
    share = sharing(vocab.sparkSession, bloom_filters(vocab))
    found = (vocab.mapInArrow(_probe(share), "edit string, word string, n long")
             .join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("m")), "edit").select("word", "n", F.col("edit").alias("other"), "m"))
    return found.select(F.explode(F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))).alias("p")).select("p.*")


def spelling_groups(vocab: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `vocab` (word, n; one row a word)."""
    vocab = checkpointed(vocab)
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    near = vocab.join(best, "word", "left")
    big = -F.col("best.less") >= F.lit(factor) * F.col("n")
    words = checkpointed(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(big, F.col("best.other")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")))
    to = checkpointed(words.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:                                         # root of the root, until none is further on
        further = small_side(to).select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        to = jumped.select("word", "root")
        if jumped.filter("moved").limit(1).count() == 0:
            break
    return words.join(small_side(to), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
