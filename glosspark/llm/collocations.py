"""Phrase collocations counted in quotient filters.

1. Texts become shards: slices of a task whose words are numbered by the slice's own dictionary.
   A shard holds the numbers of its words in order (0 where a piece or text ends), and gives one
   row per dictionary entry with its count.
2. The entries add up to the vocabulary per language. Words below the least count can be in no
   candidate; the others get dense ids, and every shard the ids of its own entries (a join of
   dictionary entries, not of word occurrences). These ids follow the input in size and are never broadcast.
3. Each shard's n-grams of ids are packed, permuted and counted in counting quotient filters
   (`quotient.py`), a filter per bucket of the quotient. Tasks add up their shards, and a bucket's
   filters from all tasks are merged as sorted lists. A frequent n-gram is so one entry per task.
4. Counts that reach the least count are looked up for the parts of each phrase, scored exactly
   and ranked per language; the ranking is limited before its exchange.

Scores are floor(scale * a * a / (l * r)) in 38-digit decimals, exact up to counts of 10^16.

Defined cases: null text is empty, null language is `und` (and joins rows whose language is `und`);
a repeated row counts again; doc_id and other columns are not read; an empty table gives no rows.
Texts of any length are whole: a shard holds at least one text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosspark.llm import packed as P
from glosspark.llm import quotient as Q
from glosspark.llm.common import checkpointed, small_side
from glosspark.llm.words import LOWER, coded, ranked
from glosspark.operators.ordinals import with_ordinal

MIN_COUNT = 10
COVER_PERCENT = 50          # a phrase is dropped whose longer phrase has this share of its count
TOP = 2000
SCALE = 1_000_000
SLICE = 8 << 20             # bytes of text in a shard
ENTRIES = 1_000_000         # n-grams a task adds up before it sends filters
STRIDE = 1 << 18            # words of a shard whose n-grams are packed at a time
BUCKET_ENTRIES = 1_000_000  # n-grams in a bucket, at most about

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False

SHARDS = "shard long, lang string, word string, code int, n long, tokens binary"
_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("code", pa.int32()), ("n", pa.int64()), ("tokens", pa.binary())])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes: the upper ones, mostly zeros, compress on disk and in a shuffle."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _shard(batches):
    """Rows of SHARDS: a row with the tokens of each shard, a row per entry of its dictionary."""
    made = 0
    for batch in batches:
        raw, off = P.text_parts(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        lang, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
        for lo, hi in P.slices(off, SLICE):
            part = LOWER[raw[off[lo]:off[hi]]]
            code, s, e, doc, words = coded(part, off[lo:hi + 1] - off[lo], _INSIDE[part])
            if not len(code):
                continue
            entry, pairs = ranked(lang[lo:hi][doc], code)
            n = np.bincount(entry, minlength=len(pairs))
            breaks = np.flatnonzero(_BREAK[part])
            apart = (doc[1:] != doc[:-1]) | (np.searchsorted(breaks, s[1:]) > np.searchsorted(breaks, e[:-1]))
            tokens = np.insert(entry + 1, np.flatnonzero(apart) + 1, 0)
            shard = (TaskContext.get().partitionId() << 32) + made
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([len(pairs)], pa.int32()),
                                              pa.array([len(code)]), pa.array([planes(tokens)], pa.binary())], schema=_SHARDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), shard)), names.take(pa.array(pairs >> np.uint64(32))),
                 words.take(pa.array(pairs & np.uint64(0xFFFFFFFF))).cast(pa.binary()).cast(pa.string()), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(n),
                 pa.nulls(len(pairs), pa.binary())], schema=_SHARDS)


# --- n-grams of ids as keys ----------------------------------------------------

def halves(bits: int) -> int:
    return (3 * bits + 1) // 2


def pack(w1, w2, w3, bits: int):
    """Three ids of `bits` bits as two halves of a key."""
    half = halves(bits)
    u = np.uint64
    return (w1 << u(2 * bits - half)) | (w2 >> u(half - bits)), ((w2 & u((1 << (half - bits)) - 1)) << u(bits)) | w3


def unpack(left, right, bits: int):
    half = halves(bits)
    u = np.uint64
    w2 = ((left & u((1 << (2 * bits - half)) - 1)) << u(half - bits)) | (right >> u(bits))
    return left >> u(2 * bits - half), w2, right & u((1 << bits) - 1)


def _grams(tokens: np.ndarray, bits: int, starts: int | None = None):
    """Permuted keys of the pairs and triples of consecutive non-zero ids, of those only that begin at the first `starts` places."""
    a, b = tokens[:-1], tokens[1:]
    two = (a > 0) & (b > 0)
    three = two[:-1] & two[1:]
    if starts is not None:
        two, three = two.copy(), three.copy()
        two[starts:] = three[starts:] = False
    zero = np.zeros(int(two.sum()), np.uint64)
    pairs = pack(a[two], b[two], zero, bits)
    triples = pack(a[:-1][three], b[:-1][three], b[1:][three], bits)
    return Q.permute(np.concatenate((pairs[0], triples[0])), np.concatenate((pairs[1], triples[1])), halves(bits))


_FILTER = pa.schema([("bucket", pa.int32()), ("q", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in Q.COLUMNS[3:]])


def _filters(bits: int, bucket_bits: int):
    """Shards with the ids of their entries (packed as code << 32 | id) -> filters."""
    half = halves(bits)

    def sent(parts):
        left, right, counts = Q.tally(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_pylist(Q.encode(left, right, counts, half, bucket_bits), schema=_FILTER)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for tokens, entries, ids in zip(batch.column("tokens"), batch.column("entries"), batch.column("ids")):
                known = np.zeros(entries.as_py() + 1, np.uint64)
                pairs = ids.values.to_numpy(zero_copy_only=False)
                known[(pairs >> 32) + 1] = pairs & 0xFFFFFFFF
                codes = unplaned(tokens.as_buffer())
                for at in range(0, len(codes), STRIDE):
                    left, right = _grams(known[codes[at:at + STRIDE + 2]], bits, STRIDE)
                    if len(left):
                        parts.append(Q.tally(left, right))
                        held += len(parts[-1][0])
                    if held > ENTRIES:
                        yield sent(parts)
                        parts, held = [], 0
        if parts:
            yield sent(parts)
    return run


_COUNTED = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("f", pa.int64())])


def _counted(bits: int, bucket_bits: int, least: int):
    """All filters of a bucket -> n-grams (w3 is 0 in a pair) found `least` times or more."""
    half = halves(bits)

    def run(group: pa.Table) -> pa.Table:
        left, right, f = Q.merge(group.to_pylist(), half, bucket_bits)
        ok = f >= least
        ids = unpack(*Q.restore(left[ok], right[ok], half), bits)
        return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in (*ids, f[ok])], schema=_COUNTED)
    return run


def phrase_counts(docs: DataFrame, text_col="text", lang_col="lang", least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, grams, totals): words (id, lang, word, n) found `least` times or more in their
    language; grams (w1, w2, w3, f) of their ids, w3 being 0 in a pair, with f >= least; totals
    (lang, words) of all word occurrences."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = checkpointed(texts.mapInArrow(_shard, SHARDS), 2 * SLICE)
    entries = shards.filter("tokens is null")
    totals = checkpointed(entries.groupBy("lang").agg(F.sum("n").alias("words")))
    frequent = checkpointed(entries.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    words = checkpointed(with_ordinal(frequent, "ord").select((F.col("ord") + 1).alias("id"), "lang", "word", "n"))
    size, tokens = words.count(), shards.filter("tokens is not null").agg(F.sum("n")).first()[0] or 0
    if size >= 1 << 32:
        raise ValueError("more than 2^32 frequent words: raise the least count")
    bits = max(2, size.bit_length())
    buckets = max(int(spark.sparkContext.defaultParallelism), math.ceil(2 * tokens / BUCKET_ENTRIES))
    bucket_bits = min(halves(bits), (buckets - 1).bit_length())
    ids = (entries.join(small_side(words.drop("n")), ["lang", "word"])
           .groupBy("shard").agg(F.collect_list(F.shiftleft(F.col("code").cast("long"), 32).bitwiseOR(F.col("id"))).alias("ids")))
    numbered = shards.filter("tokens is not null").select("shard", "tokens", F.col("code").alias("entries")).join(checkpointed(ids).hint("shuffle_hash"), "shard")
    grams = (numbered.select("tokens", "entries", "ids").mapInArrow(_filters(bits, bucket_bits), Q.SCHEMA)
             .groupBy("bucket").applyInArrow(_counted(bits, bucket_bits, least), "w1 long, w2 long, w3 long, f long"))
    return words, checkpointed(grams), totals


def _cut(a, left, right, k: int):
    """Score, place of the cut and counts of both parts; the least of several is the first by score, then by place."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(38,0)"), wide(left) * wide(right)).cast("long")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, text_col="text", lang_col="lang", least: int = MIN_COUNT, cover: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three
    words by score, count and text. A phrase's score is that of its lowest-scoring cut into parts
    found l and r times; phrases that a longer one covers are left out."""
    words, grams, totals = phrase_counts(docs, text_col, lang_col, least)
    known = small_side(words)
    pairs = (grams.filter("w3 = 0").select("w1", "w2", "f")
             .join(known.select(F.col("id").alias("w1"), "lang", F.col("word").alias("x1"), F.col("n").alias("n1")), "w1")
             .join(known.select(F.col("id").alias("w2"), F.col("word").alias("x2"), F.col("n").alias("n2")), "w2"))
    pairs = checkpointed(pairs)
    first = small_side(pairs)
    triples = checkpointed(grams.filter("w3 > 0").join(first.withColumnRenamed("f", "f12"), ["w1", "w2"])
                           .join(first.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("x2").alias("x3"), F.col("n2").alias("n3"), F.col("f").alias("f23")), ["w2", "w3"]))
    longer = (triples.select("w1", "w2", "f").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
              .groupBy("w1", "w2").agg(F.max("f").alias("longer")))
    open_ = pairs.join(longer, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
    scored = (open_.select("lang", F.concat_ws(" ", "x1", "x2").alias("phrase"), F.col("f").alias("a"), _cut("f", "n1", "n2", 1).alias("c"))
              .unionByName(triples.select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), F.col("f").alias("a"),
                                          F.least(_cut("f", "n1", "f23", 1), _cut("f", "f12", "n3", 2)).alias("c"))))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked_ = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked_.join(small_side(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", F.col("words").alias("n"), "c.score")
