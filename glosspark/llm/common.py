"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import pickle
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.words import coded, digests

#: Java-regex word of the contracts: a run of anything but space and \\t..\\r.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when its measured size is below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of the Arrow batches that tasks exchange with Python, about (one row at least).
ARROW_BYTES = 4 << 20
#: Rows of texts that a task works on and hands back at a time.
BATCH_ROWS = 512


def documents(spark, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*cols) if cols else df


def small_batches(spark, size: int = ARROW_BYTES) -> None:
    """Arrow batches of this session hold `size` bytes, not Spark's 64 MB: each is held by the executor and, once more, by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


@contextlib.contextmanager
def _with_small_batches(spark, size: int):
    """small_batches for what is run inside; the session's own value is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    small_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def checkpointed(df: DataFrame, batch_bytes: int = ARROW_BYTES) -> DataFrame:
    """Write `df` once as Parquet to the shared checkpoint folder and go on from there; Arrow batches hold about `batch_bytes`.

    Unlike checkpoint(), which hands on the size estimate of its plan, a table read back has its
    real size: in a loop of joins the estimates multiply until the number itself fills the
    driver. The table is deleted when the application ends."""
    from glosspark.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/glosspark-{uuid.uuid4().hex}"
    with _with_small_batches(spark, batch_bytes):
        df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_60(*parts: Column) -> Column:
    """60-bit hash of ':'-joined parts, reproducible in other SQL engines (null: U+0000)."""
    s = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 15), 16, 10).cast("long")


def sharing(spark, value):
    """A function that gives tasks `value`, broadcast with its classes, so that executors need no
    copy of this package. For values of bounded size."""
    raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(raw.value)


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a size check; a larger side stays a shuffle join.

    `df` should be checkpointed: it is read once more here."""
    width = F.lit(16 * len(df.columns))
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif t in ("array<bigint>", "array<int>", "array<double>"):
            width = width + 8 * F.coalesce(F.size(c), F.lit(0))
        elif "<" in t:
            width = width + 4 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n = df.agg(F.sum(width.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def by_rows(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut into ones of at most `rows` rows, so that what a task builds from whole
    texts, and sends back, is small however large the batches are that it gets."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# --- numpy pieces used inside tasks -----------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Polynomial hashes of byte ranges: with S = prefix sums of (byte + 1) * base^i, the hash
    of [s, e) is (S[e] - S[s]) / base^s, modulo 2^64, mixed with the length."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, self.base, np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, self.inverse, np.uint64))), dtype=np.uint64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self._reach(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:len(raw)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((prefix[e] - prefix[s]) * self.down[s] + (e - s).astype(np.uint64) * _M2)


FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray, both: bool = False):
    """Hash, document index and position of every word of the texts raw[offsets[i]:offsets[i+1]],
    and the number of words of each text. Words do not cross texts. The hashes come from BLAKE2b of
    each distinct word; with `both`, the first result is a pair of independent hashes."""
    code, s, _, doc, distinct = coded(raw, offsets, ~_BLANK[raw])
    two = digests(distinct)
    head = np.searchsorted(s, offsets[:-1], "left")
    h = (two[code, 0], two[code, 1]) if both else two[code, 0]
    return h, doc, np.arange(len(s)) - head[doc], np.diff(np.append(head, len(s)))


def rolling(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every `size` consecutive values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base)
    for i in range(size):
        out *= b
        out += h[i:i + n]
    return mix64(out)
