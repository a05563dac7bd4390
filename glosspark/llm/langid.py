"""Language identification: averaged hashed subword embeddings, linear softmax, rejection.

A text is the average of the embeddings of its hashed byte n-grams (`NGRAMS`, lower
case); a linear softmax over that average gives the languages. Both layers are trained
with stochastic gradient descent in numpy on a bounded sample of labelled rows (at most
`SAMPLE_DOCS`, about the same number per language, chosen by a hash of id and text; only
their hashed n-gram counts travel to the driver). A fifth of the sample calibrates the
scores (temperature) and sets the rejection threshold: at most `REJECT_SHARE` of those
documents, and never one with a score of `REJECT_MAX` or more, may fall below it.

For prediction embedding and output layer are multiplied into one table of logits per
bucket, so a text costs one gather per n-gram. Whole texts are read, in chunks.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; a
null label is never learned; without any labelled row everything is `und`; equal texts get
equal answers; other columns are kept, like-named ones are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.llm.common import by_rows, mix64, sharing

NGRAMS = (2, 3, 4)
BUCKET_BITS = 15
DIM = 16
SAMPLE_DOCS = 1600
EPOCHS = 6
RATE = 4.0
CHUNK = 1 << 20
REJECT_SHARE = 0.001
REJECT_MAX = 0.5
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def buckets(text: str):
    """Bucket numbers of all n-grams, chunk by chunk."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    over = max(NGRAMS) - 1
    for at in range(0, len(raw), CHUNK):
        seg = raw[at:at + CHUNK + over].astype(np.uint64)
        code = seg.copy()
        for n in range(2, max(NGRAMS) + 1):
            if len(seg) < n:
                break
            code = (code[:-1] << np.uint64(8)) | seg[n - 1:]
            if n in NGRAMS:
                last = min(CHUNK, len(code))     # starts of this chunk only
                yield (mix64(code[:last] + np.uint64(n << 40)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for ids in buckets(text):
        total += np.bincount(ids, minlength=1 << BUCKET_BITS)
    return total


class Model:
    def __init__(self, langs, logits, bias, temperature=1.0, threshold=0.0):
        self.langs, self.logits, self.bias = langs, logits, bias
        self.temperature, self.threshold = temperature, threshold

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for ids in buckets(text):
            total += self.logits[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.scores(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows, seed: int = 7) -> Model:
    """rows: (lang, bucket numbers, counts) of the labelled sample."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIM)) / DIM
    out = np.zeros((DIM, len(langs)))
    bias = np.zeros(len(langs))
    data = [(langs.index(lang), ids, c / max(c.sum(), 1)) for lang, ids, c in rows]
    order = rng.permutation(len(data))
    held = order[:len(data) // 5]
    train = order[len(data) // 5:]
    step, steps = 0, max(1, EPOCHS * len(train))
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            y, ids, share = data[i]
            rows_of = emb[ids]
            z = share @ rows_of
            g = _softmax(z @ out + bias)
            g[y] -= 1
            rate = RATE * (1 - step / steps)
            back = out @ g
            out -= rate * np.outer(z, g)
            bias -= 0.01 * rate * g
            emb[ids] = rows_of - rate * share[:, None] * back
            step += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    if len(held):
        z = np.stack([data[i][2] @ model.logits[data[i][1]] + bias for i in held])
        y = np.array([data[i][0] for i in held])
        grid = np.geomspace(0.25, 20, 45)      # not below: a sample that separates would make every score 1
        losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        top = _softmax(z / model.temperature).max(axis=1)
        model.threshold = float(min(REJECT_MAX, np.quantile(top, REJECT_SHARE, method="lower")))
    return model


def train(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_docs=SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of `labelled` rows."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id")) \
        .filter("lang is not null and text is not null")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not per_lang:
        return fit([])
    quota = sample_docs / len(per_lang)
    u = (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * quota / n))) for k, n in per_lang.items()])
    chosen = rows.withColumn("_u", u).withColumn("_share", share).filter("_u < _share")
    # in units of its language's share, so that a cut leaves about as many of each
    chosen = chosen.withColumn("_u", F.col("_u") / F.col("_share"))

    def sparse(batches):
        for pdf in batches:
            got = [counts(t) for t in pdf["text"]]
            ids = [np.flatnonzero(c) for c in got]
            yield pd.DataFrame({"lang": pdf["lang"], "_u": pdf["_u"], "ids": [i.astype(np.uint16).tobytes() for i in ids],
                                "n": [c[i].astype(np.float32).tobytes() for c, i in zip(got, ids)]})

    sample = (chosen.select("lang", "text", "_u").mapInPandas(sparse, "lang string, _u double, ids binary, n binary")
              .orderBy("_u", "lang", "n").limit(sample_docs).collect())
    return fit([(r["lang"], np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.float32).astype(float))
                for r in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected."""
    shared = sharing(docs.sparkSession, model)
    base = docs.drop("lang_pred", "score", "rejected")
    names = base.columns
    schema = T.StructType(base.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                                T.StructField("rejected", T.BooleanType())])

    def run(batches):
        m = shared()
        for batch in by_rows(batches):
            got = [m.predict(t.as_py()) for t in batch.column(names.index(text_col))]
            add = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                   pa.array([g[0] == UNKNOWN or g[1] < m.threshold for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + add, names=names + ["lang_pred", "score", "rejected"])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
