"""Scoring pairs of very long texts over many tasks.

`score_pairs` scores a pair inside its row, which suits lines. Here a pair's tokens are cut into chunks that
are dealt over the cluster; n-grams are counted per (pair, order, n-gram) with partial aggregates, and both
sides meet in the count itself, so neither a long pair nor a frequent n-gram is one task's work. Word edit
distance and longest common subsequence run in blocks of bounded memory (`blocked.py`).

Defined cases: a null text is an empty one; an empty reference has a word error rate of 1; rows with equal ids
count as one pair of both texts together, so ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.functions.text import words
from glosspark.operators.joins import checked_broadcast
from glosspark.operators.metrics.blocked import with_distances
from glosspark.operators.metrics.counts import bleu_counts, rouge_counts
from glosspark.operators.metrics.pairwise import METRIC_COLUMNS, ORDERS, _f1, rouge_tokens, score_pairs, smoothed_bleu
from glosspark.operators.metrics.tokens import safe_div

CHUNK = 2048
LONG_CHARS = 1 << 15         # pairs with more characters on a side than this have their n-grams counted over many tasks
LONG_WORDS = 4096            # pairs with more words on a side than this are scored over many tasks


def _texts(df: DataFrame, id_col: str, prediction: str, reference: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text(prediction).alias("p"), text(reference).alias("r"))


def gram_matches(sides: DataFrame, orders=ORDERS, chunk: int = CHUNK) -> DataFrame:
    """sides (id, side, tokens), side 0 a prediction and 1 a reference -> (id, n, m, hn, rn): clipped matches and
    n-grams of each side per order. Tokens must not hold a line feed."""
    top = max(orders)
    chunks = sides.filter(F.size("tokens") > 0).select(
        "id", "side", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / chunk))).alias("at"))
    chunks = chunks.select("id", "side", "at", F.slice("tokens", (F.col("at") * chunk + 1).cast("int"), chunk + top - 1).alias("part"))
    chunks = chunks.repartition("id", "side", "at")

    def grams(n):
        starts = F.sequence(F.lit(1), F.least(F.lit(chunk), F.size("part") - n + 1))
        made = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("part", i, n), "\n").alias("gram")))
        return F.when(F.size("part") >= n, made).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))
    rows = chunks.select("id", "side", F.explode(F.concat(*map(grams, orders))).alias("g")).select("id", "side", "g.n", "g.gram")
    counted = rows.groupBy("id", "n", "gram").agg(F.sum(1 - F.col("side")).alias("h"), F.sum("side").alias("r"))
    return counted.groupBy("id", "n").agg(F.sum(F.least("h", "r")).alias("m"), F.sum("h").alias("hn"), F.sum("r").alias("rn"))


def _wide(matches: DataFrame, name: str, orders) -> DataFrame:
    at = lambda n, c: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    return matches.groupBy("id").agg(*[at(n, c).alias(f"{name}{c}{n}") for n in orders for c in ("m", "hn", "rn")])


def count_scores(df: DataFrame, id_col: str = "id", prediction: str = "prediction", reference: str = "reference", rounding: int | None = 6,
                 long_chars: int = LONG_CHARS) -> DataFrame:
    """(id, bleu_1..4, rouge1_f, rouge2_f) of every pair. Pairs of up to `long_chars` characters a side are counted in their rows; only the
    n-grams of longer ones, and of rows that share their id or have none, are counted over many tasks, so the shuffle holds those alone."""
    t = _texts(df, id_col, prediction, reference)
    shared = t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null").select("id", F.lit(True).alias("_shared"))
    t = t.join(checked_broadcast(shared), "id", "left")
    wide = F.greatest(F.length("p"), F.length("r")) > long_chars
    t = t.select("id", "p", "r", (wide | F.col("_shared").isNotNull() | F.col("id").isNull()).alias("_long"))
    short = t.filter(~F.col("_long")).select("id", bleu_counts("p", "r").alias("b"), rouge_counts(F.lower("p"), F.lower("r")).alias("x"))
    names = lambda side, n: [F.greatest(F.col(f"{side}.{s}") - n + 1, F.lit(0)).cast("long") for s in (("hl", "rl") if side == "b" else ("hn", "rn"))]
    flat = []
    for side, orders in (("b", ORDERS), ("x", (1, 2))):
        for n in orders:
            h, r = names(side, n)
            flat += [F.col(f"{side}.m{n}").cast("long").alias(f"{side}m{n}"), h.alias(f"{side}hn{n}"), r.alias(f"{side}rn{n}")]
    j = short.select("id", *flat).unionByName(_shuffled_counts(t.filter("_long").drop("_long")))
    st = F.struct(*[v for n in ORDERS for v in (F.col(f"bm{n}").alias(f"m{n}"), F.greatest(F.col(f"bhn{n}"), F.lit(1)).alias(f"d{n}"))],
                  F.col("bhn1").alias("hl"), F.col("brn1").alias("rl"))
    out = {f"bleu_{k}": smoothed_bleu(st, k) for k in ORDERS}
    out |= {f"rouge{n}_f": _f1(F.col(f"xm{n}"), F.col(f"xhn{n}"), F.col(f"xrn{n}")) for n in (1, 2)}
    return j.select(F.col("id").alias(id_col), *[(F.round(v, rounding) if rounding is not None else v).alias(k) for k, v in out.items()])


def _shuffled_counts(t: DataFrame) -> DataFrame:
    """(id, p, r) -> matches and totals of every order, n-grams counted per (id, order, n-gram) over the cluster."""
    def sides(tok):
        return t.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), tok(F.col("p")).alias("tokens")),
                                                F.struct(F.lit(1).alias("side"), tok(F.col("r")).alias("tokens")))).alias("s")).select("id", "s.*")
    b = _wide(gram_matches(sides(words)), "b", ORDERS)
    x = _wide(gram_matches(sides(rouge_tokens), (1, 2)), "x", (1, 2))
    return t.select("id").join(b, "id", "left").join(x, "id", "left").na.fill(0)


def distance_scores(df: DataFrame, id_col: str = "id", prediction: str = "prediction", reference: str = "reference", rounding: int | None = 6) -> DataFrame:
    """(id, wer, rougeL_f) of every pair in bounded memory."""
    t = _texts(df, id_col, prediction, reference)
    t = t.select("id", words(F.col("p")).alias("h"), words(F.col("r")).alias("r"), rouge_tokens(F.col("p")).alias("xh"), rouge_tokens(F.col("r")).alias("xr"))
    d = with_distances(t, "h", "r", "xh", "xr")
    p, r = safe_div(F.col("lcs"), F.size("xh")), safe_div(F.col("lcs"), F.size("xr"))
    out = {"wer": F.when(F.size("r") == 0, F.lit(1.0)).otherwise(F.col("lev").cast("double") / F.size("r")),
           "rougeL_f": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}
    return d.select(F.col("id").alias(id_col), *[(F.round(v, rounding) if rounding is not None else v).alias(k) for k, v in out.items()])


def score_any(df: DataFrame, id_col: str = "id", prediction: str = "prediction", reference: str = "reference", long_words: int = LONG_WORDS) -> DataFrame:
    """(id and METRIC_COLUMNS) of pairs of every length: lines in their rows, pairs of more than `long_words` words on a side over many tasks."""
    from glosspark.operators.metrics.staged import meteor_staged
    size = F.greatest(*[F.size(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)\s+")) for c in (prediction, reference)])
    pairs = df.select(F.col(id_col), prediction, reference, size.alias("_size"))
    short, long = pairs.filter(F.col("_size") <= long_words).drop("_size"), pairs.filter(F.col("_size") > long_words).drop("_size")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (prediction, reference)}
    rows = score_pairs(short.withColumns(text), prediction, reference).select(id_col, *METRIC_COLUMNS)
    wide = (count_scores(long, id_col, prediction, reference).join(distance_scores(long, id_col, prediction, reference), id_col)
            .join(meteor_staged(long, id_col, prediction, reference).withColumnRenamed("meteor_exact", "meteor"), id_col))
    return rows.unionByName(wide.select(id_col, *METRIC_COLUMNS))
