"""Counted pairs, in-row vocabularies and long pairs: equal to plain loops, without the shuffles of before."""

import random
from collections import Counter

from pyspark.sql import functions as F

from glosspark.operators import vocab as V
from glosspark.operators.metrics import counts as C
from glosspark.operators.metrics import long_pairs, pairwise, staged


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_counts_of_random_pairs():
    rng = random.Random(5)
    for _ in range(400):
        h, r = ([rng.choice("abcdef") for _ in range(rng.choice((0, 1, 3, 9, 70)))] for _ in range(2))
        if rng.random() < 0.2:
            r = h[:]
        assert C.edit_distance(h, r) == _edit(h, r) and C.common_length(h, r) == _common(h, r)
        grams = [[Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (h, r)] for n in (1, 2, 3, 4)]
        assert C.matches(h, r, 4) == [sum((a & b).values()) for a, b in grams]


def test_words_are_cut_as_by_the_column_function(spark):
    texts = [" a  b", "", "x\x1cy z", "p q r　", "​s \x85t", "u\x1f v"]
    from glosspark.functions.text import words
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words("t").alias("w")).collect()
    assert [C.split_words(r.t) for r in rows] == [r.w for r in rows]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_count_in_batches(spark):
    df = spark.createDataFrame([("1", "a b", "a b c")], "id string, prediction string, reference string")
    plan = _plan(pairwise.score_pairs(df))
    assert "array_intersect" not in plan and "ArrowEvalPython" in plan
    assert _plan(pairwise.score_pairs(df).select("bleu_4")).count("run(") < plan.count("run(")


def test_vocabulary_is_looked_up_in_the_row(spark):
    df = spark.createDataFrame([("s1", "The cat sat"), ("s1", "a cat sat"), (None, None), ("s4", " ")], "id string, text string")
    vocab = spark.createDataFrame([("<pad>", 0), ("<sos>", 1), ("<eos>", 2), ("<unk>", 3), ("cat", 4), ("sat", 5)], "token string, idx int")
    enc = V.encode(df, "text", vocab)
    dec = V.decode(enc, "ids", vocab)
    assert "Exchange" not in _plan(enc) and "Exchange" not in _plan(dec)
    assert sorted(map(tuple, enc.select("ids").toPandas()["ids"])) == [(1, 2), (1, 2), (1, 3, 4, 5, 2), (1, 3, 4, 5, 2)]
    limit, V.BROADCAST_BYTES = V.BROADCAST_BYTES, 0           # a vocabulary beyond the limit is joined by shuffle
    try:
        assert sorted(V.encode(df, "text", vocab).toPandas()["ids"].map(tuple)) == sorted(enc.toPandas()["ids"].map(tuple))
        assert sorted(V.decode(enc, "ids", vocab).toPandas()["text"]) == sorted(dec.toPandas()["text"])
    finally:
        V.BROADCAST_BYTES = limit


def test_short_pairs_shuffle_no_grams(spark):
    rows = [(1, "a b c d e", "a b x d e"), (2, "", "q"), (3, "a a a", "a"), (4, "b c", "b c"), (4, "b", "c b"), (None, "a", "a")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(long_pairs.count_scores(df)) == key(long_pairs.count_scores(df, long_chars=-1))


def test_resampled_sums_follow_the_weights(spark):
    df = spark.createDataFrame([(str(i) if i else None, (i % 7) / 7, None if i % 3 else 0.5) for i in range(60)], "id string, a double, b double")
    weights = df.select("a", "b", staged.poisson_weights(F.col("id"), 12, "s").alias("w")).collect()
    schema = "resample int, weight long, a double, b double"
    got = df.select(F.col("id").alias("_id"), "a", "b").mapInArrow(staged._resampled_sums(["a", "b"], 12, "s"), schema) \
        .groupBy("resample").agg(F.sum("weight").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    assert len(got) == 12
    for r in got:
        assert r.n == sum(x.w[r.resample] for x in weights)
        assert abs(r.a - sum(x.a * x.w[r.resample] for x in weights)) < 1e-9
        assert abs(r.b - sum((x.b or 0) * x.w[r.resample] for x in weights)) < 1e-9
