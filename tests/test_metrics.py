"""Metric operators: golden values (FIXTURES.md §2) and brute force on whole lines."""

import random

import pytest
from pyspark.sql import functions as F

from glosspark.operators.metrics import corpus as MC
from glosspark.operators.metrics import pairwise as MP
from glosspark.operators.metrics.pairwise import _lcs_len

PAIRS = [
    ("I NEED HELP HOMEWORK", "I NEED HELP MY HOMEWORK",
     [0.7788, 0.6359, 0.5400, 0.3328, 0.8889, 0.5714, 0.8889, 0.2000, 0.7653, 0.7000]),
    ("WEATHER NICE TODAY", "WEATHER NICE TODAY",
     [1.0, 1.0, 1.0, 0.5623, 1.0, 1.0, 1.0, 0.0, 0.9815, 1.0]),
    ("HOW YOU FEEL", "HOW YOU FEELING",
     [0.6667, 0.5774, 0.3218, 0.2403, 0.6667, 0.5000, 0.6667, 0.3333, 0.6250, 0.6667]),
    ("MORNING WEATHER SUNNY", "MORNING WEATHER WILL SUNNY",
     [0.7165, 0.5067, 0.2640, 0.1905, 0.8571, 0.4000, 0.8571, 0.2500, 0.6553, 0.6250]),
    ("TEMPERATURE TWENTY DEGREE", "TEMPERATURE TWENTY DEGREE CELSIUS",
     [0.7165, 0.7165, 0.7165, 0.4029, 0.8571, 0.8000, 0.8571, 0.2500, 0.7550, 0.7500]),
]
COLS = ["bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge1_f", "rouge2_f", "rougeL_f", "wer", "meteor"]


def test_golden_pairs(spark):
    df = spark.createDataFrame([(str(i), p, r) for i, (p, r, _) in enumerate(PAIRS)],
                               "id string, prediction string, reference string")
    s = MP.score_pairs(df)
    s = MP.score_gloss_accuracy(s, "reference", "prediction")
    got = {r["id"]: r for r in s.collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        row = got[str(i)]
        for c, w in zip(COLS + ["gloss_accuracy"], want):
            assert row[c] == pytest.approx(w, abs=1e-4), (i, c)


def test_empty_sides(spark):
    df = spark.createDataFrame([("a", "", "x y"), ("b", "x y", ""), ("c", "", "")],
                               "id string, prediction string, reference string")
    got = {r["id"]: r for r in MP.score_pairs(df).collect()}
    assert got["a"]["bleu_4"] == 0.0 and got["a"]["wer"] == 1.0 and got["a"]["meteor"] == 0.0
    assert got["b"]["wer"] == 1.0        # empty reference: the reference's fallback value
    assert got["c"]["rougeL_f"] == 0.0


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_bit_parallel_lcs_matches_dp():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert _lcs_len(a, b) == _lcs(a, b)


def test_wer_and_rouge_l_whole_lines_brute_force(spark):
    """Every line of the smallest document table (long lines included) against Python DPs."""
    from glosspark.plans import fixtures as FX
    p = FX.preds(spark, "/root/testdata/sf0.001").select("id", "prediction", "reference")
    rows = MP.score_pairs(p, rounding=None).select("id", "prediction", "reference", "wer", "rougeL_f").collect()
    assert len(rows) > 1000
    import re
    for r in rows:
        h, ref = r.prediction.split(), r.reference.split()
        want = 1.0 if not ref else _lev(h, ref) / len(ref)
        assert r.wer == pytest.approx(want, abs=1e-12)
        th = [t for t in re.sub("[^a-z0-9]+", " ", r.prediction.lower()).split()]
        tr = [t for t in re.sub("[^a-z0-9]+", " ", r.reference.lower()).split()]
        lcs = _lcs(th, tr)
        f = 0.0 if not th or not tr or lcs == 0 else 2 * (lcs / len(th)) * (lcs / len(tr)) / (lcs / len(th) + lcs / len(tr))
        assert r.rougeL_f == pytest.approx(f, abs=1e-12)


def test_corpus_bleu_pools_counts(spark):
    df = spark.createDataFrame([(p, r) for p, r, _ in PAIRS], "prediction string, reference string")
    row = MC.corpus_bleu(df, lower=True).first()
    # pooled unigram precision = 15 matched / 16 hypothesis tokens, BP over 16 vs 19 tokens
    import math
    bp = math.exp(1 - 19 / 16)
    assert row["bleu_1"] == pytest.approx(100 * bp * 15 / 16, abs=1e-4)
