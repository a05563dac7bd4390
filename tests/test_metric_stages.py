"""Stems, staged METEOR, bootstrapped means and long pairs against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from glosspark.functions import porter
from glosspark.operators import joins as J
from glosspark.operators.metrics import blocked, long_pairs, staged
from glosspark.operators.metrics import pairwise as MP
from glosspark.plans import fixtures as FX
from tests.conftest import SF001

#: Examples of the published algorithm's description.
PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll",
}


def test_published_stems():
    assert {w: porter.stem(w, extended=False) for w in PUBLISHED} == PUBLISHED
    assert [porter.stem(w) for w in ("dies", "flies", "died", "spied", "dying", "news", "say", "enjoy", "is", "Radically", "psychologi", "FEELING")] \
        == ["die", "fli", "die", "spi", "die", "news", "say", "enjoy", "is", "radic", "psycholog", "feel"]


def test_stem_arrays(spark):
    rows = [(1, ["running", "run", None, "été"], ["a"]), (2, None, []), (3, [], ["cats", "cats"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").repartition(3)
    got = {r["id"]: (r["x"], r["y"]) for r in porter.with_stems(df, {"x": "a", "y": "b"}).collect()}
    assert got == {1: (["run", "run", None, "été"], ["a"]), 2: (None, []), 3: ([], ["cat", "cat"])}
    assert porter.with_stems(df, {"x": "b"}, 4).filter("id = 3").first()["x"] == ["cats", "cats"]
    assert porter.with_stems(df.limit(0), {"x": "a"}).count() == 0


def _f1(h, r, n):
    a, b = (collections.Counter(zip(*(x[i:] for i in range(n)))) for x in (h, r))
    m = sum((a & b).values())
    p, q = m / max(1, sum(a.values())), m / max(1, sum(b.values()))
    return 2 * p * q / (p + q) if p + q else 0.0


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_stemmed_rouge(spark):
    rows = [("a", "the runner was running fast", "The runners ran: fast!"), ("b", "", "x"), ("c", None, None), ("d", "cats cats cats", "cat, the cats")]
    got = {r["id"]: r for r in staged.rouge_stemmed(spark.createDataFrame(rows, "id string, prediction string, reference string")).collect()}
    for i, p, r in rows:
        h, t = porter.rouge_tokens(p or ""), porter.rouge_tokens(r or "")
        m = _lcs(h, t)
        assert got[i]["rouge1_f"] == pytest.approx(_f1(h, t, 1), abs=1e-6) and got[i]["rouge2_f"] == pytest.approx(_f1(h, t, 2), abs=1e-6)
        assert got[i]["rougeL_f"] == pytest.approx(2 * m / (len(h) + len(t)) if m else 0.0, abs=1e-6)
    assert got["a"]["rouge1_f"] > 0.6


def test_meteor_in_stages(spark):
    rows = [("a", "HOW YOU FEEL", "HOW YOU FEELING"), ("b", "the big car stops", "the large automobile stopped"), ("c", "", "x"), ("d", None, "x"),
            ("e", "x x car", "car auto x auto"), ("f", "big big", "large huge")]
    syn = spark.createDataFrame([("big", "large"), ("big", "huge"), ("car", "automobile"), ("car", "auto"), ("car", "auto"), (None, "x"), ("x", None)], "word string, synonym string")
    df = spark.createDataFrame(rows, "id string, prediction string, reference string")
    got = {r["id"]: r for r in staged.meteor_staged(df, synonyms=syn).collect()}
    # FEEL and FEELING by hand: three of three words in one chunk, 1 - 0.5 * (1 / 3) ** 3
    assert got["a"]["meteor_exact"] == pytest.approx(0.625, abs=1e-4) and got["a"]["meteor_stem"] == pytest.approx(1 - 0.5 / 27, abs=1e-6)
    b = got["b"]
    assert b["meteor_exact"] < b["meteor_stem"] < b["meteor_synonym"] == pytest.approx(1 - 0.5 / 64, abs=1e-6)
    assert got["c"]["meteor_synonym"] == got["d"]["meteor_synonym"] == 0.0
    assert got["f"]["meteor_synonym"] == pytest.approx(1 - 0.5 / 8, abs=1e-6) and got["f"]["meteor_stem"] == 0.0
    alone = {r["id"]: r for r in staged.meteor_staged(df).collect()}
    assert all(alone[i]["meteor_synonym"] == alone[i]["meteor_stem"] == got[i]["meteor_stem"] for i in alone)
    plain = {r["id"]: r["meteor"] for r in MP.score_pairs(df.filter("prediction is not null")).collect()}
    assert all(got[i]["meteor_exact"] == pytest.approx(m, abs=1e-6) for i, m in plain.items())


def test_synonyms_take_the_last_free_word():
    left_h, left_r = [0, 1, 2], [0, 1, 2]
    assert staged.match_synonyms(["big", "q", "big"], ["large", "huge", "z"], {"big": ["large", "huge"]}, left_h, left_r) == [(2, 1), (0, 0)]
    assert left_h == [1] and left_r == [2]


def test_bootstrap(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(400)]
    df = spark.createDataFrame([(str(i), v, 1.0) for i, v in enumerate(values)], "id string, m double, one double")
    got = {r["metric"]: r for r in staged.bootstrap_means(df, ["m", "one"]).collect()}
    again = {r["metric"]: r for r in staged.bootstrap_means(df.repartition(5), ["m", "one"]).collect()}
    mean = sum(values) / 400
    m = got["m"]
    assert (m["low"], m["mid"], m["high"]) == (again["m"]["low"], again["m"]["mid"], again["m"]["high"])
    assert m["low"] < mean < m["high"] and abs(m["mid"] - mean) < 0.01 and 0.03 < m["high"] - m["low"] < 0.08 and m["n_resamples"] == 200
    assert (got["one"]["low"], got["one"]["high"]) == (1.0, 1.0)
    weights = [w for r in df.select(staged.poisson_weights(F.col("id"), 21, "s").alias("w")).collect() for w in r["w"]]
    assert len(weights) == 21 * 400 and abs(sum(weights) / len(weights) - 1) < 0.05 and abs(weights.count(0) / len(weights) - 0.368) < 0.03


@pytest.mark.parametrize("bits", [1, 7, 64, 4096])
def test_blocked_distances(bits):
    rng = random.Random(bits)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (7, 7), (64, 63), (65, 130), (200, 190)]:
        a, b = [rng.choice("abcde") for _ in range(n)], [rng.choice("abcdef") for _ in range(m)]
        assert blocked.edit_distance(a, b, bits) == _lev(a, b) and blocked.lcs_length(a, b, bits) == _lcs(a, b)
        assert blocked.edit_distance(a, a, bits) == 0 and blocked.lcs_length(a, a, bits) == n


def test_blocked_distances_of_long_lists():
    rng = random.Random(4)
    a = [rng.randrange(300) for _ in range(5000)]
    b = [x if rng.random() < 0.8 else rng.randrange(300) for x in a if rng.random() < 0.9]
    assert blocked.edit_distance(a, b) == _lev(a, b) and blocked.lcs_length(a, b) == _lcs(a, b)
    base = [f"w{i}" for i in range(100_000)]                       # every token differs: one mask a token, of one block only
    other = base[:50_000] + ["new"] * 7 + base[50_010:]
    assert blocked.edit_distance(other, base) == 10 and blocked.lcs_length(other, base) == 99_990


def test_long_pairs_equal_the_row_plan(spark):
    df = FX.preds(spark, SF001).select("id", "prediction", "reference").unionByName(spark.createDataFrame([("e1", "", "x"), ("e2", "x", ""), ("e3", "", "")], "id string, prediction string, reference string"))
    want = {r["id"]: r for r in MP.score_pairs(df).collect()}
    counts = {r["id"]: r for r in long_pairs.count_scores(df).collect()}
    far = {r["id"]: r for r in long_pairs.distance_scores(df).collect()}
    assert set(want) == set(counts) == set(far)
    for i, r in want.items():
        assert all(counts[i][c] == pytest.approx(r[c], abs=2e-6) for c in ("bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge1_f", "rouge2_f")), i
        assert all(far[i][c] == pytest.approx(r[c], abs=2e-6) for c in ("wer", "rougeL_f")), i


def test_pairs_of_every_length(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(600))
    rows = [("a", "x y z", "x y"), ("b", long, "q " + long[5:]), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, prediction string, reference string")
    want = {r["id"]: r for r in MP.score_pairs(df.na.fill("")).collect()}
    got = {r["id"]: r for r in long_pairs.score_any(df, long_words=100).collect()}
    assert {(i, c): got[i][c] for i in got for c in MP.METRIC_COLUMNS} == pytest.approx({(i, c): want[i][c] for i in want for c in MP.METRIC_COLUMNS}, abs=2e-6)


def test_a_long_pair_is_spread_over_tasks(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    sides = spark.createDataFrame([(1, 0, text), (1, 1, text), (2, 0, "a b"), (2, 1, "a c")], "id int, side int, text string").select("id", "side", F.split("text", " ").alias("tokens"))
    got = {(r["id"], r["n"]): (r["m"], r["hn"], r["rn"]) for r in long_pairs.gram_matches(sides).collect()}
    assert [got[1, n] for n in (1, 2, 3, 4)] == [(200_001 - n,) * 3 for n in (1, 2, 3, 4)] and got[2, 1] == (1, 2, 2) and (2, 3) not in got


def test_user_dictionary_with_a_hot_token(spark):
    """A dictionary over the byte limit, and a token in every row: its rows are dealt, no part holds much more than the others."""
    tokens = spark.range(20_000).select("id", F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 500).cast("string")), F.lit(None).cast("string"))).alias("token"))
    words = [("the", "DET")] + [(f"w{i}", f"W{i}") for i in range(0, 500, 2)]
    dictionary = spark.createDataFrame(words, "token string, meaning string")
    want = collections.Counter({("the", "DET"): 20_000, (None, None): 20_000})
    want.update({(f"w{i}", None if i % 2 else f"W{i}"): 40 for i in range(500)})
    for limit in (0, 1 << 20):
        out = J.lookup_tokens(tokens, dictionary, "token", spread="id", max_bytes=limit, hot_rows=500)
        assert collections.Counter({(r["token"], r["meaning"]): r["count"] for r in out.groupBy("token", "meaning").count().collect()}) == want
        assert out.columns == ["token", "id", "meaning"]
