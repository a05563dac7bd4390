"""Vocabularies and batches on large tables: what is shuffled, and that the results are the same."""

import random

import pytest

from glosspark.functions import lexicon as L
from glosspark.operators import vocab as V

SPECIAL = [("<pad>", 0), ("<sos>", 1), ("<eos>", 2), ("<unk>", 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)] + ["É", "<unk>", " ", "a\x1cb"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)] + ["", "  ", None, "x" + " y" * 200]


def test_vocabulary_is_counted_before_the_shuffle(spark):
    lines = _lines()
    rows = [(k % 97 or None, "xyz"[k % 3], t) for k, t in enumerate(lines)]     # orders repeat and are null
    df = spark.createDataFrame(rows, "k int, s string, text string").repartition(5)
    made = V.build_vocab(df, "text", ["k", "s"])
    freq, first = {}, {}
    for k, s, t in rows:
        for pos, w in enumerate(V.split_words((t or "").lower())):
            at = (k is not None, k or 0, s, pos)
            freq[w] = freq.get(w, 0) + 1
            first[w] = min(first.get(w, at), at)
    kept = [w for w in freq if freq[w] > 1 and w not in L.SPECIALS]
    got = sorted(((r.idx, r.token) for r in made.collect()))
    assert {t for _, t in got} == {*kept, *L.SPECIALS} and [i for i, _ in got] == list(range(len(kept) + 4))
    assert [first[t] for _, t in got[4:]] == sorted(first[t] for t in kept)
    chunks = V._seen("text", ["k", "s"])
    seen = df.mapInArrow(chunks, "token string, freq long, _o0 int, _o1 string, pos int")
    assert sum(r.freq for r in seen.collect()) == sum(len(V.split_words(t or "")) for t in lines)
    assert seen.count() < sum(len(V.split_words(t or "")) for t in lines) / 2


@pytest.mark.parametrize("limit", [0, 300, 2000])
def test_only_tokens_beyond_the_limit_are_joined(spark, limit):
    lines = _lines()
    tokens = sorted({w for t in lines for w in (t or "").lower().split()})[::2]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(lines)], "id int, text string")
    vocab = spark.createDataFrame([*SPECIAL, *((t, k + 4) for k, t in enumerate(tokens) if t not in L.SPECIALS), (None, 9999), ("none", None)], "token string, idx int")
    code = {r.token: r.idx for r in vocab.collect() if r.token is not None}
    name = {i: t for t, i in code.items() if i is not None}
    kept, V.BROADCAST_BYTES = V.BROADCAST_BYTES, limit
    try:
        enc = V.encode(df, "text", vocab)
        dec = V.decode(enc, "ids", vocab)
        assert "posexplode" not in _plan(enc) and "posexplode" not in _plan(dec)
        ids = [(k // 2, [3 if code.get(w) is None else code[w] for w in ["<sos>", *V.split_words((t or "").lower()), "<eos>"]][:100]) for k, t in enumerate(lines)]
        assert sorted((r.id, r.ids) for r in enc.collect()) == sorted(ids)
        text = lambda x: " ".join(name.get(i, "<unk>") for i in (x[:x.index(2)] if 2 in x else x) if i not in (0, 1))
        assert sorted((r.id, r.text) for r in dec.collect()) == sorted((k, text(x)) for k, x in ids)
    finally:
        V.BROADCAST_BYTES = kept


def test_tokens_of_one_hash_keep_their_ids(spark):
    df = spark.createDataFrame([(1, "plumless buckeroo plumless other")], "id int, text string")     # equal CRC-32
    for own in (["plumless", "buckeroo"], ["buckeroo", "plumless"], ["buckeroo"], []):
        vocab = spark.createDataFrame([*SPECIAL, *((t, k + 4) for k, t in enumerate(own))], "token string, idx int")
        code = {t: k + 4 for k, t in enumerate(own)}
        assert V.encode(df, "text", vocab).first().ids == [1, *(code.get(w, 3) for w in "plumless buckeroo plumless other".split()), 2]


def test_repeated_tokens_give_a_row_each_as_in_a_join(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    vocab = spark.createDataFrame([*SPECIAL, ("a", 4), ("a", 5), ("b", 6)], "token string, idx int")
    assert V.encode(df, "text", vocab).first().ids == [1, 4, 5, 6, 2]


def test_batches_are_padded_without_a_join_of_the_sequences(spark):
    rows = [(k, [7] * (k * 31 % 19)) for k in range(131)]
    out = V.form_batches(spark.createDataFrame(rows, "id int, ids array<int>").repartition(6), "ids", 16, order=["id"])
    assert "SortMergeJoin" not in _plan(out) and "hashpartitioning(batch" not in _plan(out)
    order = sorted(rows, key=lambda r: (len(r[1]), r[0]))
    want = {r[0]: (k // 16, r[1] + [0] * (len(order[min(k // 16 * 16 + 15, 130)][1]) - len(r[1]))) for k, r in enumerate(order)}
    assert {r.id: (r.batch, r.ids) for r in out.collect()} == want and out.columns == ["batch", "id", "ids"]
