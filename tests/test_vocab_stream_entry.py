"""Vocabulary round trip, streaming preparation, and the driver contract."""

from pyspark.sql import functions as F

from glosspark.operators import vocab as V


def test_encode_decode_roundtrip(spark):
    rows = [("s1", "The cat  sat"), ("s2", "the cat ran"), ("s3", "A dog SAT ran")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("k", F.col("id"))
    vocab = V.build_vocab(df, "text", ["k"])
    voc = {r.token: r.idx for r in vocab.collect()}
    assert voc["<pad>"] == 0 and voc["the"] == 4 and voc["cat"] == 5 and voc["sat"] == 6 and voc["ran"] == 7
    assert "dog" not in voc   # frequency 1
    enc = {r.id: r.ids for r in V.encode(df, "text", vocab).collect()}
    assert enc["s1"] == [1, 4, 5, 6, 2] and enc["s3"] == [1, 3, 3, 6, 7, 2]
    dec = {r.id: r.text for r in V.decode(V.encode(df, "text", vocab), "ids", vocab).collect()}
    assert dec["s1"] == "the cat sat" and dec["s3"] == "<unk> <unk> sat ran"
    row = spark.createDataFrame([([1, 4, 5, 2],)], "ids array<int>").select(
        V.pad_to(F.col("ids"), 6).alias("p"), V.labels_from(V.pad_to(F.col("ids"), 6)).alias("l"),
        V.attention_mask(V.pad_to(F.col("ids"), 6), F.size("ids")).alias("m")).first()
    assert row.p == [1, 4, 5, 2, 0, 0] and row.l == [1, 4, 5, 2, -100, -100] and row.m == [1, 1, 1, 1, 0, 0]


def test_streaming_matches_batch(spark, tmp_path):
    from glosspark.streaming.prepare import prepare_lines, start_to_parquet, stream_prepared
    src = "/root/testdata/sf0.001/documents*.parquet"
    import uuid
    # a fresh query name: a reused name resumes from its committed offsets (by design)
    q = start_to_parquet(stream_prepared(spark, src), str(tmp_path / "out"), name=f"test-{uuid.uuid4().hex}")
    q.awaitTermination(300)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = prepare_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"split", "n_pairs", "avg_text_chars", "avg_gloss_chars"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60


def test_repeated_ids_keep_their_rows(spark):
    from glosspark.operators import vocab as V
    df = spark.createDataFrame([("a", "x y"), ("a", "y z"), ("b", "x y"), ("b", "x y")], "id string, text string")
    vocab = spark.createDataFrame([("<pad>", 0), ("<sos>", 1), ("<eos>", 2), ("<unk>", 3), ("x", 4), ("y", 5), ("z", 6)], "token string, idx int")
    enc = V.encode(df, "text", vocab)
    assert sorted((r.id, r.ids) for r in enc.collect()) == [("a", [1, 4, 5, 2]), ("a", [1, 5, 6, 2]), ("b", [1, 4, 5, 2]), ("b", [1, 4, 5, 2])]
    assert sorted((r.id, r.text) for r in V.decode(enc, "ids", vocab).collect()) == [("a", "x y"), ("a", "y z"), ("b", "x y"), ("b", "x y")]


def test_encode_and_decode_shuffle_no_text(spark):
    rows = [(1, "a b b"), (1, "a b b"), (2, "A b B"), (3, ""), (4, None), (5, "b unknown a")] + [(10 + i, "a a b") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = spark.createDataFrame([("<pad>", 0), ("<sos>", 1), ("<eos>", 2), ("<unk>", 3), ("a", 4), ("b", 5)], "token string, idx int")
    enc = V.encode(df, "text", vocab)
    code = {"a": 4, "b": 5}
    want = sorted((i, [1] + [code.get(w, 3) for w in (t or "").lower().split()] + [2]) for i, t in rows)
    assert sorted((r["id"], r["ids"]) for r in enc.collect()) == want
    back = V.decode(enc, "ids", vocab)
    assert sorted((r["id"], r["text"]) for r in back.collect()) == sorted(
        (i, " ".join(w if w in code else "<unk>" for w in (t or "").lower().split())) for i, t in rows)
    for made in (enc, back):
        exchanged = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        assert exchanged and not any(c in line for line in exchanged for c in ("_text#", "_kept#", " text#"))
