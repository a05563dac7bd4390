"""Each stage on its own input, and the whole run."""

import corpus_pipeline as cp
from glosspark.llm import decontam, secret_crf

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = decontam.tables(bench)
    for name, stage in cp.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        if name != "mix":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= {r["doc_id"] for r in before} and after
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in docs.collect())
        if name == "decontamination":
            for r in before:
                w = decontam.words_of(r["text"])
                hit, items = bytearray(len(w)), set()
                for t in tables:
                    t.search(w, hit, items)
                assert (r["doc_id"] in after) == (not any(hit))
        if name == "secret_scan":
            assert len(after) == len(before) and not any(secret_crf.base_spans(r["text"].replace(cp.MASK, "")) for r in docs.collect())
    assert {"source_size", "target", "taken"} <= set(docs.columns)
    got = {r["doc_id"]: r["taken"] for r in cp.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in docs.collect()}


def test_stages_keep_arrow_batches_small(spark):
    """What a stage returns is run by its caller, so the session's batches are set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    docs = spark.createDataFrame([(1, "one two three", "en", "web", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        assert cp.near_dedup_stage(spark, docs, "").count() == 1
        assert spark.conf.get(name) == f"{4 << 20}b"
    finally:
        spark.conf.set(name, own)
