"""The registered queries of this package: thin readings of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm import (block_dedup, collocations, decontam, jaccard_join, langid, mixing, near_dedup, oracles, pii, quotes, secret_crf,
                           spelling, suffix_dedup, topk)
from glosspark.llm.common import documents


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _count(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _hex(col) -> F.Column:
    return F.sha2(col, 256)


def op1_quote_linking(spark, sf_dir):
    """Conversations, rendered as mail (each turn quotes the two before it), linked and ordered."""
    mail = quotes.as_mail(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return quotes.reply_ordered(mail, keep_text=False).select("conv_id", "turn", "role", "body", "n_passages", "n_linked", "parent_conv", "parent_turn",
                                             "thread_conv", "thread_turn", "depth", "position")


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", _hex(F.col("kept")).alias("kept_sha256"))


def op3_chosen_path_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_exact_top_k(spark, sf_dir):
    vecs = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), 64).alias("vec")) \
        .filter("vec is not null")
    return topk.top_k(vecs, vecs.filter("id % 20 = 0"), 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_pii_spans(spark, sf_dir):
    found = pii.scan(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE_KINDS))
    return found.select("doc_id", *[_count("pii", k) for k in pii.BASE_KINDS], _hex(pii.joined(base)).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op7_benchmark_decontamination(spark, sf_dir):
    found = decontam.contamination(documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", _hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op8_secret_spans(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = secret_crf.scan(docs, secret_crf.train(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[_count("secrets", k) for k in secret_crf.KINDS[:3]], _hex(joined(base)).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op9_block_anchor_dedup(spark, sf_dir):
    return block_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", _hex(F.col("kept")).alias("kept_sha256"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(spelling.vocabulary(documents(spark, sf_dir, "doc_id", "text")))


def op12_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_groups(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


#: name -> (query, DuckDB SQL or None)
QUERIES = {f.__name__: (f, oracles.SQL.get(f.__name__)) for f in (
    op1_quote_linking, op2_suffix_array_dedup, op3_chosen_path_dedup, op4_language_id, op5_exact_top_k, op6_pii_spans,
    op7_benchmark_decontamination, op8_secret_spans, op9_block_anchor_dedup, op10_mix_sources, op11_spelling_variants,
    op12_ngram_jaccard_join, op13_phrase_collocations)}
