"""A training corpus from raw documents: language, near copies, benchmark, secrets, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of `documents`.
Stages that work in Python keep the session's Arrow batches small (`common.small_batches`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm import decontam, langid, mixing, near_dedup, packed, secret_crf
from glosspark.llm.common import checkpointed, small_batches, small_side

#: Near copies of the corpus: word shingles and least similarity in percent.
SHINGLE, PERCENT = 5, 80
MASK = "[SECRET]"


def _shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and how to name them back."""
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(own), {v: k for k, v in own.items()}


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    small_batches(spark)
    plain, back = _shielded(docs, "lang_pred", "score", "rejected")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(plain, model).filter(~F.col("rejected")).drop("lang_pred", "score", "rejected").withColumnsRenamed(back).select(docs.columns)


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the one with the smallest doc_id)."""
    small_batches(spark)
    found = near_dedup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT).filter("kept")
    did = F.coalesce(F.col("id"), F.lit(packed.LAST_ID))
    stay = checkpointed(found.groupBy(did.alias("_did"), F.col("x").alias("_x")).agg(F.count(F.lit(1)).alias("_rows")))
    repeated = stay.filter("_rows > 1").limit(1).count() > 0
    plain, back = _shielded(docs, "_did", "_x")
    keyed = plain.withColumns({"_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(packed.LAST_ID)),
                              "_x": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    kept = keyed.join(small_side(stay.select("_did", "_x")), ["_did", "_x"], "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["_did", "_x"])
    return kept.drop("_did", "_x").withColumnsRenamed(back).select(docs.columns)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    small_batches(spark)
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    made = ("n_words", "n_hit", "n_items", "items", "contaminated", "_hit", "_items")
    plain, back = _shielded(docs, *made)
    return decontam.contamination(plain, bench).filter(~F.col("contaminated")).drop(*made).withColumnsRenamed(back).select(docs.columns)


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked; n_chars follows the text."""
    small_batches(spark)
    plain, back = _shielded(docs, "_secrets")
    out = secret_crf.scan(plain, secret_crf.train(plain), out_col="_secrets", mask=MASK)
    if "n_chars" in docs.columns:
        changed = F.size("_secrets") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("_secrets").withColumnsRenamed(back).select(docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with source_size, target and taken (words, repeats counted)."""
    mixed = mixing.mix(docs.drop("size", "source_size", "target", "taken"))
    return mixed.filter("taken > 0").select(*docs.drop("size", "source_size", "target", "taken").columns, "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("mix", mix_sources),
]

#: Two stages rest on trained models, which SQL cannot express; tests/llm check run().
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
