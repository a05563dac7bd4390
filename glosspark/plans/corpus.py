"""End-to-end corpus plans: the reference's notebook/CLI data paths as one Spark plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions import normalize as N
from glosspark.operators.splits import train_validation
from glosspark.plans import fixtures as FX

BAND_MIN, BAND_MAX = 10, 500   # exclusive character bounds, applied after normalising


def length_band(df: DataFrame, cols=("gloss", "text"), lo: int = BAND_MIN, hi: int = BAND_MAX) -> DataFrame:
    """lo < len < hi characters on every column."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.length(c) > lo) & (F.length(c) < hi)
    return df.filter(cond)


def as_strings(df: DataFrame, cols=("gloss", "translation")) -> DataFrame:
    """rows with both sides, cast to string."""
    return df.dropna(subset=list(cols)).withColumns({c: F.col(c).cast("string") for c in cols})


def prepared_t2g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 preprocessing: drop nulls (F1), keep originals (F7), T9a on text, T9b on gloss, band."""
    p = as_strings(FX.pairs(spark, sf_dir))
    out = p.select("id", "doc_id", "pos",
                   F.col("gloss").alias("original_gloss"), F.col("translation").alias("original_text"),
                   N.process_gloss_target(F.col("gloss")).alias("gloss"),
                   N.process_text(F.col("translation")).alias("text"))
    return length_band(out)


def prepared_g2t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 preprocessing: gloss v2 normaliser, target-text normaliser, band."""
    p = as_strings(FX.pairs(spark, sf_dir))
    out = p.select("id", "doc_id", "pos",
                   F.col("gloss").alias("original_gloss"), F.col("translation").alias("original_text"),
                   N.process_gloss_v2(F.col("gloss")).alias("gloss"),
                   N.process_target_text(F.col("translation")).alias("text"))
    return length_band(out)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> pairs -> normalise -> band -> exact 80/20 split -> per-split profile."""
    split = train_validation(prepared_t2g(spark, sf_dir))
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.avg(F.length("text")), 6).alias("avg_text_chars"),
        F.round(F.avg(F.length("gloss")), 6).alias("avg_gloss_chars"))
