"""Registry of named queries: one per SURVEY §2 operator, each with its SQL oracle.

`QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)`.
Every query reads the driver tables (or views Spark derives from them) in
full; output columns are strings, bigints or doubles rounded to 6 places, so
both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from glosspark.functions import normalize as N
from glosspark.plans import fixtures as FX
from glosspark.plans import oracle as O

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# --- T*: normalisers over the pair view -----------------------------------------

_T_OPS = [
    # name, spark fn, sql fn, input column
    ("t1_clean_translation", N.clean_translation, O.clean_translation, "translation"),
    ("t1_clean_gloss", N.clean_gloss, O.clean_gloss, "gloss"),
    ("t2_clean_text", N.clean_text, O.clean_text, "translation"),
    ("t3a_gloss_tokens_v1", N.normalize_gloss_v1, O.normalize_gloss_v1, "gloss"),
    ("t3b_gloss_tokens_v2", N.normalize_gloss_v2, O.normalize_gloss_v2, "gloss"),
    ("t4a_numbers_g2t", N.numbers_g2t, O.numbers_g2t, "translation"),
    ("t4b_numbers_t2g", N.numbers_t2g, O.numbers_t2g, "translation"),
    ("t5a_fix_errors_g2t", N.fix_errors_g2t, O.fix_errors_g2t, "translation"),
    ("t5b_fix_errors_t2g", N.fix_errors_t2g, O.fix_errors_t2g, "translation"),
    ("t6a_process_gloss_v1", N.process_gloss_v1, O.process_gloss_v1, "gloss"),
    ("t6b_process_gloss_v2", N.process_gloss_v2, O.process_gloss_v2, "gloss"),
    ("t7_process_target_text", N.process_target_text, O.process_target_text, "translation"),
    ("t8_text_for_gloss", N.normalize_text_for_gloss, O.normalize_text_for_gloss, "translation"),
    ("t9a_process_text", N.process_text, O.process_text, "translation"),
    ("t9b_process_gloss_target", N.process_gloss_target, O.process_gloss_target, "gloss"),
    ("t10_fix_titles", N.fix_titles, O.fix_titles, "translation"),
    ("t11_insert_articles", N.insert_articles, O.insert_articles, "translation"),
    ("t12_normalize_punctuation", N.normalize_punctuation, O.normalize_punctuation, "translation"),
    ("t13_post_process_text", N.post_process_text, O.post_process_text, "translation"),
    ("t14_gloss_structure", N.fix_gloss_structure, O.fix_gloss_structure, "gloss"),
    ("t15_gloss_format", N.normalize_gloss_format, O.normalize_gloss_format, "gloss"),
    ("t16_post_process_gloss", N.post_process_gloss, O.post_process_gloss, "gloss"),
    ("t17_preserve_notation", N.preserve_gloss_notation, O.preserve_gloss_notation, "gloss"),
    ("t18_english_text", N.process_english_text, O.process_english_text, "translation"),
    ("t19_spatial_markers", N.strip_spatial_markers, O.strip_spatial_markers, "gloss"),
]


def _t_query(fn, colname):
    def q(spark, sf_dir):
        p = FX.pairs(spark, sf_dir)
        return p.select("id", fn(F.col(colname)).alias("out"))
    return q


_TOKENISED_SQL = {"t10_fix_titles": O.fix_titles_ws, "t13_post_process_text": O.post_process_text_ws}

for _name, _sf, _qf, _c in _T_OPS:
    if _name in _TOKENISED_SQL:   # tokenise once in a subquery (DuckDB re-evaluates lambdas' captures)
        _sql = (O.WITH_PAIRS + f"SELECT id, {_TOKENISED_SQL[_name]('ws')} AS out FROM "
                f"(SELECT id, {O.words(O.s(_c))} AS ws FROM pairs)")
    else:
        _sql = O.WITH_PAIRS + f"SELECT id, {_qf(_c)} AS out FROM pairs"
    register(_name, _sql)(_t_query(_sf, _c))


@register("t20_extract_generation",
          f"SELECT doc_id, {O.extract_generation('text')} AS out FROM documents")
def t20(spark, sf_dir):
    from glosspark.session import table
    return table(spark, sf_dir, "documents").select("doc_id", N.extract_generation(F.col("text")).alias("out"))


# --- M*: evaluation ---------------------------------------------------------------

from glosspark.operators.metrics import corpus as MC  # noqa: E402
from glosspark.operators.metrics import pairwise as MP  # noqa: E402
from glosspark.plans import oracle_metrics as OM  # noqa: E402

_MCOLS = ", ".join(MP.METRIC_COLUMNS)


@register("m1_sentence_metrics", OM.per_pair_metrics_sql())
def m1(spark, sf_dir):
    """M1 + M5 + M6 + M7 per pair (case-sensitive tokens, stemmer off)."""
    p = FX.preds(spark, sf_dir).select("id", "prediction", "reference")
    return MP.score_pairs(p).drop("prediction", "reference")


@register("m2_sentence_metrics_lower", OM.per_pair_metrics_sql(lower=True))
def m2(spark, sf_dir):
    """M2 (+ lower-cased WER of C6/C12): the same per-pair metrics on lower-cased text."""
    p = FX.preds(spark, sf_dir).select("id", "prediction", "reference")
    return MP.score_pairs(p, lower=True).drop("prediction", "reference")


@register("m3_corpus_bleu", OM.corpus_bleu_sql())
def m3(spark, sf_dir):
    return MC.corpus_bleu(FX.preds(spark, sf_dir))


@register("m4_corpus_bleu_13a", OM.corpus_bleu_13a_sql())
def m4(spark, sf_dir):
    return MC.corpus_bleu_13a(FX.preds(spark, sf_dir))


@register("m8_gloss_accuracy", OM.gloss_accuracy_sql())
def m8(spark, sf_dir):
    p = FX.preds(spark, sf_dir).select("id", "ref_gloss", "pred_gloss")
    return MP.score_gloss_accuracy(p).select("id", "gloss_accuracy")


_MEANS = ", ".join(f"round(coalesce(avg({m}), 0.0), 6) AS {m}" for m in MP.METRIC_COLUMNS)


@register("m9_metric_means", f"SELECT {_MEANS}, count(*) AS n_pairs FROM (" + OM.per_pair_metrics_sql() + ")")
def m9(spark, sf_dir):
    """M9: the reference's calculate_metrics result (means; 0.0 for no pairs)."""
    return MC.metric_means(m1(spark, sf_dir))


@register("f5_metric_means_nonempty",
          f"SELECT {_MEANS}, count(*) AS n_pairs FROM (" + OM.per_pair_metrics_sql(
              src_ctes=O.BASE + (O.PREDS, "nonempty AS (SELECT * FROM preds WHERE trim(prediction) <> '')"),
              src="nonempty") + ")")
def f5(spark, sf_dir):
    """score only pairs with a non-empty hypothesis."""
    p = FX.preds(spark, sf_dir).filter(F.trim("prediction") != "").select("id", "prediction", "reference")
    return MC.metric_means(MP.score_pairs(p).drop("prediction", "reference"))


_POST = ("post AS (SELECT id, reference, " + O.post_process_text("prediction") + " AS prediction FROM preds)")


@register("m10_post_processed_means",
          f"SELECT {_MEANS}, count(*) AS n_pairs FROM (" + OM.per_pair_metrics_sql(
              src_ctes=O.BASE + (O.PREDS, _POST), src="post") + ")")
def m10(spark, sf_dir):
    """Predictions pass through the text post-processor (T13) before scoring."""
    p = FX.preds(spark, sf_dir).select("id", "reference", N.post_process_text(F.col("prediction")).alias("prediction"))
    return MC.metric_means(MP.score_pairs(p).drop("prediction", "reference"))


_BYLANG = ("bylang AS (SELECT p.id, p.prediction, p.reference, d.lang AS dataset FROM preds p "
           "JOIN documents d ON d.doc_id = p.doc_id)")


@register("m11_metrics_by_dataset",
          f"SELECT dataset, {_MEANS}, count(*) AS n_pairs FROM (" + OM.per_pair_metrics_sql(
              src_ctes=O.BASE + (O.PREDS, _BYLANG), src="bylang", keep=",dataset") + ") GROUP BY dataset")
def m11(spark, sf_dir):
    """Per-dataset metric table (dataset = document language)."""
    p = FX.preds(spark, sf_dir, extra=("lang",)).select("id", F.col("lang").alias("dataset"), "prediction", "reference")
    return MC.metric_means(MP.score_pairs(p).drop("prediction", "reference"), ["dataset"])


from glosspark.plans import catalog_corpus, catalog_metrics, catalog_more  # noqa: E402,F401  (register their queries)
