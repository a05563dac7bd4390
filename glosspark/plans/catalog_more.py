"""Registered queries of rules on lines that fire them, stored splits, user functions, user dictionaries and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glosspark.functions import normalize as N
from glosspark.functions.text import words
from glosspark.operators import inference as INF
from glosspark.operators import joins as J
from glosspark.operators import splits as SP
from glosspark.operators import vocab as V
from glosspark.operators.metrics import corpus as MC
from glosspark.operators.metrics import pairwise as MP
from glosspark.plans import catalog as CT
from glosspark.plans import catalog_corpus as CC
from glosspark.plans import corpus as C
from glosspark.plans import fixtures as FX
from glosspark.plans import oracle as O
from glosspark.plans import oracle_metrics as OM
from glosspark.plans import spiced as SC
from glosspark.plans.catalog import register
from glosspark.session import checkpoint_dir
from glosspark.sources import sinks, tables

# --- T*: every rule on lines that fire it -------------------------------------------


def _fired(fn, column):
    def q(spark, sf_dir):
        return SC.spiced(spark, sf_dir).select("id", fn(F.col(column)).alias("out"))
    return q


for _name, _fn, _sql, _col in CT._T_OPS:
    if _name in CT._TOKENISED_SQL:
        _text = SC.WITH_SPICED + f"SELECT id, {CT._TOKENISED_SQL[_name]('ws')} AS out FROM (SELECT id, {O.words(O.s(_col))} AS ws FROM spiced)"
    else:
        _text = SC.WITH_SPICED + f"SELECT id, {_sql(_col)} AS out FROM spiced"
    register(f"{_name}_fired", _text)(_fired(_fn, _col))


@register("t20_extract_generation_fired", SC.WITH_SPICED + f"SELECT id, {O.extract_generation('translation')} AS out FROM spiced")
def t20_fired(spark, sf_dir):
    return SC.spiced(spark, sf_dir).select("id", N.extract_generation(F.col("translation")).alias("out"))


@register("f1_null_rows_fired", SC.WITH_SPICED + "SELECT id, gloss, translation FROM spiced WHERE gloss IS NOT NULL AND translation IS NOT NULL")
def f1_fired(spark, sf_dir):
    """F1 where nulls are found."""
    return C.as_strings(SC.spiced(spark, sf_dir))


@register("f2_nonempty_clean_pair_fired",
          SC.WITH_SPICED + f"SELECT id, {O.clean_gloss('gloss')} AS gloss, {O.clean_translation('translation')} AS translation FROM spiced "
          f"WHERE length({O.clean_gloss('gloss')}) > 0 AND length({O.clean_translation('translation')}) > 0")
def f2_fired(spark, sf_dir):
    """F2 where blanks are found."""
    p = SC.spiced(spark, sf_dir).select("id", N.clean_gloss(F.col("gloss")).alias("gloss"), N.clean_translation(F.col("translation")).alias("translation"))
    return p.filter((F.length("gloss") > 0) & (F.length("translation") > 0))


# --- F8, J3 ---------------------------------------------------------------------------

@register("f8_sample_exact_25", O.with_views(*O.BASE, CC.PREP_T2G, CC.BAND, CC.SP1_CTE) + "SELECT id, gloss, text FROM k1 WHERE rn <= 25")
def f8(spark, sf_dir):
    """F8: a small exact sample for a report."""
    return SP.sample_exact(C.prepared_t2g(spark, sf_dir), 25).select("id", "gloss", "text")


@register("j3_predictions_meet_references", O.WITH_PREDS + "SELECT a.id, a.prediction, b.reference FROM preds a JOIN preds b ON a.id = b.id WHERE trim(a.prediction) <> ''")
def j3(spark, sf_dir):
    """A table of predictions, some missing, and one of references."""
    p = FX.preds(spark, sf_dir)
    return J.pair_predictions(p.filter(F.trim("prediction") != "").select("id", "prediction"), p.select("id", "reference"))


# --- S10 + S7: stored splits -------------------------------------------------------------

@register("s10_s7_stored_splits",
          O.with_views(*O.BASE, CC.PREP_T2G, CC.BAND, CC.SP1_CTE)
          + f"SELECT k1.id, k1.text, d.lang AS dataset, 'validation' AS split FROM k1 JOIN documents d USING (doc_id) WHERE {CC.SP1_SPLIT} = 'validation' AND d.lang IN ('en', 'fr')")
def s10_s7(spark, sf_dir):
    """Prepared pairs written by dataset and split; S7: one split of the datasets that a small table names, read with pruned partitions."""
    from glosspark.session import table
    prepared = SP.train_validation(C.prepared_t2g(spark, sf_dir)).select("id", "doc_id", "text", "split")
    langs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"))
    path = f"{checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
    sinks.write_splits(prepared.join(langs, "doc_id").drop("doc_id"), path, ["dataset", "split"])
    wanted = langs.select("dataset").distinct().filter(F.col("dataset").isin("en", "fr"))
    return tables.stored_split(spark, path, "validation", datasets=wanted).select("id", "text", "dataset", "split")


# --- U1 -----------------------------------------------------------------------------------

def _chunker():
    """A user's batch function: pieces of ten words of each text, and how many there are."""
    def run(batch: dict) -> dict:
        out: dict = {"id": [], "part": [], "piece": []}
        for i, text in zip(batch["id"], batch["translation"]):
            w = text.split()
            for k in range(0, len(w), 10):
                out["id"].append(i)
                out["part"].append(k // 10)
                out["piece"].append(" ".join(w[k:k + 10]))
        return out
    return run


@register("u1_user_batch_function",
          O.WITH_PAIRS + f"SELECT id, part, {O.join('w[10 * part + 1:10 * part + 10]')} AS piece FROM "
          f"(SELECT id, w, unnest(range((len(w) + 9) // 10)) AS part FROM (SELECT id, {O.words('translation')} AS w FROM pairs))")
def u1(spark, sf_dir):
    """A user's function over batches that drops columns and changes the number of rows."""
    return INF.map_batches(FX.pairs(spark, sf_dir).select("id", "gloss", "translation"), _chunker, "id string, part long, piece string", batch_rows=100)


# --- J6 with a user's table ----------------------------------------------------------------

@register("j6_user_dictionary",
          O.WITH_PAIRS + f"SELECT id, count(*) AS n_tokens, count(*) FILTER (WHERE t IN (SELECT DISTINCT lower(text[1:4]) FROM documents)) AS n_known FROM "
          f"(SELECT id, unnest({O.words('lower(translation)')}) AS t FROM pairs) GROUP BY id")
def j6(spark, sf_dir):
    """Every token looked up in a table of entries (the first four letters of documents), by a join of a measured size."""
    from glosspark.session import table
    entries = table(spark, sf_dir, "documents").select(F.lower(F.substring("text", 1, 4)).alias("token")).distinct().withColumn("known", F.lit(1))
    tokens = FX.pairs(spark, sf_dir).select("id", F.explode(words(F.lower("translation"))).alias("token"))
    return J.lookup_tokens(tokens, entries, "token", spread="id").groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("known").alias("n_known"))


# --- V3, V6, V7 ------------------------------------------------------------------------------

@register("v3_batches_of_32",
          O.with_views(*O.BASE, CC._K3, CC._TRAIN, CC._VOCAB, CC._ENC,
                       "b AS (SELECT id, ids, (row_number() OVER (ORDER BY len(ids), id) - 1) // 32 AS batch FROM enc)",
                       "m AS (SELECT batch, max(len(ids)) AS mx FROM b GROUP BY 1)")
          + "SELECT id, batch, array_to_string(list_concat(ids, list_transform(range(mx - len(ids)), lambda x: 0)), ' ') AS padded FROM b JOIN m USING (batch)")
def v3_batches(spark, sf_dir):
    """V3: batches of 32 sequences of similar length, each padded to its own longest."""
    sp, vocab = CC._vocab_spark(spark, sf_dir)
    batched = V.form_batches(V.encode(sp, "translation", vocab), "ids", 32, order=["id"])
    return batched.select("id", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("padded"))


@register("v6_v7_drop_and_mask",
          O.with_views(*O.BASE, CC._K3, CC._TRAIN, CC._VOCAB, CC._ENC,
                       "c AS (SELECT id, list_transform(list_concat(ids, [0, 0]), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS l FROM enc)",
                       "d AS (SELECT id, list_filter(list_transform(l, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), lambda x: x >= 0 AND x < 500) AS k FROM c)")
          + "SELECT id, array_to_string(k, ' ') AS kept, array_to_string(list_transform(k, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END), ' ') AS mask FROM d")
def v6_v7(spark, sf_dir):
    """V6 with ids out of range dropped, V7 padding mask."""
    sp, vocab = CC._vocab_spark(spark, sf_dir)
    padded = F.concat("ids", F.array(F.lit(0), F.lit(0)))
    d = V.encode(sp, "translation", vocab).select("id", V.sanitize(V.labels_from(padded), 500, mode="drop").alias("k"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), " ")
    return d.select("id", text(F.col("k")).alias("kept"), text(V.padding_mask(F.col("k"))).alias("mask"))


# --- M11 with direction ----------------------------------------------------------------------

_BOTH = ("both_ways AS (SELECT p.id || ':g2t' AS id, p.prediction, p.reference, d.lang AS dataset, 'g2t' AS direction FROM preds p JOIN documents d USING (doc_id) "
         "UNION ALL SELECT p.id || ':t2g', p.pred_gloss, p.ref_gloss, d.lang, 't2g' FROM preds p JOIN documents d USING (doc_id))")


@register("m11_metrics_by_direction",
          f"SELECT dataset, direction, {CT._MEANS}, count(*) AS n_pairs FROM ("
          + OM.per_pair_metrics_sql(src_ctes=O.BASE + (O.PREDS, _BOTH), src="both_ways", keep=",dataset,direction") + ") GROUP BY dataset, direction")
def m11_direction(spark, sf_dir):
    """The metric table by dataset and direction."""
    p = FX.preds(spark, sf_dir, extra=("lang",))
    ways = F.explode(F.array(F.struct(F.lit("g2t").alias("direction"), F.col("prediction"), F.col("reference")),
                             F.struct(F.lit("t2g").alias("direction"), F.col("pred_gloss").alias("prediction"), F.col("ref_gloss").alias("reference"))))
    both = p.select("id", F.col("lang").alias("dataset"), ways.alias("w")).select("id", "dataset", "w.*")
    return MC.metric_means(MP.score_pairs(both).drop("prediction", "reference"), ["dataset", "direction"])
