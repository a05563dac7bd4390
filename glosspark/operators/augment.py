"""Row generators: every variant is an `explode` of an array built
in the row, so augmentation is a narrow, shuffle-free step. Random draws are
content hashes of (seed, purpose, id), integer-compared against p * 2^60."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.functions import lexicon as L
from glosspark.functions.prompts import render
from glosspark.functions.text import join_words, rx, strip, words
from glosspark.operators.ordinals import hash60

SCALE = 1 << 60


def draw(seed, purpose: str, key: Column) -> Column:
    """Uniform 60-bit integer for (seed, purpose, key)."""
    return hash60(F.lit(str(seed)), F.lit(purpose), key)


def below(u: Column, p: float) -> Column:
    return u < F.lit(int(p * SCALE))


def prompt_fanout(df: DataFrame, templates: list[str], target_col: str, gloss="gloss", text="translation",
                  dataset: str = "", id_col: str = "id") -> DataFrame:
    """A1/A2: one row per template: (id, variant, input_text, target_text)."""
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), render(t, gloss, text, dataset).alias("input_text"))
                         for k, t in enumerate(templates)])
    return df.select(F.col(id_col).alias("id"), F.col(target_col).alias("target_text"),
                     F.explode(variants).alias("v")) \
             .select("id", "v.variant", "v.input_text", "target_text")


def drop_articles(c) -> Column:
    """A3 variant text: remove 'a ' then 'an ' (whole word, lower case only)."""
    return rx(rx(c, r"\ba\s+", ""), r"\ban\s+", "")


def article_variants(df: DataFrame, input_col: str = "input_text", target_col: str = "target_text",
                     id_col: str = "id") -> DataFrame:
    """A3: original row, plus a row without a/an when that changes the text and is not blank."""
    mod = drop_articles(F.col(input_col))
    extra = (strip(mod) != "") & (mod != F.col(input_col))
    rows = F.filter(F.array(
        F.struct(F.lit(0).alias("variant"), F.col(input_col).alias("input_text"), F.lit(True).alias("keep")),
        F.struct(F.lit(1).alias("variant"), mod.alias("input_text"), extra.alias("keep"))),
        lambda r: r["keep"])
    return df.select(F.col(id_col).alias("id"), F.col(target_col).alias("target_text"), F.explode(rows).alias("r")) \
             .select("id", "r.variant", "r.input_text", "target_text")


def noise_copies(df: DataFrame, p_copy: float = 0.3, p_drop: float = 0.1, seed=L.DEFAULT_SEED,
                 gloss: str = "gloss", text: str = "translation", id_col: str = "id") -> DataFrame:
    """A4: with p_copy add row `<id>_aug`; inside it, with p_drop and more than 3 words,
    one uniformly chosen word of the gloss is deleted (words re-joined by single spaces)."""
    key = F.col(id_col)
    # the draws are materialised first: a lambda would otherwise re-hash per token
    staged = df.select(key.alias("_id"), F.col(gloss).alias("_g"), F.col(text).alias("_tx"),
                       words(F.col(gloss)).alias("_toks"),
                       draw(seed, "a4-pick", key).alias("_pick"),
                       below(draw(seed, "a4-drop", key), p_drop).alias("_drop"),
                       below(draw(seed, "a4-copy", key), p_copy).alias("_copy"))
    toks, n = F.col("_toks"), F.size("_toks")
    k = F.pmod(F.col("_pick"), F.greatest(n, F.lit(1)))
    dropped = F.when(k >= 0, F.filter(toks, lambda t, i: i != k))
    noisy = join_words(F.when(F.col("_drop") & (n > 3), dropped).otherwise(toks))
    rows = F.filter(F.array(
        F.struct(F.col("_id").alias("id"), F.col("_g").alias("gloss"), F.lit(True).alias("keep")),
        F.struct(F.concat(F.col("_id"), F.lit("_aug")).alias("id"), noisy.alias("gloss"), F.col("_copy").alias("keep"))),
        lambda r: r["keep"])
    return staged.select(F.col("_tx").alias("translation"), F.explode(rows).alias("r")) \
                 .select("r.id", "r.gloss", "translation")


def paraphrase(text: Column) -> Column:
    """First listed phrase contained in the lower-cased text is replaced everywhere."""
    low = F.lower(text)
    out = None
    for old, new in L.PARAPHRASES:
        cond = F.instr(low, old) > 0
        rep = F.replace(low, F.lit(old), F.lit(new))
        out = F.when(cond, rep) if out is None else out.when(cond, rep)
    return out.otherwise(text)


def simplify_gloss(gloss: Column) -> Column:
    toks = words(gloss)
    kept = F.filter(toks, lambda t: ~t.isin(*L.OPTIONAL_GLOSS_TOKENS))
    ok = (F.size(kept) < F.size(toks)) & (F.size(kept) > 2)
    return F.when(ok, join_words(kept)).otherwise(gloss)


def paired_augment(df: DataFrame, p: float = 0.15, seed=L.DEFAULT_SEED, text: str = "input_text",
                   gloss: str = "target_gloss", id_col: str = "id") -> DataFrame:
    """A5: with probability p pick paraphrase / simplify / none uniformly; emit `<id>_aug`
    only when the pair changed."""
    key = F.col(id_col)
    hit = ~(draw(seed, "a5-apply", key) > F.lit(int(p * SCALE)))
    kind = F.pmod(draw(seed, "a5-kind", key), F.lit(3))
    t2 = F.when(hit & (kind == 0), paraphrase(F.col(text))).otherwise(F.col(text))
    g2 = F.when(hit & (kind == 1), simplify_gloss(F.col(gloss))).otherwise(F.col(gloss))
    changed = (t2 != F.col(text)) | (g2 != F.col(gloss))
    rows = F.filter(F.array(
        F.struct(key.alias("id"), F.col(text).alias("input_text"), F.col(gloss).alias("target_gloss"),
                 F.lit(True).alias("keep")),
        F.struct(F.concat(key, F.lit("_aug")).alias("id"), t2.alias("input_text"), g2.alias("target_gloss"),
                 changed.alias("keep"))),
        lambda r: r["keep"])
    return df.select(F.explode(rows).alias("r")).select("r.id", "r.input_text", "r.target_gloss")
