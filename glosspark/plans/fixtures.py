"""Corpus views derived from the driver tables (no gloss data exists).

Glosses are derived deterministically from text lines so that the same view
can be rebuilt in SQL for the oracle (see `glosspark.plans.oracle`):

* `doc_lines` - every line of every document: (doc_id, pos, line).
* `pairs`     - id `doc_pos`, translation = line, gloss = upper-cased line
                without punctuation, with gloss markers injected by token
                position so the gloss rules fire.
* `dialog`    - user turn t joined to the assistant turn t+1 of a conversation.
* `preds`     - reference = line, hypothesis = line with tokens dropped,
                some empty hypotheses; and the same for glosses.
* `raw_lines` - pairs rendered as text-file lines `id<delim>value` with the
                delimiter chosen by doc_id % 4, plus comment and blank lines,
                numbered by a dense ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions.text import join_words, words
from glosspark.operators.ordinals import sorted_ordinal
from glosspark.session import ensure_parallelism, table

# --- fixed values of the derivation (shared with the SQL twin) ---------------
PRONOUN_MARKERS = ["X-I", "X-WE", "X-Y", "X-THEY"]
HYP_DROPPED_WORDS = ["the", "a", "an", "le", "la", "les", "der", "die", "das", "el"]


def derive_gloss(line) -> F.Column:
    """Upper-case, drop punctuation, inject markers by token position."""
    u = F.regexp_replace(F.upper(line), r"[^\p{L}\p{N}\s]", "")
    toks = F.filter(F.split(u, r"\s+"), lambda t: t != "")
    markers = F.array(*[F.lit(m) for m in PRONOUN_MARKERS])

    def mark(t, i):
        k = i % 9
        grp = F.floor(i / 9)
        return (F.when(k == 1, F.concat(F.lit("DESC-"), t))
                .when(k == 4, F.concat(t, F.lit(" X-POSS")))
                .when(k == 6, F.concat(F.get(markers, (grp % 4).cast("int")), F.lit(" "), t))
                .when((k == 7) & (grp % 3 == 0), F.concat(F.lit("MEMBERSHIP PARLIAMENT "), t))
                .otherwise(t))

    return F.array_join(F.transform(toks, mark), " ")


def doc_lines(spark: SparkSession, sf_dir: str, extra: tuple = ()) -> DataFrame:
    """Every line of every document; `extra` document columns (e.g. lang) ride along,
    so per-dataset reports need no join back to the documents table."""
    docs = ensure_parallelism(table(spark, sf_dir, "documents").select("doc_id", "text", *extra), "doc_id")
    return docs.select("doc_id", *extra, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def pairs(spark: SparkSession, sf_dir: str, extra: tuple = ()) -> DataFrame:
    return line_pairs(doc_lines(spark, sf_dir, extra), extra)


def line_pairs(lines: DataFrame, extra: tuple = ()) -> DataFrame:
    """(doc_id, pos, line) -> pairs."""
    return lines.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id"),
        "doc_id", "pos",
        derive_gloss(F.col("line")).alias("gloss"),
        F.col("line").alias("translation"), *extra)


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over conversations: user turn t  join  assistant turn t+1 (inner, equi)."""
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("u_text"))
    a = conv.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("a_text"))
    j = u.join(a, (u.conv_id == a.a_conv) & (a.a_turn == u.u_turn + 1), "inner")
    return j.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("u_turn").cast("string")).alias("id"),
        derive_gloss(F.col("u_text")).alias("gloss"),
        F.col("a_text").alias("translation"))


def derive_hypothesis(line, doc_id, pos) -> F.Column:
    toks = words(line)
    drop_pos = join_words(F.filter(toks, lambda t, i: i % 7 != 3))
    drop_art = join_words(F.filter(toks, lambda t: ~F.lower(t).isin(*HYP_DROPPED_WORDS)))
    return (F.when(pos % 11 == 10, F.lit(""))
            .when(doc_id % 3 == 0, drop_pos)
            .when(doc_id % 3 == 1, drop_art)
            .otherwise(line))


def derive_gloss_hypothesis(gloss) -> F.Column:
    toks = words(gloss)
    kept = F.filter(toks, lambda t, i: i % 5 != 2)
    return join_words(F.transform(kept, lambda t, i: F.when(i % 4 == 3, F.lower(t)).otherwise(t)))


def preds(spark: SparkSession, sf_dir: str, extra: tuple = ()) -> DataFrame:
    """Prediction/reference pairs for the metric operators (one per document line)."""
    p = pairs(spark, sf_dir, extra)
    return p.select(
        "id", "doc_id", "pos", *extra,
        F.col("translation").alias("reference"),
        derive_hypothesis(F.col("translation"), F.col("doc_id"), F.col("pos")).alias("prediction"),
        F.col("gloss").alias("ref_gloss"),
        derive_gloss_hypothesis(F.col("gloss")).alias("pred_gloss"))


def raw_lines(spark: SparkSession, sf_dir: str, side: str = "gloss") -> DataFrame:
    """Text-file lines (ord, value) rendered from `pairs`; `side` picks gloss or translation.

    Plain lines are sorted and numbered, then rendered: the sort's sampling pass reads its input a second time."""
    p = line_pairs(sorted_ordinal(doc_lines(spark, sf_dir), ["doc_id", "pos"]), ("ord",))
    v = F.col(side)
    rendered = (F.when(F.col("pos") % 10 == 9, F.concat(F.lit("# "), v))
                .when(F.col("doc_id") % 4 == 0, F.concat_ws("\t", "id", v))
                .when(F.col("doc_id") % 4 == 1, F.concat_ws("|", "id", v))
                .when(F.col("doc_id") % 4 == 2, F.concat_ws("::", "id", v))
                .otherwise(v))
    return p.select("ord", rendered.alias("value"))


def derive_variant(line) -> F.Column:
    """A prediction in other words: some tokens inflected, some replaced by `syn` + token, some dropped."""
    plain = lambda t: t.rlike(r"\A[a-z]{4,}\z")

    def change(t, i):
        return (F.when(plain(t) & (i % 5 == 1), F.concat(t, F.lit("s")))
                .when(plain(t) & (i % 5 == 2), F.concat(F.lit("syn"), t))
                .when(plain(t) & (i % 5 == 3), F.concat(t, F.lit("ing")))
                .otherwise(t))
    return join_words(F.filter(F.transform(words(line), change), lambda t, i: i % 7 != 6))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that only stems and synonyms align with their reference."""
    return pairs(spark, sf_dir).select("id", F.col("translation").alias("reference"), derive_variant(F.col("translation")).alias("prediction"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, synonym): `syn` + token for every plain token of the corpus."""
    tokens = doc_lines(spark, sf_dir).select(F.explode(words(F.col("line"))).alias("synonym")).filter(F.col("synonym").rlike(r"\A[a-z]{4,}\z")).distinct()
    return tokens.select(F.concat(F.lit("syn"), F.col("synonym")).alias("word"), "synonym")


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as one pair each: some run to thousands of tokens."""
    docs = ensure_parallelism(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), text.alias("reference"), join_words(F.filter(words(text), lambda t, i: i % 7 != 3)).alias("prediction"))
