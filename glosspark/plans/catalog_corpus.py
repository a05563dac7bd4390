"""Registered corpus queries (sources, joins, filters, splits, prompts, augmentation,
vocabulary, profile, inference) with their DuckDB twins."""

from __future__ import annotations

import math  # noqa: F401  (SQL builders mirror the Python cut rules)

from pyspark.sql import functions as F

from glosspark.functions import lexicon as L
from glosspark.functions import normalize as N
from glosspark.functions import prompts as P
from glosspark.operators import augment as A
from glosspark.operators import joins as J
from glosspark.operators import splits as SP
from glosspark.operators import vocab as V
from glosspark.plans import corpus as C
from glosspark.plans import fixtures as FX
from glosspark.plans import oracle as O
from glosspark.plans.catalog import register
from glosspark.session import table
from glosspark.sources import lines as SL
from glosspark.sources import loaders as LD
from glosspark.sources import tables as ST

SEED = L.DEFAULT_SEED


# --- SQL building blocks --------------------------------------------------------

def h60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def content(cols: list[str]) -> str:
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(cols))


def keyed(src: str, cols: list[str], name: str, key: str = "id", seed=SEED) -> str:
    """CTE `name`: src rows + rank rn (1-based) in (hash(seed:key), hash(row)) order + n."""
    return (f"{name} AS (SELECT *, row_number() OVER (ORDER BY _h, _t) AS rn, count(*) OVER () AS n FROM "
            f"(SELECT *, {h60(repr(str(seed)), key)} AS _h, {h60(content(cols))} AS _t FROM {src}))")


BAND_COLS = ["id", "doc_id", "pos", "original_gloss", "original_text", "gloss", "text"]

PREP_T2G = (f"prep AS (SELECT id, doc_id, pos, gloss AS original_gloss, translation AS original_text, "
            f"{O.process_gloss_target('gloss')} AS gloss, {O.process_text('translation')} AS text FROM pairs "
            "WHERE gloss IS NOT NULL AND translation IS NOT NULL)")
PREP_G2T = (f"prep AS (SELECT id, doc_id, pos, gloss AS original_gloss, translation AS original_text, "
            f"{O.process_gloss_v2('gloss')} AS gloss, {O.process_target_text('translation')} AS text FROM pairs "
            "WHERE gloss IS NOT NULL AND translation IS NOT NULL)")
BAND = ("band AS (SELECT * FROM prep WHERE length(gloss) > 10 AND length(text) > 10 "
        "AND length(gloss) < 500 AND length(text) < 500)")
W_BAND = O.with_views(*O.BASE, PREP_T2G, BAND)
SP1_CTE = keyed("band", BAND_COLS, "k1")
SP1_SPLIT = "CASE WHEN rn <= ceil(0.2 * n) THEN 'validation' ELSE 'train' END"


# --- entry / flagship -------------------------------------------------------------

@register("e0_flagship_profile",
          O.with_views(*O.BASE, PREP_T2G, BAND, SP1_CTE)
          + f"SELECT {SP1_SPLIT} AS split, count(*) AS n_pairs, round(avg(length(text)), 6) AS avg_text_chars, "
            "round(avg(length(gloss)), 6) AS avg_gloss_chars FROM k1 GROUP BY 1")
def e0(spark, sf_dir):
    return C.flagship(spark, sf_dir)


# --- F*: filters and sampling --------------------------------------------------

@register("f1_f3_prepared_t2g", W_BAND + "SELECT * FROM band")
def f1_f3(spark, sf_dir):
    """F1 null drop, F7 originals, T9a/T9b, F3 band (C9 preprocessing)."""
    return C.prepared_t2g(spark, sf_dir)


@register("f3_prepared_g2t", O.with_views(*O.BASE, PREP_G2T, BAND) + "SELECT * FROM band")
def f3_g2t(spark, sf_dir):
    """C4 preprocessing: gloss v2 + target text normalisers, then the band."""
    return C.prepared_g2t(spark, sf_dir)


@register("f2_nonempty_clean_pair",
          O.WITH_PAIRS + f"SELECT id, {O.clean_gloss('gloss')} AS gloss, {O.clean_translation('translation')} AS "
          f"translation FROM pairs WHERE length({O.clean_gloss('gloss')}) > 0 AND "
          f"length({O.clean_translation('translation')}) > 0")
def f2(spark, sf_dir):
    """T1 + F2: clean both sides, keep rows non-empty on both."""
    p = FX.pairs(spark, sf_dir).select("id", N.clean_gloss(F.col("gloss")).alias("gloss"),
                                       N.clean_translation(F.col("translation")).alias("translation"))
    return p.filter((F.length("gloss") > 0) & (F.length("translation") > 0))


@register("f6_sample_exact_2000",
          O.with_views(*O.BASE, PREP_T2G, BAND, SP1_CTE) + "SELECT id, gloss, text FROM k1 WHERE rn <= 2000")
def f6(spark, sf_dir):
    """seeded sample of exactly 2000 prepared pairs (originals carried)."""
    return SP.sample_exact(C.prepared_t2g(spark, sf_dir), 2000).select("id", "gloss", "text")


@register("f9_validation_head",
          O.with_views(*O.BASE, PREP_T2G, BAND, SP1_CTE)
          + f"SELECT id, text FROM k1 WHERE {SP1_SPLIT} = 'validation' ORDER BY rn LIMIT 50")
def f9(spark, sf_dir):
    """first 50 validation pairs in their shuffled order (a top-k report)."""
    v = SP.train_validation(C.prepared_t2g(spark, sf_dir)).filter(F.col("split") == "validation").drop("split")
    return SP.head_in_order(v, 50).select("id", "text")


# --- SP*: splits ------------------------------------------------------------------

@register("sp1_train_validation",
          O.with_views(*O.BASE, PREP_T2G, BAND, SP1_CTE) + f"SELECT id, {SP1_SPLIT} AS split FROM k1")
def sp1(spark, sf_dir):
    return SP.train_validation(C.prepared_t2g(spark, sf_dir)).select("id", "split")


PAIR_COLS = ["id", "doc_id", "pos", "gloss", "translation"]


@register("sp3_three_way_floors",
          O.with_views(*O.BASE, keyed("pairs", PAIR_COLS, "k3"))
          + "SELECT id, CASE WHEN rn <= floor(0.8 * n) THEN 'train' "
            "WHEN rn <= floor(0.8 * n) + floor(0.1 * n) THEN 'val' ELSE 'test' END AS split FROM k3")
def sp3(spark, sf_dir):
    """SP3 over every document line (C12's 80/10/10 by floors)."""
    return SP.three_way_floors(FX.pairs(spark, sf_dir)).select("id", "split")


# --- A*: augmentation -------------------------------------------------------------

def _a4_sql() -> str:
    src = (f"c6 AS (SELECT id, {O.clean_text('gloss')} AS gloss, {O.clean_text('translation')} AS translation "
           "FROM pairs)")
    w = O.words("gloss")
    d = lambda purpose: h60(repr(str(SEED)), repr(purpose), "id")
    k = f"(({d('a4-pick')}) % greatest(len({w}), 1))"
    dropped = O.join(f"list_filter({w}, lambda t, i: i - 1 <> {k})")
    noisy = (f"CASE WHEN {d('a4-drop')} < {int(0.1 * A.SCALE)} AND len({w}) > 3 THEN {dropped} "
             f"ELSE {O.join(w)} END")
    return (O.with_views(*O.BASE, src)
            + f"SELECT id, gloss, translation FROM c6 UNION ALL "
              f"SELECT id || '_aug' AS id, {noisy} AS gloss, translation FROM c6 "
              f"WHERE {d('a4-copy')} < {int(0.3 * A.SCALE)}")


def _c6(spark, sf_dir):
    p = FX.pairs(spark, sf_dir)
    return p.select("id", N.clean_text(F.col("gloss")).alias("gloss"),
                    N.clean_text(F.col("translation")).alias("translation"))


@register("a4_noise_copies", _a4_sql())
def a4(spark, sf_dir):
    """A4 (C6): T2 cleaning, then 30 % noisy copies `<id>_aug`."""
    return A.noise_copies(_c6(spark, sf_dir))


@register("sp2_three_way_halves_augmented",
          O.with_views(*O.BASE, "a4 AS (" + _a4_sql().replace("WITH ", "SELECT * FROM (WITH ", 1) + "))",
                       keyed("a4", ["id", "gloss", "translation"], "k2"))
          + "SELECT id, CASE WHEN rn <= ceil(0.5 * ceil(0.2 * n)) THEN 'test' WHEN rn <= ceil(0.2 * n) "
            "THEN 'eval' ELSE 'train' END AS split FROM k2")
def sp2(spark, sf_dir):
    """SP2: split after augmenting (reference mode), 80/10/10 via halves."""
    return SP.three_way_halves(a4(spark, sf_dir)).select("id", "split")


@register("sp5_grouped_split",
          O.with_views(*O.BASE, "a4 AS (" + _a4_sql().replace("WITH ", "SELECT * FROM (WITH ", 1) + "))",
                       "par AS (SELECT DISTINCT regexp_replace(id, '_aug$', '') AS id FROM a4)",
                       keyed("par", ["id"], "kp"))
          + "SELECT a4.id, CASE WHEN kp.rn <= ceil(0.2 * kp.n) THEN 'validation' ELSE 'train' END AS split "
            "FROM a4 JOIN kp ON kp.id = regexp_replace(a4.id, '_aug$', '')")
def sp5(spark, sf_dir):
    """SP5 leak-safe mode: augmented copies follow their parent."""
    return SP.grouped_train_validation(a4(spark, sf_dir)).select("id", "split")


def _c13_sql_src() -> str:
    return (f"c13 AS (SELECT id, {O.process_english_text('translation')} AS input_text, "
            f"{O.preserve_gloss_notation('gloss')} AS target_gloss FROM pairs), "
            "c13f AS (SELECT * FROM c13 WHERE length(input_text) > 0 AND length(target_gloss) > 0)")


def _a5_sql() -> str:
    d = lambda purpose: h60(repr(str(SEED)), repr(purpose), "id")
    low = "lower(input_text)"
    para = "CASE " + " ".join(f"WHEN contains({low}, {O.q(a)}) THEN replace({low}, {O.q(a)}, {O.q(b)})"
                              for a, b in L.PARAPHRASES) + " ELSE input_text END"
    w = O.words("target_gloss")
    opt = ", ".join(O.q(t) for t in L.OPTIONAL_GLOSS_TOKENS)
    kept = f"list_filter({w}, lambda t: t NOT IN ({opt}))"
    simp = f"CASE WHEN len({kept}) < len({w}) AND len({kept}) > 2 THEN {O.join(kept)} ELSE target_gloss END"
    hit = f"NOT ({d('a5-apply')} > {int(0.15 * A.SCALE)})"
    kind = f"({d('a5-kind')} % 3)"
    t2 = f"CASE WHEN {hit} AND {kind} = 0 THEN {para} ELSE input_text END"
    g2 = f"CASE WHEN {hit} AND {kind} = 1 THEN {simp} ELSE target_gloss END"
    return (O.with_views(*O.BASE, _c13_sql_src(),
                         f"aug AS (SELECT id, input_text, target_gloss, {t2} AS t2, {g2} AS g2 FROM c13f)")
            + "SELECT id, input_text, target_gloss FROM aug UNION ALL "
              "SELECT id || '_aug', t2, g2 FROM aug WHERE t2 <> input_text OR g2 <> target_gloss")


@register("a5_paired_augment", _a5_sql())
def a5(spark, sf_dir):
    """A5 (C13): T18 text, T17 gloss, F2, then paraphrase/simplify copies."""
    p = FX.pairs(spark, sf_dir).select("id", N.process_english_text(F.col("translation")).alias("input_text"),
                                       N.preserve_gloss_notation(F.col("gloss")).alias("target_gloss"))
    p = p.filter((F.length("input_text") > 0) & (F.length("target_gloss") > 0))
    return A.paired_augment(p)


def _render_sql(template: str, gloss: str, text: str, ds: str = "") -> str:
    parts = []
    for k, v in P.template_parts(template):
        if k == "lit":
            parts.append(O.q(v))
        else:
            parts.append({"gloss": gloss, "text": text, "ds": O.q(ds), "DS": O.q(ds.upper())}[v])
    return "(" + " || ".join(parts) + ")"


_A1_T = [P.NOTEBOOK["t2g_asl"], L.FANOUT_T2G + "{text}"]


@register("a1_prompt_fanout",
          W_BAND + "SELECT id, v.variant, v.input_text, gloss AS target_text FROM band, "
          "unnest([" + ", ".join(f"{{'variant': {k}, 'input_text': {_render_sql(t, 'gloss', 'text')}}}"
                                for k, t in enumerate(_A1_T)) + "]) AS u(v)")
def a1(spark, sf_dir):
    """A1 (C9): main prompt plus 'convert text to gloss:' per prepared pair."""
    return A.prompt_fanout(C.prepared_t2g(spark, sf_dir), _A1_T, "gloss", text="text")


@register("a2_flan_fanout",
          W_BAND + "SELECT id, v.variant, v.input_text, gloss AS target_text FROM band, "
          "unnest([" + ", ".join(f"{{'variant': {k}, 'input_text': {_render_sql(t, 'gloss', 'text')}}}"
                                for k, t in enumerate(P.FLAN_T2G_VARIANTS)) + "]) AS u(v)")
def a2(spark, sf_dir):
    """A2 (C10): three instruction phrasings per pair."""
    return A.prompt_fanout(C.prepared_t2g(spark, sf_dir), P.FLAN_T2G_VARIANTS, "gloss", text="text")


def _drop_articles_sql(x: str) -> str:
    t = O.wrap(x)
    t = O.rs(t, r"\x01a\x02" + O.WS + "+", "")
    t = O.rs(t, r"\x01an\x02" + O.WS + "+", "")
    return O.unwrap(t)


@register("a3_article_variants",
          W_BAND + "SELECT id, 0 AS variant, text AS input_text, gloss AS target_text FROM band UNION ALL "
          f"SELECT id, 1, m, gloss FROM (SELECT id, gloss, text, {_drop_articles_sql('text')} AS m FROM band) "
          f"WHERE {O.strip('m')} <> '' AND m <> text")
def a3(spark, sf_dir):
    """A3 (C11): extra row with 'a'/'an' removed when that changes the text."""
    b = C.prepared_t2g(spark, sf_dir).select("id", F.col("text").alias("input_text"), F.col("gloss").alias("target_text"))
    return A.article_variants(b)


# --- P*: prompts ----------------------------------------------------------------------

def _p_sql(templates: dict[str, str], ds: str, target_of) -> str:
    rows = ", ".join(
        f"{{'task': {O.q(task)}, 'training_text': {_render_sql(t, 'gloss', 'text', ds)}, 'target': {target_of(task)}}}"
        for task, t in templates.items())
    return W_BAND + f"SELECT id, v.task, v.training_text, v.target FROM band, unnest([{rows}]) AS u(v)"


def _p_spark(spark, sf_dir, templates, ds):
    b = C.prepared_t2g(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(task).alias("task"), P.render(t, "gloss", "text", ds).alias("training_text"),
                              P.target(task, "gloss", "text").alias("target")) for task, t in templates.items()])
    return b.select("id", F.explode(rows).alias("v")).select("id", "v.task", "v.training_text", "v.target")


_TGT = lambda task: "text" if task == "g2t" else "gloss"


@register("p1_p5_seq2seq_both_tasks", _p_sql(P.SEQ2SEQ, "aslg", _TGT))
def p1(spark, sf_dir):
    """P1 + P5 'both': seq2seq prompts for g2t and t2g with their targets."""
    return _p_spark(spark, sf_dir, P.SEQ2SEQ, "aslg")


@register("p2_chat_training_prompts", _p_sql(P.CHAT_TRAIN, "aslg", _TGT))
def p2(spark, sf_dir):
    """Chat-format training prompts (target embedded), dataset name upper-cased."""
    return _p_spark(spark, sf_dir, P.CHAT_TRAIN, "aslg")


_P4 = dict(P.NOTEBOOK, rules_train=P.RULES_TRAIN_T2G, rules_infer=P.RULES_INFER_T2G,
           infer_g2t=P.CHAT_INFER["g2t"], infer_t2g=P.CHAT_INFER["t2g"])


@register("p3_p4_template_registry", _p_sql(_P4, "aslg", lambda task: "text" if "g2t" in task else "gloss"))
def p4(spark, sf_dir):
    """P3 + P4: inference prompts and every notebook template, one row per template."""
    b = C.prepared_t2g(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(k).alias("task"), P.render(t, "gloss", "text", "aslg").alias("training_text"),
                              F.col("text" if "g2t" in k else "gloss").alias("target")) for k, t in _P4.items()])
    return b.select("id", F.explode(rows).alias("v")).select("id", "v.task", "v.training_text", "v.target")


# --- S*: line sources over rendered fixture lines ---------------------------------------

RAW = O.with_views(*O.BASE, O.raw_lines_cte("gloss"))
_SQ_V = f"{O.strip('value')}"


def _s1_body(fmt: str, aslg: bool, src: str = "raw_lines", value_name: str = "gloss") -> str:
    """Self-contained S1 query over a (ord, value) relation `src`."""
    delims = [("chr(9)", "chr(9)")] + ([("'|'", "'|'"), ("'::'", "'::'")] if fmt == "auto" else [])
    dl = "CASE " + " ".join(f"WHEN contains(v, {a}) THEN {b}" for a, b in delims) + " END"
    base = (f"WITH kept AS (SELECT ord, v, {dl} AS dl FROM (SELECT ord, {_SQ_V} AS v FROM {src}) "
            "WHERE v <> '' AND NOT starts_with(v, '#')) ")
    hit = ("SELECT " + O.strip("substr(v, 1, strpos(v, dl) - 1)") + " AS id, "
           + O.strip("substr(v, strpos(v, dl) + length(dl))") + f" AS {value_name} FROM kept WHERE dl IS NOT NULL")
    if aslg:
        hit += f" UNION ALL SELECT printf('aslg_%06d', ord) AS id, v AS {value_name} FROM kept WHERE dl IS NULL"
    return base + hit


def _s1_sql(fmt: str, aslg: bool) -> str:
    return O.with_views(*O.BASE, O.raw_lines_cte("gloss")) + "SELECT * FROM (" + _s1_body(fmt, aslg) + ")"


@register("s1_parse_pairs_auto", _s1_sql("auto", False))
def s1(spark, sf_dir):
    return SL.parse_pairs(FX.raw_lines(spark, sf_dir), "gloss")


@register("s1_parse_pairs_aslg", _s1_sql("aslg", True))
def s1_aslg(spark, sf_dir):
    """S1 with the ASLG format: TAB only, undelimited lines numbered aslg_%06d."""
    return SL.parse_pairs(FX.raw_lines(spark, sf_dir), "gloss", fmt="aslg")


def _s2_sql(rejects: bool) -> str:
    dl = "CASE WHEN contains(v, chr(9)) THEN chr(9) WHEN contains(v, '|') THEN '|' WHEN contains(v, '::') THEN '::' END"
    rxp = r"^(\S+)\s+(.+)$"
    base = (f"kept AS (SELECT ord, v, {dl} AS dl, regexp_matches(v, {O.q(rxp)}) AS lo FROM "
            f"(SELECT ord, {_SQ_V} AS v FROM raw_lines) WHERE v <> '' AND NOT starts_with(v, '#'))")
    if rejects:
        body = "SELECT ord + 1 AS line_num, substr(v, 1, 50) AS snippet FROM kept WHERE dl IS NULL AND NOT lo"
    else:
        body = ("SELECT " + O.strip("substr(v, 1, strpos(v, dl) - 1)") + " AS id, "
                + O.strip("substr(v, strpos(v, dl) + length(dl))") + " AS gloss FROM kept WHERE dl IS NOT NULL "
                f"UNION ALL SELECT regexp_extract(v, {O.q(rxp)}, 1), regexp_extract(v, {O.q(rxp)}, 2) "
                "FROM kept WHERE dl IS NULL AND lo")
    return O.with_views(*O.BASE, O.raw_lines_cte("gloss"), base) + body


@register("s2_parse_loose", _s2_sql(False))
def s2(spark, sf_dir):
    return SL.parse_pairs_loose(FX.raw_lines(spark, sf_dir), "gloss")[0]


@register("s2_parse_loose_rejects", _s2_sql(True))
def s2r(spark, sf_dir):
    return SL.parse_pairs_loose(FX.raw_lines(spark, sf_dir), "gloss")[1]


@register("s3a_tab_fields",
          RAW + f"SELECT string_split({_SQ_V}, chr(9))[1] AS id, string_split({_SQ_V}, chr(9))[2] AS gloss "
                "FROM raw_lines")
def s3a(spark, sf_dir):
    return SL.parse_tab_fields(FX.raw_lines(spark, sf_dir), "gloss")


@register("s3b_tab_exact",
          RAW + f"SELECT ord, string_split({_SQ_V}, chr(9))[2] AS gloss FROM raw_lines "
                f"WHERE len(string_split({_SQ_V}, chr(9))) = 2")
def s3b(spark, sf_dir):
    return SL.parse_tab_exact(FX.raw_lines(spark, sf_dir), "gloss")


def _pipe_lines_sql() -> str:
    return ("pipe AS (SELECT doc_id % 3 AS part, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id, pos) - 1 "
            "AS ord, CASE WHEN pos % 10 = 9 THEN '' ELSE gloss || ' | ' || translation || ' |x' END AS value "
            "FROM pairs)")


@register("s4_pipe_splits",
          O.with_views(*O.BASE, _pipe_lines_sql())
          + "SELECT printf('%s_%06d', ['train', 'dev', 'test'][part + 1], ord) AS id, "
          + O.strip(f"string_split({_SQ_V}, '|')[1]") + " AS gloss, "
          + O.strip(f"string_split({_SQ_V}, '|')[2]") + " AS translation, "
          "['train', 'dev', 'test'][part + 1] AS split FROM pipe "
          f"WHERE len(string_split({_SQ_V}, '|')) >= 3")
def s4(spark, sf_dir):
    """S4 + SP4: three split files (doc_id % 3), each numbered on its own, '|' fields."""
    p = FX.pairs(spark, sf_dir)
    out = None
    for k, name in enumerate(LD.PIPE_SPLITS):
        part = p.filter(F.col("doc_id") % 3 == k).select(
            "doc_id", "pos", F.when(F.col("pos") % 10 == 9, F.lit(""))
            .otherwise(F.concat_ws("", "gloss", F.lit(" | "), "translation", F.lit(" |x"))).alias("value"))
        from glosspark.operators.ordinals import sorted_ordinal
        lines = sorted_ordinal(part, ["doc_id", "pos"]).select("ord", "value")
        got = LD.parse_pipe_split(lines, name)
        out = got if out is None else out.unionByName(got)
    return out


@register("s5_combined_file",
          O.with_views(*O.BASE, "comb AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS ord, "
                       "CASE WHEN doc_id % 5 = 0 THEN translation ELSE translation || chr(9) || gloss END AS value "
                       "FROM pairs)")
          + "SELECT printf('aslg_%06d', ord) AS id, " + O.strip(f"string_split({_SQ_V}, chr(9))[1]")
          + " AS translation, " + O.strip(f"string_split({_SQ_V}, chr(9))[2]") + " AS gloss FROM comb "
          f"WHERE contains(value, chr(9)) AND len(string_split({_SQ_V}, chr(9))) >= 2")
def s5(spark, sf_dir):
    """S5: 'translation<TAB>gloss' lines (doc_id % 5 = 0 lines carry no TAB)."""
    from glosspark.operators.ordinals import sorted_ordinal
    p = FX.pairs(spark, sf_dir).select(
        "doc_id", "pos", F.when(F.col("doc_id") % 5 == 0, F.col("translation"))
        .otherwise(F.concat_ws("\t", "translation", "gloss")).alias("value"))
    return LD.parse_combined(sorted_ordinal(p, ["doc_id", "pos"]).select("ord", "value"))


# --- J*: joins -------------------------------------------------------------------

@register("j1_parallel_join",
          O.with_views(*O.BASE, O.raw_lines_cte("gloss", "rg"), O.raw_lines_cte("translation", "rt"))
          + "SELECT g.id, g.gloss, t.translation FROM (" + _s1_body("auto", False, "rg", "gloss")
          + ") g JOIN (" + _s1_body("auto", False, "rt", "translation") + ") t ON g.id = t.id")
def j1(spark, sf_dir):
    """S1 on a gloss file and a translation file, then J1 inner join on id."""
    g = SL.parse_pairs(FX.raw_lines(spark, sf_dir, "gloss"), "gloss")
    t = SL.parse_pairs(FX.raw_lines(spark, sf_dir, "translation"), "translation")
    return J.join_on_id(g, t).select("id", "gloss", "translation")


@register("j1_dialog_pairs", O.with_views(O.DIALOG) + "SELECT * FROM dialog")
def j1d(spark, sf_dir):
    """J1 over conversations: user turn joined to the next assistant turn."""
    return FX.dialog(spark, sf_dir)


@register("j2_positional_pairs",
          O.with_views(*O.BASE, O.raw_lines_cte("gloss", "rg"), O.raw_lines_cte("translation", "rt"),
                       f"g AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS pair_ord, string_split({_SQ_V}, chr(9))[2] "
                       f"AS gloss FROM rg WHERE len(string_split({_SQ_V}, chr(9))) = 2)",
                       f"t AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS pair_ord, string_split({_SQ_V}, chr(9))[2] "
                       f"AS translation FROM rt WHERE len(string_split({_SQ_V}, chr(9))) = 2)")
          + "SELECT g.pair_ord, g.gloss, t.translation FROM g JOIN t USING (pair_ord)")
def j2(spark, sf_dir):
    """S3b on two files, then J2: i-th surviving gloss line with i-th surviving text line."""
    g = SL.parse_tab_exact(FX.raw_lines(spark, sf_dir, "gloss"), "gloss")
    t = SL.parse_tab_exact(FX.raw_lines(spark, sf_dir, "translation"), "translation")
    return J.positional_pairs(g, t).select("pair_ord", "gloss", "translation")


@register("j4_semi_join_labels",
          O.WITH_PAIRS + "SELECT id, translation FROM pairs WHERE doc_id IN "
          "(SELECT doc_id FROM labels WHERE quality = 1)")
def j4(spark, sf_dir):
    """Keep pairs whose document is labelled good quality (left semi join)."""
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return J.semi_lookup(FX.pairs(spark, sf_dir), good, "doc_id").select("id", "translation")


# --- S7/S8/S9: tables ---------------------------------------------------------------

@register("s7_s8_named_split_discovery",
          O.with_views(*O.BASE, PREP_T2G, BAND, SP1_CTE)
          + f"SELECT gloss, text FROM k1 WHERE {SP1_SPLIT} = 'train'")
def s7(spark, sf_dir):
    """S7 + S8 + S9: pick split 'train', discover the gloss/text columns, project them."""
    df = SP.train_validation(C.prepared_t2g(spark, sf_dir)).drop("original_gloss", "original_text")
    return ST.gloss_text_columns(ST.named_split(df, "train"))


# --- V*: vocabulary and sequences ------------------------------------------------------

_K3 = keyed("pairs", PAIR_COLS, "k3")
_TRAIN = "tr AS (SELECT * FROM k3 WHERE rn <= floor(0.8 * n))"
_VOCAB = (f"vt AS (SELECT _h, _t, unnest({O.words('lower(translation)')}) AS token, "
          f"unnest(range(len({O.words('lower(translation)')}))) AS pos FROM tr), "
          "va AS (SELECT token, count(*) AS freq, min((_h, _t, pos)) AS first FROM vt GROUP BY token), "
          "vocab AS (SELECT token, (row_number() OVER (ORDER BY first) + 3)::INTEGER AS idx FROM va "
          "WHERE freq > 1 AND token NOT IN ('<pad>', '<sos>', '<eos>', '<unk>') "
          "UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<sos>', 1), ('<eos>', 2), ('<unk>', 3)) s(token, idx))")


def _vocab_spark(spark, sf_dir):
    sp = SP.three_way_floors(FX.pairs(spark, sf_dir), keep_keys=True)
    train = sp.filter(F.col("split") == "train")
    return sp, V.build_vocab(train, "translation", ["_h", "_t"])


@register("v1_build_vocab", O.with_views(*O.BASE, _K3, _TRAIN, _VOCAB) + "SELECT token, idx FROM vocab")
def v1(spark, sf_dir):
    """V1: vocabulary of the training split (freq > 1, first-seen order, 4 specials)."""
    return _vocab_spark(spark, sf_dir)[1]


_ENC = (f"et AS (SELECT id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM "
        f"(SELECT id, (['<sos>'] || {O.words('lower(translation)')} || ['<eos>'])[1:100] AS toks FROM k3)), "
        "enc AS (SELECT et.id, list(coalesce(v.idx, 3) ORDER BY et.pos) AS ids FROM et LEFT JOIN vocab v "
        "USING (token) GROUP BY et.id)")


def _ids_str(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: CAST(x AS VARCHAR)), ' ')"


@register("v2_encode", O.with_views(*O.BASE, _K3, _TRAIN, _VOCAB, _ENC) + f"SELECT id, {_ids_str('ids')} AS ids FROM enc")
def v2(spark, sf_dir):
    """V2: every line encoded with the training vocabulary (sos/eos, cut at 100, unk = 3)."""
    sp, vocab = _vocab_spark(spark, sf_dir)
    enc = V.encode(sp, "translation", vocab)
    return enc.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def _seq_sql() -> str:
    pad = "(ids || list_transform(range(greatest(128 - len(ids), 0)), lambda x: 0))[1:128]"
    return (f"SELECT id, {_ids_str(pad)} AS padded, "
            f"{_ids_str(f'list_transform(range(1, 129), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END)')} AS mask, "
            f"{_ids_str(f'list_transform({pad}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels, "
            f"{_ids_str(f'list_transform(list_transform({pad}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)')} AS sanitized, "
            f"{_ids_str('ids[1:len(ids) - 1]')} AS dec_in, {_ids_str('ids[2:]')} AS dec_out FROM enc")


@register("v3_v7_sequences", O.with_views(*O.BASE, _K3, _TRAIN, _VOCAB, _ENC) + _seq_sql())
def v3(spark, sf_dir):
    """V3 fixed-length pad/truncate to 128, V4 mask + labels, V6 sanitise, V7 shifted pair."""
    sp, vocab = _vocab_spark(spark, sf_dir)
    enc = V.encode(sp, "translation", vocab)
    padded = V.pad_to(F.col("ids"), 128)
    labels = V.labels_from(padded)
    dec_in, dec_out = V.shift_pair(F.col("ids"))
    s = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return enc.select("id", s(padded).alias("padded"), s(V.attention_mask(padded, F.size("ids"))).alias("mask"),
                      s(labels).alias("labels"), s(V.sanitize(labels, 1 << 30)).alias("sanitized"),
                      s(dec_in).alias("dec_in"), s(dec_out).alias("dec_out"))


@register("v5_decode_roundtrip",
          O.with_views(*O.BASE, _K3, _TRAIN, _VOCAB, _ENC,
                       "hd AS (SELECT id, CASE WHEN list_position(ids, 2) > 0 THEN ids[1:list_position(ids, 2) - 1] "
                       "ELSE ids END AS h FROM enc)",
                       "dt AS (SELECT id, unnest(k) AS idx, unnest(range(len(k))) AS pos FROM "
                       "(SELECT id, list_filter(h, lambda x: x NOT IN (1, 0)) AS k FROM hd))",
                       "dec AS (SELECT dt.id, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY dt.pos) AS text "
                       "FROM dt LEFT JOIN vocab v USING (idx) GROUP BY dt.id)")
          + "SELECT enc.id, coalesce(dec.text, '') AS text FROM enc LEFT JOIN dec USING (id)")
def v5(spark, sf_dir):
    """V5: decode(encode(line)): lower-cased, single-spaced, out-of-vocabulary words -> <unk>."""
    sp, vocab = _vocab_spark(spark, sf_dir)
    enc = V.encode(sp, "translation", vocab)
    return V.decode(enc, "ids", vocab)


# --- M12-M14 -------------------------------------------------------------------------

@register("m14_corpus_profile",
          O.with_views(*O.BASE, PREP_T2G, BAND, SP1_CTE)
          + "SELECT (SELECT count(*) FROM pairs) AS loaded, "
            "(SELECT count(*) FROM pairs WHERE gloss IS NOT NULL AND translation IS NOT NULL) AS after_nulls, "
            "(SELECT count(*) FROM band) AS after_band, "
            "(SELECT least(count(*), 2000) FROM band) AS sampled, "
            f"(SELECT count(*) FILTER (WHERE {SP1_SPLIT} = 'train') FROM k1) AS train, "
            f"(SELECT count(*) FILTER (WHERE {SP1_SPLIT} = 'validation') FROM k1) AS validation")
def m14(spark, sf_dir):
    """Corpus counts through the stages (one conditional aggregate per stage)."""
    p = FX.pairs(spark, sf_dir)
    stage = p.agg(F.count(F.lit(1)).alias("loaded"),
                  F.count(F.when(F.col("gloss").isNotNull() & F.col("translation").isNotNull(), 1)).alias("after_nulls"))
    band = C.prepared_t2g(spark, sf_dir)
    split = SP.train_validation(band)
    sizes = split.agg(F.count(F.lit(1)).alias("after_band"),
                      F.least(F.count(F.lit(1)), F.lit(2000)).cast("bigint").alias("sampled"),
                      F.count(F.when(F.col("split") == "train", 1)).alias("train"),
                      F.count(F.when(F.col("split") == "validation", 1)).alias("validation"))
    one = F.lit(1).alias("_k")
    return stage.select("*", one).join(sizes.select("*", one), "_k").drop("_k")


# --- U2, M12, M13 ----------------------------------------------------------------------

from glosspark.operators import inference as INF  # noqa: E402
from glosspark.operators.metrics import corpus as MC  # noqa: E402
from glosspark.operators.metrics import pairwise as MP  # noqa: E402
from glosspark.plans import oracle_metrics as OM  # noqa: E402


@register("u2_batch_inference_postprocessed",
          O.WITH_PREDS + f"SELECT id, {O.post_process_text_ws('ws')} AS prediction FROM "
          f"(SELECT id, {O.words('lower(ref_gloss)')} AS ws FROM preds)")
def u2(spark, sf_dir):
    """A predictor over the gloss column in Arrow batches of 32, then T13 post-processing."""
    p = FX.preds(spark, sf_dir).select("id", "ref_gloss")
    out = INF.batch_infer(p, "ref_gloss", INF.lowercase_gloss_model, "raw")
    return out.select("id", N.post_process_text(F.col("raw")).alias("prediction"))


@register("m12_pair_report",
          O.with_views(*O.BASE, O.PREDS) + "SELECT p.id, p.ref_gloss AS input, p.reference, p.prediction, m.* EXCLUDE (id) "
          "FROM preds p JOIN (" + OM.per_pair_metrics_sql() + ") m USING (id)")
def m12(spark, sf_dir):
    """Per pair input, reference, prediction and every metric."""
    p = FX.preds(spark, sf_dir).select("id", F.col("ref_gloss").alias("input"), "reference", "prediction")
    return MP.score_pairs(p)


_BASELINE = ("base AS (SELECT id, doc_id, reference, "
             + O.join(f"list_filter({O.words('reference')}, lambda t, i: (i - 1) % 2 = 0)")
             + " AS prediction FROM preds)")
_LANG = "lang AS (SELECT doc_id, lang AS dataset FROM documents)"


def _m13_sql() -> str:
    def model(src, name):
        return (f"SELECT '{name}' AS model, l.dataset, avg(m.bleu_4) AS b4 FROM ("
                + OM.per_pair_metrics_sql(src_ctes=O.BASE + (O.PREDS, _BASELINE), src=src, keep=",doc_id")
                + ") m JOIN lang l USING (doc_id) GROUP BY 1, 2")
    return (O.with_views(_LANG) + "SELECT a.dataset, round(a.b4, 6) AS model_bleu_4, round(b.b4, 6) AS baseline_bleu_4, "
            "round(CASE WHEN b.b4 > 0 THEN (a.b4 - b.b4) / b.b4 * 100 END, 6) AS gain_pct FROM ("
            + model("preds", "model") + ") a JOIN (" + model("base", "baseline") + ") b USING (dataset)")


@register("m13_relative_gain", _m13_sql())
def m13(spark, sf_dir):
    """BLEU-4 of a model vs a baseline per dataset; relative gain in percent (self-join)."""
    p = FX.preds(spark, sf_dir, extra=("lang",)).select("id", F.col("lang").alias("dataset"), "reference", "prediction")
    words = F.split(F.regexp_replace(F.col("reference"), r"(?U)^\s+|\s+\z", ""), r"(?U)\s+")
    base = p.withColumn("prediction", F.when(F.trim("reference") == "", F.lit(""))
                        .otherwise(F.array_join(F.filter(words, lambda t, i: i % 2 == 0), " ")))

    def mean_b4(df, name):
        s = MP.score_pairs(df)   # per-pair values rounded as in the pair report
        return s.groupBy("dataset").agg(F.avg("bleu_4").alias(name))

    a, b = mean_b4(p, "a"), mean_b4(base, "b")
    j = a.join(b, "dataset")
    return j.select("dataset", F.round("a", 6).alias("model_bleu_4"), F.round("b", 6).alias("baseline_bleu_4"),
                    F.round(F.when(F.col("b") > 0, (F.col("a") - F.col("b")) / F.col("b") * 100), 6).alias("gain_pct"))
