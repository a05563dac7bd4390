"""Per-pair metrics as column expressions.

Every metric of one prediction/reference pair is computed inside the row, so scoring
is a narrow projection: no shuffle, and it partitions with the pairs. The counts behind
`score_pairs` (matches, subsequence, edit distance, alignment) are taken in Arrow
batches (`counts`); the formulas over them are column expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.functions import lexicon as L
from glosspark.functions.text import col, is_upper_token, words
from glosspark.operators.metrics import counts
from glosspark.operators.metrics.tokens import (clipped_matches, ngrams, reverse_occurrence_tags, safe_div,
                                                word_levenshtein)

ORDERS = (1, 2, 3, 4)


# --- BLEU ---------------------------------------------------------------------

def bleu_stats(hyp: Column, ref: Column) -> Column:
    """Struct of clipped matches m1..m4, sentence denominators d1..d4 (max(1, #grams)),
    raw gram totals g1..g4, and hypothesis/reference lengths."""
    fields = []
    for n in ORDERS:
        fields.append(clipped_matches(ngrams(hyp, n), ngrams(ref, n)).alias(f"m{n}"))
        grams = F.greatest(F.size(hyp) - n + 1, F.lit(0))
        fields.append(F.greatest(grams, F.lit(1)).alias(f"d{n}"))
        fields.append(grams.alias(f"g{n}"))
    fields += [F.size(hyp).alias("hl"), F.size(ref).alias("rl")]
    return F.struct(*fields)


def brevity_penalty(hl: Column, rl: Column) -> Column:
    return (F.when(hl > rl, F.lit(1.0)).when(hl == 0, F.lit(0.0))
            .otherwise(F.exp(1 - rl.cast("double") / hl)))


def smoothed_bleu(st: Column, k: int, scale: float = 1.0) -> Column:
    """Cumulative BLEU-k, uniform weights, smoothing method 1 (epsilon 0.1 for zero counts)."""
    logs = None
    for n in range(1, k + 1):
        m, d = st[f"m{n}"], st[f"d{n}"]
        p = F.when(m == 0, F.lit(L.BLEU_EPSILON) / d).otherwise(m.cast("double") / d)
        term = F.log(p)
        logs = term if logs is None else logs + term
    score = brevity_penalty(st["hl"], st["rl"]) * F.exp(logs / k)
    return F.when(st["m1"] == 0, F.lit(0.0)).otherwise(score * scale)


def sentence_bleu(hyp_tokens: Column, ref_tokens: Column) -> dict[str, Column]:
    """M1/M2: bleu_1..bleu_4 of one pair."""
    st = bleu_stats(hyp_tokens, ref_tokens)
    return {f"bleu_{k}": smoothed_bleu(st, k) for k in ORDERS}


# --- ROUGE --------------------------------------------------------------------

def rouge_tokens(c) -> Column:
    """Lower-case, every run of non [a-z0-9] is a separator (non-ASCII letters split words)."""
    t = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


def _f1(m: Column, hn: Column, rn: Column) -> Column:
    p = m.cast("double") / F.greatest(hn, F.lit(1))
    r = m.cast("double") / F.greatest(rn, F.lit(1))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(hyp_tokens: Column, ref_tokens: Column, n: int) -> Column:
    hg, rg = ngrams(hyp_tokens, n), ngrams(ref_tokens, n)
    return _f1(clipped_matches(hg, rg), F.size(hg), F.size(rg))


def _lcs_len(h: list, r: list) -> int:
    """Bit-parallel LCS length (Hyyro 2004): one bit per hypothesis position."""
    if not h or not r:
        return 0
    masks: dict = {}
    for j, tok in enumerate(h):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(h)) - 1
    v = full
    for tok in r:
        m = masks.get(tok)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(h) - bin(v).count("1")


@F.pandas_udf(T.IntegerType())
def lcs_length(h: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([_lcs_len(list(a), list(b)) for a, b in zip(h, r)], dtype="int32")


def rouge_l(hyp_tokens: Column, ref_tokens: Column) -> Column:
    lcs = lcs_length(hyp_tokens, ref_tokens)
    p = safe_div(lcs, F.size(hyp_tokens))
    r = safe_div(lcs, F.size(ref_tokens))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.when((F.size(hyp_tokens) == 0) | (F.size(ref_tokens) == 0), F.lit(0.0)).otherwise(f)


# --- WER ----------------------------------------------------------------------

def wer(hyp_tokens: Column, ref_tokens: Column) -> Column:
    """Word edit distance / reference length; an empty reference scores 1.0 (the fallback)."""
    d = word_levenshtein(hyp_tokens, ref_tokens)
    return F.when(F.size(ref_tokens) == 0, F.lit(1.0)).otherwise(d.cast("double") / F.size(ref_tokens))


# --- METEOR (exact stage) -----------------------------------------------------

def meteor(hyp_tokens: Column, ref_tokens: Column,
           alpha: float = L.METEOR_ALPHA, beta: float = L.METEOR_BETA,
           gamma: float = L.METEOR_GAMMA) -> Column:
    """Exact-match METEOR on lower-cased tokens. The k-th-from-last occurrence of a word in
    the hypothesis aligns with the k-th-from-last occurrence in the reference."""
    h = F.transform(hyp_tokens, lambda t: F.lower(t))
    r = F.transform(ref_tokens, lambda t: F.lower(t))
    ht, rt = reverse_occurrence_tags(h), reverse_occurrence_tags(r)
    pairs = F.filter(
        F.transform(ht, lambda t, i: F.struct(i.alias("i"), (F.array_position(rt, t) - 1).alias("j"))),
        lambda s: s["j"] >= 0)
    m = F.size(pairs)
    breaks = F.size(F.filter(
        F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))),
        lambda k: (k < m) & ~((F.get(pairs, k)["i"] == F.get(pairs, k - 1)["i"] + 1)
                               & (F.get(pairs, k)["j"] == F.get(pairs, k - 1)["j"] + 1))))
    chunks = breaks + 1
    p = m.cast("double") / F.size(h)
    rc = m.cast("double") / F.size(r)
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    penalty = gamma * F.pow(chunks.cast("double") / m, beta)
    return F.when((m == 0) | (F.size(h) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise((1 - penalty) * fmean)


# --- gloss accuracy -------------------------------------------------------------

def gloss_accuracy(ref_gloss, pred_gloss) -> Column:
    """M8: signs are tokens with str.isupper(); half position accuracy, half set coverage."""
    rs = F.filter(words(ref_gloss), is_upper_token)
    ps = F.filter(words(pred_gloss), is_upper_token)
    nr, np_ = F.size(rs), F.size(ps)
    correct = F.size(F.filter(F.sequence(F.lit(1), F.greatest(nr, F.lit(1))),
                              lambda i: (i <= nr) & (i <= np_) & (F.get(ps, i - 1) == F.get(rs, i - 1))))
    pos = correct.cast("double") / F.greatest(nr, np_)
    cov = F.size(F.array_intersect(rs, ps)).cast("double") / F.size(F.array_distinct(rs))
    return (F.when(nr == 0, F.when(np_ == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise((pos + cov) / 2))


# --- all per-pair metrics ---------------------------------------------------------

METRIC_COLUMNS = ["bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge1_f", "rouge2_f", "rougeL_f", "wer", "meteor"]


def _stage(df, **cols):
    """One projection that adds named columns; later stages refer to them by name,
    which keeps expression trees small (no re-inlining of shared sub-expressions)."""
    return df.select("*", *[c.alias(k) for k, c in cols.items()])


def score_pairs(df, prediction: str = "prediction", reference: str = "reference",
                lower: bool = False, rounding: int | None = 6):
    """M1 + M5 + M6 + M7 for every row: the reference's `calculate_metrics`, per pair.

    `lower=True` gives the lower-cased variants (M2 BLEU, C6/C12 WER). Narrow
    projections only: the pairs are scored where they sit, no shuffle. The whole
    numbers of a pair come from Arrow batches (`counts`), one column per metric family, so
    a query that reads one family pays for that alone; the formulas are columns."""
    keep = df.columns
    low_p, low_r = F.lower(F.col(prediction)), F.lower(F.col(reference))
    pred, ref = (low_p, low_r) if lower else (F.col(prediction), F.col(reference))
    c = F.col
    d = _stage(df, _p=pred, _r=ref, _lp=low_p, _lr=low_r)
    d = _stage(d, _b=counts.bleu_counts("_p", "_r"), _x=counts.rouge_counts("_lp", "_lr"),
               _e=counts.edit_counts("_p", "_r"), _a=counts.alignment_counts("_lp", "_lr"))
    st = bleu_struct(c("_b"))
    out = {f"bleu_{k}": smoothed_bleu(st, k) for k in ORDERS}
    out.update(rouge_scores(c("_x")))
    out["wer"] = F.when(c("_e.rl") == 0, F.lit(1.0)).otherwise(c("_e.d").cast("double") / c("_e.rl"))
    out["meteor"] = _meteor_of(c("_a.m"), c("_a.chunks"), c("_a.hl"), c("_a.rl"))
    cols = [(F.round(v, rounding) if rounding is not None else v).alias(k) for k, v in out.items()]
    return d.select(*keep, *cols)


def bleu_struct(b: Column) -> Column:
    """`bleu_stats` of counted pairs: matches m1..m4, denominators d1..d4, gram totals g1..g4 and lengths."""
    grams = {n: F.greatest(b["hl"] - n + 1, F.lit(0)) for n in ORDERS}
    return F.struct(*[b[f"m{n}"].alias(f"m{n}") for n in ORDERS],
                    *[F.greatest(grams[n], F.lit(1)).alias(f"d{n}") for n in ORDERS],
                    *[grams[n].alias(f"g{n}") for n in ORDERS], b["hl"].alias("hl"), b["rl"].alias("rl"))


def rouge_scores(x: Column) -> dict[str, Column]:
    """rouge1_f, rouge2_f and rougeL_f of counted pairs."""
    out = {f"rouge{n}_f": _f1(x[f"m{n}"], *[F.greatest(x[s] - n + 1, F.lit(0)) for s in ("hn", "rn")]) for n in (1, 2)}
    p, r = safe_div(x["lcs"], x["hn"]), safe_div(x["lcs"], x["rn"])
    out["rougeL_f"] = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return out


def _meteor_from(pairs: Column, hn: Column, rn: Column, alpha: float = L.METEOR_ALPHA,
                 beta: float = L.METEOR_BETA, gamma: float = L.METEOR_GAMMA) -> Column:
    m = F.size(pairs)
    breaks = F.size(F.filter(
        F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))),
        lambda k: (k < m) & ~((F.get(pairs, k)["i"] == F.get(pairs, k - 1)["i"] + 1)
                               & (F.get(pairs, k)["j"] == F.get(pairs, k - 1)["j"] + 1))))
    return _meteor_of(m, breaks + 1, hn, rn, alpha, beta, gamma)


def _meteor_of(m: Column, chunks: Column, hn: Column, rn: Column, alpha: float = L.METEOR_ALPHA,
               beta: float = L.METEOR_BETA, gamma: float = L.METEOR_GAMMA) -> Column:
    """METEOR of `m` aligned words in `chunks` runs."""
    p = m.cast("double") / hn
    rc = m.cast("double") / rn
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    penalty = gamma * F.pow(chunks.cast("double") / m, beta)
    return F.when((m == 0) | (hn == 0) | (rn == 0), F.lit(0.0)).otherwise((1 - penalty) * fmean)


def score_gloss_accuracy(df, reference: str = "ref_gloss", prediction: str = "pred_gloss",
                         rounding: int | None = 6):
    """M8 per row, staged (sign lists first)."""
    keep = df.columns
    d = _stage(df, _rs=F.filter(words(F.col(reference)), is_upper_token),
               _ps=F.filter(words(F.col(prediction)), is_upper_token))
    rs, ps = F.col("_rs"), F.col("_ps")
    nr, np_ = F.size(rs), F.size(ps)
    correct = F.size(F.filter(F.sequence(F.lit(1), F.greatest(nr, F.lit(1))),
                              lambda i: (i <= nr) & (i <= np_) & (F.get(ps, i - 1) == F.get(rs, i - 1))))
    pos = correct.cast("double") / F.greatest(nr, np_)
    cov = F.size(F.array_intersect(rs, ps)).cast("double") / F.size(F.array_distinct(rs))
    acc = (F.when(nr == 0, F.when(np_ == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise((pos + cov) / 2))
    return d.select(*keep, (F.round(acc, rounding) if rounding is not None else acc).alias("gloss_accuracy"))
