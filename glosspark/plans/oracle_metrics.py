"""DuckDB SQL twins of the metric operators (n-gram tables, rank joins, diagonal DPs)."""

from __future__ import annotations

from glosspark.functions import lexicon as L
from glosspark.plans import oracle as O

R6 = 6


def rouge_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def tok_cte(pred: str = "prediction", ref: str = "reference", lower: bool = False, src: str = "preds",
            extra: str = "") -> str:
    p, r = (f"lower({pred})", f"lower({ref})") if lower else (pred, ref)
    return (f"ptok AS (SELECT id{extra}, {O.words(p)} AS h, {O.words(r)} AS r, "
            f"{rouge_tokens(p)} AS rh, {rouge_tokens(r)} AS rr FROM {src})")


def _grams(lst: str) -> str:
    return f"list_transform(range(1, len({lst}) - n + 2), lambda i: array_to_string({lst}[i:i + n - 1], ' '))"


def match_cte(name: str, h: str, r: str, orders=(1, 2, 3, 4)) -> str:
    """(id, n, m): clipped n-gram matches per pair and order."""
    vals = ", ".join(f"({n})" for n in orders)
    return (f"{name}_g AS (SELECT id, n, 0 AS side, unnest({_grams(h)}) AS g FROM ptok, (VALUES {vals}) v(n) "
            f"UNION ALL SELECT id, n, 1 AS side, unnest({_grams(r)}) AS g FROM ptok, (VALUES {vals}) v(n)),\n"
            f"{name}_c AS (SELECT id, n, g, count(*) FILTER (WHERE side = 0) AS hc, "
            f"count(*) FILTER (WHERE side = 1) AS rc FROM {name}_g GROUP BY id, n, g),\n"
            f"{name} AS (SELECT id, n, sum(least(hc, rc))::BIGINT AS m FROM {name}_c GROUP BY id, n)")


def bleu_stats_cte() -> str:
    piv = ", ".join(f"coalesce(max(b.m) FILTER (WHERE b.n = {n}), 0) AS m{n}" for n in (1, 2, 3, 4))
    return (f"bst AS (SELECT t.id, {piv}, len(t.h) AS hl, len(t.r) AS rl FROM ptok t "
            f"LEFT JOIN bm b ON b.id = t.id GROUP BY t.id, t.h, t.r)")


def _p(n: int) -> str:
    d = f"greatest(hl - {n} + 1, 1)"
    return f"(CASE WHEN m{n} = 0 THEN {L.BLEU_EPSILON!r} / {d} ELSE m{n}::DOUBLE / {d} END)"


BP = "(CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 ELSE exp(1 - rl::DOUBLE / hl) END)"


def bleu_k(k: int) -> str:
    logs = " + ".join(f"ln({_p(n)})" for n in range(1, k + 1))
    return f"(CASE WHEN m1 = 0 THEN 0.0 ELSE {BP} * exp(({logs}) / {k}) END)"


def f1(m: str, hn: str, rn: str) -> str:
    p = f"({m}::DOUBLE / greatest({hn}, 1))"
    r = f"({m}::DOUBLE / greatest({rn}, 1))"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def rouge_n_cte() -> str:
    piv = ", ".join(f"coalesce(max(b.m) FILTER (WHERE b.n = {n}), 0) AS rm{n}" for n in (1, 2))
    return (f"rst AS (SELECT t.id, {piv}, len(t.rh) AS rhl, len(t.rr) AS rrl FROM ptok t "
            f"LEFT JOIN rm b ON b.id = t.id GROUP BY t.id, t.rh, t.rr)")


def diag_dp(h: str, r: str, kind: str) -> str:
    """Edit distance ('lev') or LCS length ('lcs') by anti-diagonals over a flat state:
    S = diagonal(d-2) ++ diagonal(d-1), each indexed by reference position 0..len(r)."""
    m = f"len({r})"
    big = 1_000_000_000
    if kind == "lev":
        cell = (f"CASE WHEN d - i < 0 OR d - i > len({h}) THEN {big} WHEN i = 0 THEN d WHEN d - i = 0 THEN i "
                f"ELSE least(S[{m} + 1 + i] + 1, S[{m} + 2 + i] + 1, "
                f"S[i] + CASE WHEN {r}[i] = {h}[d - i] THEN 0 ELSE 1 END) END")
        init = big
    else:
        cell = (f"CASE WHEN d - i < 0 OR d - i > len({h}) OR i = 0 OR d - i = 0 THEN 0 "
                f"WHEN {r}[i] = {h}[d - i] THEN S[i] + 1 ELSE greatest(S[{m} + 1 + i], S[{m} + 2 + i]) END")
        init = 0
    return (f"list_reduce(range(0, len({h}) + {m} + 1), lambda S, d: list_concat(S[{m} + 2:], "
            f"list_transform(range(0, {m} + 1), lambda i: {cell})), "
            f"list_transform(range(0, 2 * {m} + 2), lambda x: {init}))[2 * {m} + 2]")


def wer_expr(h: str = "h", r: str = "r") -> str:
    return f"(CASE WHEN len({r}) = 0 THEN 1.0 ELSE {diag_dp(h, r, 'lev')}::DOUBLE / len({r}) END)"


def rouge_l_from(lcs: str, h: str = "rh", r: str = "rr") -> str:
    p = f"({lcs}::DOUBLE / len({h}))"
    rc = f"({lcs}::DOUBLE / len({r}))"
    return (f"(CASE WHEN len({h}) = 0 OR len({r}) = 0 THEN 0.0 "
            f"WHEN {p} + {rc} > 0 THEN 2 * {p} * {rc} / ({p} + {rc}) ELSE 0.0 END)")


def dp_cte() -> str:
    return f"dp AS (SELECT id, {diag_dp('rh', 'rr', 'lcs')} AS lcs, {diag_dp('h', 'r', 'lev')} AS lev FROM ptok)"


def meteor_ctes(alpha=L.METEOR_ALPHA, beta=L.METEOR_BETA, gamma=L.METEOR_GAMMA) -> str:
    return (
        "mh AS (SELECT id, unnest(hl) AS t, unnest(range(len(hl))) AS pos FROM "
        "(SELECT id, list_transform(h, lambda x: lower(x)) AS hl FROM ptok)),\n"
        "mr AS (SELECT id, unnest(rl) AS t, unnest(range(len(rl))) AS pos FROM "
        "(SELECT id, list_transform(r, lambda x: lower(x)) AS rl FROM ptok)),\n"
        "mhk AS (SELECT id, t, pos, row_number() OVER (PARTITION BY id, t ORDER BY pos DESC) AS k FROM mh),\n"
        "mrk AS (SELECT id, t, pos, row_number() OVER (PARTITION BY id, t ORDER BY pos DESC) AS k FROM mr),\n"
        "mm AS (SELECT a.id, a.pos AS i, b.pos AS j FROM mhk a JOIN mrk b ON a.id = b.id AND a.t = b.t AND a.k = b.k),\n"
        "mch AS (SELECT id, count(*) AS m, 1 + sum(CASE WHEN li IS NULL THEN 0 "
        "WHEN i = li + 1 AND j = lj + 1 THEN 0 ELSE 1 END) AS chunks FROM "
        "(SELECT id, i, j, lag(i) OVER w AS li, lag(j) OVER w AS lj FROM mm WINDOW w AS (PARTITION BY id ORDER BY i)) "
        "GROUP BY id),\n"
        f"met AS (SELECT t.id, CASE WHEN c.m IS NULL OR len(t.h) = 0 OR len(t.r) = 0 THEN 0.0 ELSE "
        f"(1 - {gamma!r} * pow(c.chunks::DOUBLE / c.m, {beta!r})) * "
        f"((c.m::DOUBLE / len(t.h)) * (c.m::DOUBLE / len(t.r)) / "
        f"({alpha!r} * (c.m::DOUBLE / len(t.h)) + {1 - alpha!r} * (c.m::DOUBLE / len(t.r)))) END AS meteor "
        f"FROM ptok t LEFT JOIN mch c ON c.id = t.id)")


def per_pair_metrics_sql(pred="prediction", ref="reference", lower=False, src_ctes=O.BASE + (O.PREDS,),
                         src="preds", keep: str = "") -> str:
    """SELECT id, bleu_1..4, rouge1_f, rouge2_f, rougeL_f, wer, meteor (rounded) per pair."""
    ctes = list(src_ctes) + [
        tok_cte(pred, ref, lower, src, extra=keep),
        match_cte("bm", "h", "r"), bleu_stats_cte(),
        match_cte("rm", "rh", "rr", (1, 2)), rouge_n_cte(),
        meteor_ctes(), dp_cte(),
    ]
    bl = ", ".join(f"round({bleu_k(k)}, {R6}) AS bleu_{k}" for k in (1, 2, 3, 4))
    keep_cols = keep.replace(",", ", t.") if keep else ""
    body = (f"SELECT t.id{keep_cols}, {bl}, "
            f"round({f1('rm1', 'greatest(rhl, 0)', 'greatest(rrl, 0)')}, {R6}) AS rouge1_f, "
            f"round({f1('rm2', 'greatest(rhl - 1, 0)', 'greatest(rrl - 1, 0)')}, {R6}) AS rouge2_f, "
            f"round({rouge_l_from('dp.lcs', 't.rh', 't.rr')}, {R6}) AS rougeL_f, "
            f"round(CASE WHEN len(t.r) = 0 THEN 1.0 ELSE dp.lev::DOUBLE / len(t.r) END, {R6}) AS wer, "
            f"round(met.meteor, {R6}) AS meteor "
            "FROM ptok t JOIN bst USING (id) JOIN rst USING (id) JOIN met USING (id) JOIN dp USING (id)")
    return O.with_views(*ctes) + body


def gloss_accuracy_sql(ref: str = "ref_gloss", pred: str = "pred_gloss") -> str:
    sign = "lambda t: regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '[\\p{Ll}\\p{Lt}]')"
    inner = (f"SELECT id, list_filter({O.words(ref)}, {sign}) AS rs, "
             f"list_filter({O.words(pred)}, {sign}) AS ps FROM preds")
    correct = "len(list_filter(range(1, len(rs) + 1), lambda i: i <= len(ps) AND ps[i] = rs[i]))"
    expr = (f"CASE WHEN len(rs) = 0 THEN (CASE WHEN len(ps) = 0 THEN 1.0 ELSE 0.0 END) ELSE "
            f"({correct}::DOUBLE / greatest(len(rs), len(ps)) + "
            f"len(list_intersect(rs, ps))::DOUBLE / len(list_distinct(rs))) / 2 END")
    return O.WITH_PREDS + f"SELECT id, round({expr}, {R6}) AS gloss_accuracy FROM ({inner})"


# --- corpus BLEU ----------------------------------------------------------------

def corpus_bleu_sql() -> str:
    """M3: pooled counts (sentence denominators summed), method 1, x100, lower-cased."""
    ctes = list(O.BASE) + [O.PREDS, tok_cte(lower=True), match_cte("bm", "h", "r"), bleu_stats_cte()]
    sums = ", ".join(f"sum(m{n})::BIGINT AS m{n}, sum(greatest(hl - {n} + 1, 1))::BIGINT AS d{n}" for n in (1, 2, 3, 4))
    agg = f"SELECT {sums}, sum(hl)::BIGINT AS hl, sum(rl)::BIGINT AS rl FROM bst"

    def p(n):
        return f"(CASE WHEN m{n} = 0 THEN {L.BLEU_EPSILON!r} / d{n} ELSE m{n}::DOUBLE / d{n} END)"

    cols = []
    for k in (1, 2, 3, 4):
        logs = " + ".join(f"ln({p(n)})" for n in range(1, k + 1))
        cols.append(f"round(CASE WHEN m1 = 0 THEN 0.0 ELSE {BP} * exp(({logs}) / {k}) * 100 END, {R6}) AS bleu_{k}")
    return O.with_views(*ctes) + f"SELECT {', '.join(cols)} FROM ({agg})"


def tokenize_13a(x: str) -> str:
    t = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = O.rep(t, a, b)
    t = f"(' ' || {t} || ' ')"
    t = O.rs(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " \\1 ")
    t = O.rs(t, r"([^0-9])([\.,])", "\\1 \\2 ")
    t = O.rs(t, r"([\.,])([^0-9])", " \\1 \\2")
    t = O.rs(t, r"([0-9])(-)", "\\1 \\2 ")
    return O.words(t)


def corpus_bleu_13a_sql() -> str:
    """M4: library-style corpus BLEU: 13a tokens, no smoothing, raw precisions reported."""
    tok = (f"ptok AS (SELECT id, {tokenize_13a('prediction')} AS h, {tokenize_13a('reference')} AS r, "
           f"[]::VARCHAR[] AS rh, []::VARCHAR[] AS rr FROM preds)")
    ctes = list(O.BASE) + [O.PREDS, tok, match_cte("bm", "h", "r"), bleu_stats_cte()]
    sums = ", ".join(f"sum(m{n})::BIGINT AS m{n}, sum(greatest(hl - {n} + 1, 0))::BIGINT AS g{n}" for n in (1, 2, 3, 4))
    agg = f"SELECT {sums}, sum(hl)::BIGINT AS tl, sum(rl)::BIGINT AS rl FROM bst"
    prec = {n: f"(CASE WHEN g{n} > 0 THEN m{n}::DOUBLE / g{n} ELSE 0.0 END)" for n in (1, 2, 3, 4)}
    geo = (f"(CASE WHEN least({', '.join(prec.values())}) > 0 THEN exp("
           + " + ".join(f"0.25 * ln({prec[n]})" for n in (1, 2, 3, 4)) + ") ELSE 0.0 END)")
    ratio = "(tl::DOUBLE / rl)"
    bp = f"(CASE WHEN {ratio} > 1.0 THEN 1.0 ELSE exp(1 - 1.0 / {ratio}) END)"
    cols = [f"round({geo} * {bp}, {R6}) AS bleu"] + [f"round({prec[n]}, {R6}) AS precision_{n}" for n in (1, 2, 3, 4)]
    cols += [f"round({bp}, {R6}) AS brevity_penalty", f"round({ratio}, {R6}) AS length_ratio",
             "tl AS translation_length", "rl AS reference_length"]
    return O.with_views(*ctes) + f"SELECT {', '.join(cols)} FROM ({agg})"
