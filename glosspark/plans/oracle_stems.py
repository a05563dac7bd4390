"""DuckDB SQL of Porter stems, stemmed ROUGE and METEOR in stages, written apart from the engine's rules."""

from __future__ import annotations

from glosspark.functions import lexicon as L
from glosspark.plans import oracle as O
from glosspark.plans import oracle_metrics as OM

_VARIANT = ("CASE WHEN regexp_matches(t, '^[a-z]{4,}$') AND (i - 1) % 5 = 1 THEN t || 's' WHEN regexp_matches(t, '^[a-z]{4,}$') AND (i - 1) % 5 = 2 THEN 'syn' || t "
            "WHEN regexp_matches(t, '^[a-z]{4,}$') AND (i - 1) % 5 = 3 THEN t || 'ing' ELSE t END")
VARIANTS = ("variants AS (SELECT id, translation AS reference, "
            + O.join(f"list_filter(list_transform({O.words('translation')}, lambda t, i: {_VARIANT}), lambda t, i: (i - 1) % 7 <> 6)") + " AS prediction FROM pairs)")


def _shape(w: str) -> str:
    return (f"list_reduce(list_prepend('', string_split({w}, '')), lambda a, ch: a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'v' "
            "WHEN ch = 'y' AND right(a, 1) = 'c' THEN 'v' ELSE 'c' END)")


def _m(f: str) -> str:
    return f"((length({f}) - length(replace({f}, 'vc', ''))) // 2)"


def _cut(x: str, k: int) -> str:
    return f"left({x}, length(w) - {k})"


def _short(x: str, g: str) -> str:
    return f"(({g} LIKE '%cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y')) OR {g} = 'vc')"


def _mend(k: int) -> str:
    x, g = _cut("w", k), _cut("f", k)
    return (f"CASE WHEN {x} LIKE '%at' OR {x} LIKE '%bl' OR {x} LIKE '%iz' THEN {x} || 'e' "
            f"WHEN length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND right({g}, 1) = 'c' THEN CASE WHEN right({x}, 1) IN ('l', 's', 'z') THEN {x} ELSE {_cut('w', k + 1)} END "
            f"WHEN {_m(g)} = 1 AND {_short(x, g)} THEN {x} || 'e' ELSE {x} END")


def _rules(text: str, least: int) -> str:
    """`suffix>replacement` pairs, the first that fits decides."""
    out = []
    for rule in text.split():
        a, b = rule.split(">")
        out.append(f"WHEN w LIKE '%{a}' THEN CASE WHEN {_m(_cut('f', len(a)))} > {least} THEN {_cut('w', len(a))} || '{b}' ELSE w END")
    return " ".join(out)


def stem_ctes(words_sql: str, name: str = "stems") -> list[str]:
    """CTEs ending in `name` (t, s): the stem of every token t of the query `words_sql` (t)."""
    steps = [
        "CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN left(w, 3) WHEN w LIKE '%sses' OR w LIKE '%ies' THEN " + _cut("w", 2)
        + " WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN " + _cut("w", 1) + " ELSE w END",
        f"CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN left(w, 3) ELSE {_cut('w', 2)} END WHEN w LIKE '%eed' THEN CASE WHEN {_m(_cut('f', 3))} > 0 THEN {_cut('w', 1)} ELSE w END "
        f"WHEN w LIKE '%ed' AND contains({_cut('f', 2)}, 'v') THEN {_mend(2)} WHEN w LIKE '%ing' AND contains({_cut('f', 3)}, 'v') THEN {_mend(3)} ELSE w END",
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND right({_cut('f', 1)}, 1) = 'c' THEN {_cut('w', 1)} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {_m(_cut('f', 4))} > 0 THEN {_cut('w', 2)} ELSE w END",
        "CASE " + _rules("ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive "
                         "fulness>ful ousness>ous aliti>al iviti>ive biliti>ble fulli>ful", 0) + f" WHEN w LIKE '%logi' AND {_m(_cut('f', 3))} > 0 THEN {_cut('w', 1)} ELSE w END",
        "CASE " + _rules("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", 0) + " ELSE w END",
        "CASE WHEN w LIKE '%ion' AND right(" + _cut("w", 3) + ", 1) NOT IN ('s', 't') THEN w "
        + _rules("al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ion> ou> ism> ate> iti> ous> ive> ize>", 1) + " ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({_m(_cut('f', 1))} > 1 OR ({_m(_cut('f', 1))} = 1 AND NOT {_short(_cut('w', 1), _cut('f', 1))})) THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {_m(_cut('f', 1))} > 1 THEN {_cut('w', 1)} ELSE w END",
    ]
    ctes = [f"{name}_0 AS (SELECT DISTINCT t, lower(t) AS w FROM ({words_sql}))"]
    for i, step in enumerate(steps, 1):
        ctes.append(f"{name}_{i} AS MATERIALIZED (SELECT t, {step} AS w FROM (SELECT t, w, {_shape('w')} AS f FROM {name}_{i - 1}))")
    odd = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (x.split(">") for x in (
        "sky>sky skies>sky dying>die lying>lie tying>tie news>news innings>inning inning>inning outings>outing outing>outing cannings>canning canning>canning "
        "howe>howe proceed>proceed exceed>exceed succeed>succeed").split()))
    ctes.append(f"{name} AS MATERIALIZED (SELECT t, CASE lower(t) {odd} ELSE CASE WHEN length(t) <= 2 THEN lower(t) ELSE w END END AS s FROM {name}_{len(steps)})")
    return ctes


def rouge_stemmed_sql() -> str:
    plain = ("plain AS MATERIALIZED (SELECT id, " + OM.rouge_tokens("prediction") + " AS rh, " + OM.rouge_tokens("reference") + " AS rr FROM variants)")
    tokens = "SELECT unnest(rh) AS t FROM plain UNION SELECT unnest(rr) FROM plain"
    ctes = [*O.BASE, VARIANTS, plain, *stem_ctes(f"SELECT t FROM ({tokens}) WHERE length(t) > 3")]
    for side in ("rh", "rr"):
        ctes.append(f"{side}_s AS (SELECT id, list(coalesce(s, x.t) ORDER BY i) AS {side} FROM (SELECT id, unnest({side}) AS t, unnest(range(len({side}))) AS i FROM plain) x "
                    "LEFT JOIN stems ON stems.t = x.t GROUP BY id)")
    ctes.append("ptok AS MATERIALIZED (SELECT plain.id, coalesce(rh_s.rh, []) AS rh, coalesce(rr_s.rr, []) AS rr FROM plain LEFT JOIN rh_s USING (id) LEFT JOIN rr_s USING (id))")
    ctes += [OM.match_cte("rm", "rh", "rr", (1, 2)), OM.rouge_n_cte(), f"dp AS (SELECT id, {OM.diag_dp('rh', 'rr', 'lcs')} AS lcs FROM ptok)"]
    return O.with_views(*ctes) + (
        f"SELECT t.id, round({OM.f1('rm1', 'greatest(rhl, 0)', 'greatest(rrl, 0)')}, 6) AS rouge1_f, "
        f"round({OM.f1('rm2', 'greatest(rhl - 1, 0)', 'greatest(rrl - 1, 0)')}, 6) AS rouge2_f, "
        f"round({OM.rouge_l_from('dp.lcs', 't.rh', 't.rr')}, 6) AS \"rougeL_f\" FROM ptok t JOIN rst USING (id) JOIN dp USING (id)")


def meteor_staged_sql() -> str:
    toks = f"mtok AS MATERIALIZED (SELECT id, list_transform({O.words('prediction')}, lambda x: lower(x)) AS h, list_transform({O.words('reference')}, lambda x: lower(x)) AS r FROM variants)"
    ctes = [*O.BASE, VARIANTS, toks, *stem_ctes("SELECT unnest(h) AS t FROM mtok UNION SELECT unnest(r) FROM mtok")]
    for s in ("h", "r"):
        ctes.append(f"{s}0 AS MATERIALIZED (SELECT id, pos, x.t, s FROM (SELECT id, unnest({s}) AS t, unnest(range(len({s}))) AS pos FROM mtok) x JOIN stems ON stems.t = x.t)")
    by = {1: ("t", "t"), 2: ("s", "s"), 3: ("regexp_replace(t, '^syn', '')", "t")}
    for k, (left, right) in by.items():
        only = "" if k < 3 else "WHERE regexp_matches(t, '^syn[a-z]{4,}$')"
        ctes.append(f"a{k} AS (SELECT id, pos, {left} AS v, row_number() OVER (PARTITION BY id, {left} ORDER BY pos DESC) AS k FROM h{k - 1} {only})")
        ctes.append(f"b{k} AS (SELECT id, pos, {right} AS v, row_number() OVER (PARTITION BY id, {right} ORDER BY pos DESC) AS k FROM r{k - 1})")
        ctes.append(f"p{k} AS MATERIALIZED (SELECT a.id, a.pos AS i, b.pos AS j FROM a{k} a JOIN b{k} b ON a.id = b.id AND a.v = b.v AND a.k = b.k)")
        ctes.append(f"h{k} AS MATERIALIZED (SELECT x.* FROM h{k - 1} x ANTI JOIN p{k} p ON x.id = p.id AND x.pos = p.i)")
        ctes.append(f"r{k} AS MATERIALIZED (SELECT x.* FROM r{k - 1} x ANTI JOIN p{k} p ON x.id = p.id AND x.pos = p.j)")
    score = []
    for k, name in ((1, "exact"), (2, "stem"), (3, "synonym")):
        every = " UNION ALL ".join(f"SELECT * FROM p{x}" for x in range(1, k + 1))
        ctes.append(f"c{k} AS (SELECT id, count(*) AS m, 1 + sum(CASE WHEN li IS NULL THEN 0 WHEN i = li + 1 AND j = lj + 1 THEN 0 ELSE 1 END) AS chunks FROM "
                    f"(SELECT id, i, j, lag(i) OVER w AS li, lag(j) OVER w AS lj FROM ({every}) WINDOW w AS (PARTITION BY id ORDER BY i)) GROUP BY id)")
        p, r = f"(c{k}.m::DOUBLE / len(t.h))", f"(c{k}.m::DOUBLE / len(t.r))"
        score.append(f"round(CASE WHEN c{k}.m IS NULL THEN 0.0 ELSE (1 - {L.METEOR_GAMMA!r} * pow(c{k}.chunks::DOUBLE / c{k}.m, {L.METEOR_BETA!r})) * "
                     f"({p} * {r} / ({L.METEOR_ALPHA!r} * {p} + {1 - L.METEOR_ALPHA!r} * {r})) END, 6) AS meteor_{name}")
    return O.with_views(*ctes) + f"SELECT t.id, {', '.join(score)} FROM mtok t LEFT JOIN c1 USING (id) LEFT JOIN c2 USING (id) LEFT JOIN c3 USING (id)"


def bootstrap_sql(scored: str, metrics: list[str], resamples: int, seed: str = "bootstrap") -> str:
    """Percentiles of resampled means of `scored`, with the weights of the same digests."""
    cuts = [24109, 48219, 60273, 64292, 65296, 65497, 65531]
    weight = " + ".join(f"(u >= {c})::INT" for c in cuts)
    means = ", ".join(f"sum({m} * w) / sum(w) AS {m}" for m in metrics)
    out = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.5), 6) AS mid, "
                             f"round(quantile_cont({m}, 0.975), 6) AS high, count(*) AS n_resamples FROM means" for m in metrics)
    return (f"WITH scored AS MATERIALIZED ({scored}), d AS (SELECT s.*, b, md5('{seed}:' || (b // 8) || ':' || id) AS x FROM scored s, (SELECT unnest(range({resamples})) AS b)), "
            f"u AS (SELECT *, ('0x' || substr(x, 4 * (b % 8) + 1, 4))::INT AS u FROM d), w AS (SELECT *, {weight} AS w FROM u), "
            f"means AS (SELECT b, {means} FROM w WHERE w > 0 GROUP BY b) {out}")


def count_scores_sql() -> str:
    src = "whole AS (SELECT doc_id AS id, coalesce(text, '') AS reference, " + O.join(f"list_filter({O.words('coalesce(text, chr(32))')}, lambda t, i: (i - 1) % 7 <> 3)") + " AS prediction FROM documents)"
    ctes = [src, OM.tok_cte(src="whole"), OM.match_cte("bm", "h", "r"), OM.bleu_stats_cte(), OM.match_cte("rm", "rh", "rr", (1, 2)), OM.rouge_n_cte()]
    bl = ", ".join(f"round({OM.bleu_k(k)}, 6) AS bleu_{k}" for k in (1, 2, 3, 4))
    return O.with_views(*ctes) + (f"SELECT t.id, {bl}, round({OM.f1('rm1', 'greatest(rhl, 0)', 'greatest(rrl, 0)')}, 6) AS rouge1_f, "
                                  f"round({OM.f1('rm2', 'greatest(rhl - 1, 0)', 'greatest(rrl - 1, 0)')}, 6) AS rouge2_f FROM ptok t JOIN bst USING (id) JOIN rst USING (id)")
