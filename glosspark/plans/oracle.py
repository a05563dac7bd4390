"""DuckDB SQL twins of the fixture views and column functions (correctness oracle).

RE2 (DuckDB's regex engine) differs from Java/Python: no look-around, and
ASCII-only \\b, \\w, \\s. Rules that need a Unicode word boundary are written
over a *wrapped* string in which every maximal word run is enclosed in
chr(1) ... chr(2); a Python `\\bword\\b` then becomes `\\x01word\\x02`, and the
textual look-behind "the " becomes "the\\x02 ".
"""

from __future__ import annotations

import re

from glosspark.functions import lexicon as L
from glosspark.plans.fixtures import HYP_DROPPED_WORDS, PRONOUN_MARKERS

WSC = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WSC}]"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str) -> str:
    """regexp_replace, global. `repl` is a SQL expression."""
    return f"regexp_replace({x}, {q(pattern)}, {repl}, 'g')"


def rs(x: str, pattern: str, repl: str) -> str:
    """regexp_replace with a plain replacement string."""
    return rr(x, pattern, q(repl))


def strip(x: str) -> str:
    return rs(x, f"^{WS}+|{WS}+$", "")


def collapse(x: str) -> str:
    return rs(x, f"{WS}+", " ")


def squash(x: str) -> str:
    return strip(collapse(x))


def words(x: str) -> str:
    return (f"(CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({strip(x)}, {q(WS + '+')}) END)")


def join(lst: str) -> str:
    return f"array_to_string({lst}, ' ')"


def upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def lower(x: str) -> str:
    return f"lower({x})"


def rep(x: str, a: str, b: str) -> str:
    return f"replace({x}, {q(a)}, {q(b)})"


def s(x: str) -> str:
    return f"coalesce({x}, '')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def clean_invisibles(x: str) -> str:
    return f"replace(replace({x}, chr(65279), ''), chr(160), ' ')"


def wrap(x: str) -> str:
    return f"regexp_replace({x}, {q('(' + W + '+)')}, chr(1) || '\\1' || chr(2), 'g')"


def unwrap(x: str) -> str:
    return f"replace(replace({x}, chr(1), ''), chr(2), '')"


def wrapped_regex(phrase: str) -> str:
    """Regex for a whole-word phrase over wrapped text."""
    out, pos = [], 0
    for m in re.finditer(r"\w+", phrase):
        out.append(re.escape(phrase[pos:m.start()]))
        out.append(r"\x01" + re.escape(m.group(0)) + r"\x02")
        pos = m.end()
    out.append(re.escape(phrase[pos:]))
    return "".join(out).replace(r"\ ", " ")


def wrapped_text(phrase: str) -> str:
    """SQL expression for `phrase` with its word runs wrapped."""
    parts, pos = [], 0
    for m in re.finditer(r"\w+", phrase):
        if m.start() > pos:
            parts.append(q(phrase[pos:m.start()]))
        parts += ["chr(1)", q(m.group(0)), "chr(2)"]
        pos = m.end()
    if pos < len(phrase):
        parts.append(q(phrase[pos:]))
    return " || ".join(parts)


# --- fixture views -----------------------------------------------------------

def sql_derive_gloss(line: str) -> str:
    u = rs(upper(line), r"[^\p{L}\p{N}\s]", "")
    toks = f"list_filter(regexp_split_to_array({u}, '\\s+'), lambda t: t <> '')"
    markers = "[" + ", ".join(q(m) for m in PRONOUN_MARKERS) + "]"
    body = ("CASE WHEN (i - 1) % 9 = 1 THEN 'DESC-' || t "
            "WHEN (i - 1) % 9 = 4 THEN t || ' X-POSS' "
            f"WHEN (i - 1) % 9 = 6 THEN {markers}[((i - 1) // 9) % 4 + 1] || ' ' || t "
            "WHEN (i - 1) % 9 = 7 AND ((i - 1) // 9) % 3 = 0 THEN 'MEMBERSHIP PARLIAMENT ' || t "
            "ELSE t END")
    return f"array_to_string(list_transform({toks}, lambda t, i: {body}), ' ')"


def sql_derive_hypothesis(line: str, doc_id: str, pos: str) -> str:
    toks = words(line)
    arts = ", ".join(q(w) for w in HYP_DROPPED_WORDS)
    drop_pos = join(f"list_filter({toks}, lambda t, i: (i - 1) % 7 <> 3)")
    drop_art = join(f"list_filter({toks}, lambda t: lower(t) NOT IN ({arts}))")
    return (f"(CASE WHEN {pos} % 11 = 10 THEN '' WHEN {doc_id} % 3 = 0 THEN {drop_pos} "
            f"WHEN {doc_id} % 3 = 1 THEN {drop_art} ELSE {line} END)")


def sql_derive_gloss_hypothesis(gloss: str) -> str:
    kept = f"list_filter({words(gloss)}, lambda t, i: (i - 1) % 5 <> 2)"
    return join(f"list_transform({kept}, lambda t, i: CASE WHEN (i - 1) % 4 = 3 THEN lower(t) ELSE t END)")


DOC_LINES = ("doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
             "unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)")

PAIRS = ("pairs AS (SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS id, doc_id, pos, "
         f"{sql_derive_gloss('line')} AS gloss, line AS translation FROM doc_lines)")

DIALOG = ("dialog AS (SELECT CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS id, "
          f"{sql_derive_gloss('u.text')} AS gloss, a.text AS translation "
          "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
          "WHERE u.role = 'user' AND a.role = 'assistant')")

PREDS = ("preds AS (SELECT id, doc_id, pos, translation AS reference, "
         f"{sql_derive_hypothesis('translation', 'doc_id', 'pos')} AS prediction, "
         f"gloss AS ref_gloss, {sql_derive_gloss_hypothesis('gloss')} AS pred_gloss FROM pairs)")


def raw_lines_cte(side: str = "gloss", name: str = "raw_lines") -> str:
    v = side
    rendered = (f"CASE WHEN pos % 10 = 9 THEN '# ' || {v} "
                f"WHEN doc_id % 4 = 0 THEN id || chr(9) || {v} "
                f"WHEN doc_id % 4 = 1 THEN id || '|' || {v} "
                f"WHEN doc_id % 4 = 2 THEN id || '::' || {v} ELSE {v} END")
    return (f"{name} AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS ord, "
            f"{rendered} AS value FROM pairs)")


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (DOC_LINES, PAIRS)
WITH_PAIRS = with_views(*BASE)
WITH_PREDS = with_views(*BASE, PREDS)


# --- normalisers (mirror glosspark.functions.normalize) ------------------------

def gloss_markers(t: str, pronouns) -> str:
    t = rep(t, "X-POSS", "'S")
    for k, v in pronouns:
        t = rep(t, k, v)
    t = rs(t, "DESC-([A-Z]+)", "\\1")
    return rep(t, "DESC-NOT", "NOT")


def normalize_gloss_v1(x: str) -> str:
    return squash(gloss_markers(upper(s(x)), L.PRONOUNS_V1))


def normalize_gloss_v2(x: str) -> str:
    t = gloss_markers(upper(clean_invisibles(strip(s(x)))), L.PRONOUNS_V2)
    t = wrap(t)
    for a, b in L.V2_DROPPED_PHRASES:
        t = rs(t, wrapped_regex(a) + WS + "+" + wrapped_regex(b), "")
    return squash(unwrap(t))


def _currency(t: str) -> str:
    return rs(t, r"(?i)EUR" + WS + r"*(\p{Nd}+(?:\.\p{Nd}+)?)", "eur \\1")


def numbers_g2t(x: str) -> str:
    return _currency(rs(x, r"(\p{Nd}+)" + WS + "*%", "\\1 %"))


def numbers_t2g(x: str) -> str:
    return _currency(rs(x, r"(\p{Nd}+)" + WS + "*%", "\\1 percent"))


def _word_splits(t: str) -> str:
    for w, r in (("inthe", "in the"), ("onthe", "on the"), ("tothe", "to the")):
        t = rs(t, "(?i)" + w + "(" + NW + "|$)", r + "\\1")
    return t


def fix_errors_g2t(x: str) -> str:
    t = rs(x, "(" + W + ")([,.])", "\\1 \\2")
    t = rs(t, WS + "+([,.!?])", "\\1")
    t = _word_splits(t)
    t = rs(t, "(?i)can't", "cannot")
    return rs(t, "(?i)won't", "will not")


def fix_errors_t2g(x: str) -> str:
    t = rs(x, "(" + W + ")([,.])", "\\1 \\2")
    t = rs(t, WS + "+([,.!?])", " \\1")
    return _word_splits(t)


def process_gloss_v1(x: str) -> str:
    return lower(fix_errors_g2t(numbers_g2t(normalize_gloss_v1(x))))


def process_gloss_v2(x: str) -> str:
    n = normalize_gloss_v2(x)
    out = squash(lower(fix_errors_g2t(numbers_g2t(n))))
    return f"(CASE WHEN {blank(x)} OR {strip(n)} = '' THEN '' ELSE {out} END)"


def process_target_text(x: str) -> str:
    t = fix_errors_g2t(numbers_g2t(strip(s(x))))
    t = rs(t, WS + "*," + WS + "*", ", ")
    t = rs(t, WS + r"*\." + WS + "*", ". ")
    return squash(t)


def normalize_text_for_gloss(x: str) -> str:
    t = wrap(lower(clean_invisibles(strip(s(x)))))
    for k, v in L.CONTRACTIONS:
        t = rr(t, "(?i)" + wrapped_regex(k), wrapped_text(v))
    inst = "|".join(L.INSTITUTIONS)
    t = rs(t, r"\x01the\x02" + WS + r"+(\x01(?:" + inst + "))", "\\1")
    t = unwrap(t)
    t = rs(t, WS + "*," + WS + "*", " , ")
    t = rs(t, WS + r"*\." + WS + "*", " . ")
    t = rs(t, WS + "*!" + WS + "*", " !")
    t = rs(t, WS + r"*\?" + WS + "*", " ?")
    return squash(t)


def process_text(x: str) -> str:
    n = normalize_text_for_gloss(x)
    out = squash(fix_errors_t2g(numbers_t2g(n)))
    return f"(CASE WHEN {blank(x)} OR {strip(n)} = '' THEN '' ELSE {out} END)"


def process_gloss_target(x: str) -> str:
    return squash(upper(clean_invisibles(strip(s(x)))))


def fix_titles_ws(w: str) -> str:
    """T10 over an already tokenised list column `w`."""
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.TITLE_BY_SURNAME.items())
    titles = ", ".join(q(t) for t in L.TITLES)
    nxt = f"(CASE lower({w}[i + 1]) {cases} END)"
    body = (f"CASE WHEN lower({w}[i]) IN ({titles}) AND i < len({w}) AND {nxt} IS NOT NULL "
            f"THEN {nxt} ELSE {w}[i] END")
    return join(f"list_transform(range(1, len({w}) + 1), lambda i: {body})")


def fix_titles(x: str) -> str:
    return fix_titles_ws(f"({words(s(x))})")


def insert_articles(x: str) -> str:
    inst = "|".join(L.INSTITUTIONS_POST)
    t = wrap(s(x))
    t = rr(t, r"(?i)\x01(" + inst + r")\x02", "'the ' || chr(1) || '\\1' || chr(2)")
    t = rs(t, r"(?i)(the\x02 |a\x02 |an\x02 )the (\x01(?:" + inst + r")\x02)", "\\1\\2")
    t = wrap(unwrap(t))
    eu = r"\x01european\x02 \x01union\x02"
    t = rr(t, r"(?i)(" + eu + ")", "'the ' || '\\1'")
    t = rs(t, r"(?i)(the\x02 |a\x02 |an\x02 )the (" + eu + ")", "\\1\\2")
    return unwrap(t)


def normalize_punctuation(x: str) -> str:
    t = rs(x, WS + "*," + WS + "*", ", ")
    t = rs(t, WS + r"*\." + WS + "*", ". ")
    t = rs(t, WS + "*!" + WS + "*", "!")
    t = rs(t, WS + r"*\?" + WS + "*", "?")
    return rs(t, r"[ .,!?]+$", "")


def post_process_text(x: str) -> str:
    return squash(normalize_punctuation(insert_articles(fix_titles(x))))


def post_process_text_ws(w: str) -> str:
    return squash(normalize_punctuation(insert_articles(fix_titles_ws(w))))


def fix_gloss_structure(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.GLOSS_CORRECTIONS.items())
    w2 = "replace(w, '''S', '-POSS')"
    return join(f"list_transform({words(s(x))}, lambda w: CASE {w2} {cases} ELSE {w2} END)")


def normalize_gloss_format(x: str) -> str:
    return rs(squash(upper(x)), "[,.]", "")


def post_process_gloss(x: str) -> str:
    return squash(normalize_gloss_format(fix_gloss_structure(x)))


def preserve_gloss_notation(x: str) -> str:
    t = collapse(strip(s(x)))
    return f"replace(replace(replace({t}, chr(8203), ''), chr(65279), ''), chr(160), ' ')"


def process_english_text(x: str) -> str:
    t = lower(collapse(strip(s(x))))
    return rs(rs(t, "[.!?]+", "."), ",+", ",")


def strip_spatial_markers(x: str) -> str:
    t = s(x)
    for m in L.SPATIAL_MARKERS:
        t = rep(t, m, "")
    return f"translate({strip(t)}, '+-', '  ')"


def extract_generation(x: str) -> str:
    t = strip(f"split_part({s(x)}, chr(10), 1)")
    return f"(CASE WHEN contains({t}, '<|') THEN {strip(f'split_part({t}, {q(chr(60) + chr(124))}, 1)')} ELSE {t} END)"


def clean_translation(x: str) -> str:
    return lower(strip(x))


def clean_gloss(x: str) -> str:
    return strip(x)


def clean_text(x: str) -> str:
    return f"replace(lower({join(words(x))}), '_', ' ')"
