"""Personal data in text (native Column expressions only).

Regular expressions propose spans, validators confirm them (Luhn for cards,
mod-97 for IBANs, ranges and digit counts for the others), and words just before
a span adjust its score. Spans of the base kinds (email, ip, card, phone) that
pass their validator always stay; the further kinds (iban, ssn) need a score of
`MIN_SCORE`.

Positions come from the text between matches: `split` and `regexp_extract_all`
walk the same matches, so adding up lengths in one fold gives offsets in code
points. Patterns are written so that Java matches them without recursion or
quadratic rescans on very long runs (possessive groups; a run is entered only at
its start or where the last match ended), which leaves the matches unchanged.

Defined cases: null and empty texts have no spans; a match that fails its
validator is dropped and not searched again; spans of different kinds may
overlap; repeated rows each get their own spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, what the text must contain for a match to be possible, base kind
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None, True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True),
    ("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}", None, False),
    ("ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", "-", False),
]
KIND_ORDER = [k for k, *_ in KINDS]
BASE_KINDS = [k for k, _, _, base in KINDS if base]
#: Prior score, score when the validator holds, and words that raise it when they stand just before.
PRIOR = {"email": 0.7, "ip": 0.4, "card": 0.3, "phone": 0.4, "iban": 0.2, "ssn": 0.2}
CONFIRMED = {"email": 0.1, "ip": 0.2, "card": 0.5, "phone": 0.2, "iban": 0.6, "ssn": 0.1}
CONTEXT = {
    "email": "(?i)mail|contact|write to",
    "ip": "(?i)address|host|server|login",
    "card": "(?i)card|visa|credit|payment",
    "phone": "(?i)phone|call|mobile|fax",
    "iban": "(?i)iban|account|bank",
    "ssn": "(?i)ssn|social security",
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
MIN_SCORE = 0.5

_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    total = F.aggregate(
        F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                    .otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Mod-97 checksum: first four characters last, letters as 10..35, remainder 1."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(a, c):
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), luhn_ok(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97_ok(m)
    return F.lit(True)


def _spans_of(kind: str, rank: int, pattern: str, hint: str | None, base: bool, text: Column) -> Column:
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["g"])
        near = F.substring(x["g"], -CONTEXT_CHARS, CONTEXT_CHARS).rlike(CONTEXT[kind])
        score = F.lit(PRIOR[kind] + CONFIRMED[kind]) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        score = F.least(F.round(score, 2), F.lit(1.0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"),
                               F.lit(kind).alias("kind"), score.alias("score")))
        keep = x["m"].isNotNull() & _valid(kind, x["m"])
        if not base:
            keep = keep & (score >= F.lit(MIN_SCORE))
        return F.struct((start + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"),
                        F.when(F.coalesce(keep, F.lit(False)), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), nothing.alias("out")), step, lambda a: a["out"])
    possible = text.contains(hint) if hint else text.rlike("[0-9]")
    if hint in (".", "-"):
        possible = possible & text.rlike(r"[0-9]" + ("[.]" if hint == "." else "-") + "[0-9]")
    return F.when(possible, found).otherwise(nothing)


def spans(text: Column) -> Column:
    """All spans of a text: array<struct<start, rank, end, kind, score>>, ordered by start,
    then by kind as listed; offsets in code points, end exclusive."""
    t = F.coalesce(text, F.lit(""))
    each = [_spans_of(k, i, p, h, b, t) for i, (k, p, h, b) in enumerate(KINDS)]
    return F.sort_array(reduce(lambda a, b: F.concat(a, b), each))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """`docs` with the spans of its text column."""
    return docs.withColumn(out_col, spans(F.col(text_col)))
