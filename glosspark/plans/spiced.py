"""Pairs in which every normaliser rule finds something to change.

The corpus lines hold no gloss notation, numbers, titles or institutions. Here each line is
prefixed or followed by a phrase chosen by its place, glosses likewise, and some values are null, blank
or empty, so that a rule's query compares changed rows. The SQL twin is `SPICED`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.plans import fixtures as FX
from glosspark.plans import oracle as O

# --- fixed values of the derivation (shared with the SQL twin) ---------------
TEXT_PHRASES = [
    "EUR 25 of eur3.5 and 30% or 7 %",
    "I can't say, he won't; they're sure it's fine",
    "didn't Wouldn't mustn't i've",
    "Mr Angelilli and mrs Lamassoure met ms ashton",
    "MR bowles , MS Pagano saw mrs scheele",
    "commission and a council of european union",
    "the parliament and the Directive of the union",
    "inthe house onthe road tothe end",
    "\ufeff\u00a0invisible\u00a0marks\u200b here",
    "snake_case words_joined",
    "really ?! yes !!! no...",
    "first part <|end|> rest",
    "  spaced   out\ttext  ",
    "an european union budget , report .",
    "one,two.three ,, four",
]
GLOSS_PHRASES = [
    "X-I X-WE X-YOU X-HE",
    "DESC-NOT DESC-GOOD DAY X-POSS",
    "SEE  MINUTE THEN APPROVAL MINUTE DESC-PREVIOUS SIT",
    "COMMISSIONS AND PARLIAMENTS",
    "CAR'S HOUSE",
    "X-right GO X-left+SIT X-middle-HOME",
    "YES, NO. MAYBE,",
    "\ufeffA\u00a0B\u200bC",
    "lower Case gloss",
    "  WIDE   GAP\tTAB ",
    "SE X-IT X-SHE X-THEY X-Y X-MY",
    "EUR 5 20% won't",
]


def _phrase(phrases: list[str], at) -> F.Column:
    return F.get(F.array(*[F.lit(p) for p in phrases]), (at % len(phrases)).cast("int"))


def spiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, gloss, translation) of every line, with phrases, nulls, blanks and repeated ids."""
    p = FX.pairs(spark, sf_dir)
    at = F.col("doc_id") * 31 + F.col("pos")
    text, gloss = _phrase(TEXT_PHRASES, at), _phrase(GLOSS_PHRASES, at)
    after = at % 2 == 1
    t = F.when(after, F.concat_ws(" ", "translation", text)).otherwise(F.concat_ws(" ", text, F.col("translation")))
    g = F.when(after, F.concat_ws(" ", "gloss", gloss)).otherwise(F.concat_ws(" ", gloss, F.col("gloss")))
    return p.select(F.when(at % 47 == 0, F.lit("same")).otherwise(F.col("id")).alias("id"),
                    F.when(at % 53 == 0, F.lit(None)).when(at % 43 == 0, F.lit(" \t")).otherwise(g).alias("gloss"),
                    F.when(at % 59 == 0, F.lit(None)).when(at % 61 == 0, F.lit("")).otherwise(t).alias("translation"))


def _list(phrases: list[str]) -> str:
    return "[" + ", ".join(O.q(p) for p in phrases) + "]"


def _sql_phrase(phrases: list[str]) -> str:
    return f"({_list(phrases)})[(doc_id * 31 + pos) % {len(phrases)} + 1]"


def _either(col: str, phrases: list[str]) -> str:
    p = _sql_phrase(phrases)
    return f"CASE WHEN (doc_id * 31 + pos) % 2 = 1 THEN {col} || ' ' || {p} ELSE {p} || ' ' || {col} END"


SPICED = ("spiced AS (SELECT CASE WHEN (doc_id * 31 + pos) % 47 = 0 THEN 'same' ELSE id END AS id, "
          f"CASE WHEN (doc_id * 31 + pos) % 53 = 0 THEN NULL WHEN (doc_id * 31 + pos) % 43 = 0 THEN ' ' || chr(9) ELSE {_either('gloss', GLOSS_PHRASES)} END AS gloss, "
          f"CASE WHEN (doc_id * 31 + pos) % 59 = 0 THEN NULL WHEN (doc_id * 31 + pos) % 61 = 0 THEN '' ELSE {_either('translation', TEXT_PHRASES)} END AS translation FROM pairs)")
WITH_SPICED = O.with_views(*O.BASE, SPICED)
