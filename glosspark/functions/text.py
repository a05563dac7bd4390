"""Column helpers with Python `str` semantics, written as JVM-side expressions.

Python's `re` and `str` methods are Unicode-aware; Java regexes are not unless
asked, so every pattern that uses \\s, \\w, \\d or \\b carries the `(?U)` flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(c, pattern: str, repl: str) -> Column:
    """regexp_replace with Unicode character classes (Python `re` semantics)."""
    return F.regexp_replace(col(c), "(?U)" + pattern, repl)


def lit_replace(c, search: str, repl: str) -> Column:
    """str.replace: plain substring replacement, no regex."""
    return F.replace(col(c), F.lit(search), F.lit(repl))


def strip(c) -> Column:
    """str.strip(): Unicode whitespace at both ends (not BOM, not U+200B)."""
    return rx(c, r"^\s+|\s+\z", "")


def collapse(c) -> Column:
    """re.sub(r'\\s+', ' ', s)."""
    return rx(c, r"\s+", " ")


def squash(c) -> Column:
    """re.sub(r'\\s+', ' ', s).strip(): after the first step every blank is a plain space."""
    return F.trim(collapse(c))


def words(c) -> Column:
    """str.split() with no argument: whitespace runs, no empty tokens."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def join_words(arr) -> Column:
    """' '.join(tokens)."""
    return F.array_join(col(arr), " ")


def blank(c) -> Column:
    """`not isinstance(x, str) or not x.strip()`."""
    return col(c).isNull() | (strip(c) == "")


def clean_invisibles(c) -> Column:
    """Drop BOM, turn NBSP into a space (the reference's v2 cleaning)."""
    return lit_replace(lit_replace(c, "\ufeff", ""), "\u00a0", " ")


def pyupper(c) -> Column:
    """str.upper(); Spark and Python agree on sharp s -> SS."""
    return F.upper(col(c))


def pylower(c) -> Column:
    return F.lower(col(c))


def is_upper_token(c) -> Column:
    """str.isupper(): one cased upper-case letter and no lower/title-case letter."""
    return col(c).rlike(r"\p{IsUppercase}") & ~col(c).rlike(r"[\p{IsLowercase}\p{Lt}]")
