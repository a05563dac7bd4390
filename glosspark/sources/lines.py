"""Line-oriented parallel-corpus sources.

Every parser takes a `lines` DataFrame `(ord bigint, value string)`: the
physical 0-based line number and the raw line. `read_lines` builds it from a
text file (one file at a time, so partition order is line order); the
fixtures build it from the driver tables. Parsing is pure column logic, so
it runs split-parallel with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions.text import strip
from glosspark.operators.ordinals import with_ordinal

TAB = "\t"
AUTO_DELIMITERS = [(TAB, "\t"), ("|", r"\|"), ("::", "::")]   # (literal, regex), tried in order


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text file -> (ord, value); ord is the 0-based physical line number.

    The file's splits are read in offset order, so numbering rows in partition
    order gives file order; offsets come from per-partition counts (no single-task window)."""
    df = spark.read.text(path)
    if len(df.inputFiles()) > 1:    # several files are packed by size, so their order is not the line order
        raise ValueError(f"read one file at a time: {path} holds several")
    return with_ordinal(df).select(F.col("ord").cast("bigint"), F.col("value"))


def _split_once(v: Column, delims) -> tuple[Column, Column, Column]:
    """First delimiter contained in v wins; split once; (matched?, left, right)."""
    hit = None
    left = right = None
    for lit, regex in delims:
        cond = F.instr(v, lit) > 0
        parts = F.split(v, regex, 2)
        if hit is None:
            hit, left, right = cond, F.when(cond, F.get(parts, 0)), F.when(cond, F.get(parts, 1))
        else:
            left = F.when(hit, left).when(cond, F.get(parts, 0))
            right = F.when(hit, right).when(cond, F.get(parts, 1))
            hit = hit | cond
    return hit, left, right


def parse_pairs(lines: DataFrame, value_name: str, fmt: str = "auto", dataset: str | None = None) -> DataFrame:
    """Strip; skip blank and '#' lines; split once on the first of TAB, '|', '::'
    contained in the line (TAB only unless fmt='auto'); strip both sides -> (id, value).
    Lines with no delimiter get id 'aslg_%06d' of their line number when fmt or dataset
    is 'aslg', and are dropped otherwise."""
    v = strip(F.col("value"))
    kept = lines.select("ord", v.alias("_v")).filter((F.col("_v") != "") & ~F.col("_v").startswith("#"))
    delims = AUTO_DELIMITERS if fmt == "auto" else AUTO_DELIMITERS[:1]
    hit, left, right = _split_once(F.col("_v"), delims)
    aslg = fmt == "aslg" or dataset == "aslg"
    ident = F.when(hit, strip(left))
    val = F.when(hit, strip(right))
    if aslg:
        ident = ident.otherwise(F.format_string("aslg_%06d", F.col("ord")))
        val = val.otherwise(F.col("_v"))
        out = kept
    else:
        out = kept.filter(hit)
    return out.select(ident.alias("id"), val.alias(value_name))


def parse_pairs_loose(lines: DataFrame, value_name: str) -> tuple[DataFrame, DataFrame]:
    """As S1 (auto), then fall back to `^(\\S+)\\s+(.+)$`; unparsable lines go to a
    reject DataFrame (line_num 1-based, first 50 characters)."""
    v = strip(F.col("value"))
    kept = lines.select("ord", v.alias("_v")).filter((F.col("_v") != "") & ~F.col("_v").startswith("#"))
    hit, left, right = _split_once(F.col("_v"), AUTO_DELIMITERS)
    rx = r"(?U)^(\S+)\s+(.+)$"
    loose = F.col("_v").rlike(rx)
    tagged = kept.select(
        "ord", "_v", hit.alias("_hit"), loose.alias("_loose"),
        F.when(hit, strip(left)).when(loose, F.regexp_extract("_v", rx, 1)).alias("id"),
        F.when(hit, strip(right)).when(loose, F.regexp_extract("_v", rx, 2)).alias(value_name))
    parsed = tagged.filter(F.col("_hit") | F.col("_loose")).select("id", value_name)
    rejects = tagged.filter(~(F.col("_hit") | F.col("_loose"))).select(
        (F.col("ord") + 1).alias("line_num"), F.substring("_v", 1, 50).alias("snippet"))
    return parsed, rejects


def parse_tab_fields(lines: DataFrame, value_name: str) -> DataFrame:
    """Strict TAB split of the stripped line; first two fields (missing -> null).
    No blank/comment skipping: a blank line yields id '' and a null value."""
    parts = F.split(strip(F.col("value")), TAB)
    return lines.select(F.get(parts, 0).alias("id"), F.get(parts, 1).alias(value_name))


def parse_tab_exact(lines: DataFrame, value_name: str) -> DataFrame:
    """Keep only lines with exactly two TAB fields; the id is discarded, the
    line number is kept so two files can be paired by position."""
    parts = F.split(strip(F.col("value")), TAB)
    return lines.filter(F.size(parts) == 2).select("ord", F.get(parts, 1).alias(value_name))
