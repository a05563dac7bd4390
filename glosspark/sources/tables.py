"""Tabular corpus sources: named splits, column discovery, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.operators.joins import checked_broadcast


def named_split(df: DataFrame, preferred: str = "train", split_col: str = "split",
                order: list[str] | None = None) -> DataFrame:
    """Rows of split `preferred` if that split exists, else of the first split.

    Existence is probed with one row, the first name found with a minimum; with a table
    partitioned by split, the filters prune partitions at the scan."""
    if split_col not in df.columns:
        return df

    def there(name: str) -> bool:
        return df.filter(F.col(split_col) == name).limit(1).count() > 0

    pick = next((n for n in [preferred, *(order or [])] if there(n)), None)
    if pick is None:
        pick = df.agg(F.min(split_col)).first()[0]
    return df.filter(F.col(split_col) == pick)


def stored_splits(spark: SparkSession, path: str, split_col: str = "split") -> list[str]:
    """Names of the splits that `sinks.write_splits` stored: read from the partitions' names, no data file is opened."""
    return sorted(r[0] for r in spark.read.parquet(path).select(split_col).distinct().collect() if r[0] is not None)


def stored_split(spark: SparkSession, path: str, split: str, split_col: str = "split", datasets: DataFrame | None = None, dataset_col: str = "dataset") -> DataFrame:
    """S7 over a stored corpus: the rows of one split; only its partitions are read. With `datasets` (a small table with
    `dataset_col`) only those datasets, whose partitions are found when the query runs (dynamic pruning)."""
    df = spark.read.parquet(path).filter(F.col(split_col) == split)
    if datasets is None:
        return df
    return df.join(checked_broadcast(datasets.select(dataset_col).distinct()), dataset_col, "left_semi")


def discover_column(df: DataFrame, needle: str) -> str:
    """First column whose lower-cased name contains `needle`; error lists the columns."""
    for c in df.columns:
        if needle in c.lower():
            return c
    raise ValueError(f"no column containing '{needle}' in {df.columns}")


def gloss_text_columns(df: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """S8 + F1-style projection: (gloss, text) by discovery, or by fixed names
    such as {'English Gloss': 'gloss', 'English Text': 'text'}."""
    if fixed:
        return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in fixed.items()])
    g, t = discover_column(df, "gloss"), discover_column(df, "text")
    return df.select(F.col(f"`{g}`").alias("gloss"), F.col(f"`{t}`").alias("text"))


def project(df: DataFrame, keep: list[str]) -> DataFrame:
    """Hand-off projection (column pruning reaches the scan)."""
    return df.select(*keep)
