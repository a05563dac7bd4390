"""Sinks: split-partitioned corpus tables and metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_splits(df: DataFrame, path: str, split_col: str | list[str] = "split", mode: str = "overwrite") -> None:
    """Prepared corpus as parquet partitioned by split, or by several columns such as dataset and split; readers prune by them
    (`tables.stored_split`)."""
    cols = [split_col] if isinstance(split_col, str) else list(split_col)
    df.write.mode(mode).partitionBy(*cols).parquet(path)


def save_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows (one per split / dataset / task) as JSON lines."""
    metrics.write.mode(mode).json(path)
