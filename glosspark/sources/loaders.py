"""Dataset loaders: file sets -> one parallel-corpus DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions.text import strip
from glosspark.operators.joins import join_on_id
from glosspark.session import path_exists
from glosspark.sources.lines import parse_pairs, read_lines

PIPE_SPLITS = ("train", "dev", "test")


def parse_pipe_split(lines: DataFrame, split: str) -> DataFrame:
    """S4 for one file: split the stripped line on '|'; >= 3 fields; gloss = field 0,
    translation = field 1 (both stripped); id '{split}_%06d' of the physical line number."""
    parts = F.split(strip(F.col("value")), r"\|")
    return (lines.filter(F.size(parts) >= 3)
            .select(F.format_string(f"{split}_%06d", F.col("ord")).alias("id"),
                    strip(F.get(parts, 0)).alias("gloss"),
                    strip(F.get(parts, 1)).alias("translation"),
                    F.lit(split).alias("split")))


def load_pipe_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """train/dev/test files, each numbered on its own; absent files are skipped."""
    parts = [parse_pipe_split(read_lines(spark, p), s) for s, p in paths.items() if path_exists(spark, p)]
    if not parts:
        return spark.createDataFrame([], "id string, gloss string, translation string, split string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_combined(lines: DataFrame) -> DataFrame:
    """Lines containing a TAB; stripped; split on TAB; >= 2 fields;
    translation first, gloss second; id 'aslg_%06d'."""
    parts = F.split(strip(F.col("value")), "\t")
    return (lines.filter((F.instr("value", "\t") > 0) & (F.size(parts) >= 2))
            .select(F.format_string("aslg_%06d", F.col("ord")).alias("id"),
                    strip(F.get(parts, 0)).alias("translation"),
                    strip(F.get(parts, 1)).alias("gloss")))


def load_parallel(spark: SparkSession, gloss_path: str, text_path: str, fmt: str = "auto",
                  dataset: str | None = None) -> DataFrame:
    """S1 on both files, then J1 inner join on id."""
    g = parse_pairs(read_lines(spark, gloss_path), "gloss", fmt, dataset)
    t = parse_pairs(read_lines(spark, text_path), "translation", fmt, dataset)
    return join_on_id(g, t)


def load_dataset(spark: SparkSession, dataset: str, **paths) -> DataFrame:
    """Dispatch on dataset type; unknown -> ValueError."""
    if dataset == "signum":
        return load_parallel(spark, paths.get("anno_path", "data/signum_sents_anno_eng.txt"),
                             paths.get("trans_path", "data/signum_sents_trans_eng.txt"))
    if dataset == "phoenix":
        return load_pipe_splits(spark, {
            "train": paths.get("train_path", "data/phoenix2014T.train.gloss"),
            "dev": paths.get("dev_path", "data/phoenix2014T.dev.gloss"),
            "test": paths.get("test_path", "data/phoenix2014T.test.gloss")})
    if dataset == "aslg":
        gp = paths.get("gloss_path", "data/aslg_pc12_glosses.txt")
        tp = paths.get("text_path", "data/aslg_pc12_text.txt")
        if path_exists(spark, gp) and path_exists(spark, tp):
            return load_parallel(spark, gp, tp, fmt="aslg", dataset="aslg")
        cp = paths.get("combined_path", "data/aslg_pc12_combined.txt")
        if path_exists(spark, cp):
            return parse_combined(read_lines(spark, cp))
        raise FileNotFoundError("ASLG dataset files not found")
    raise ValueError(f"Unsupported dataset type: {dataset}")


def data_dir_paths(data_dir: str, dataset: str) -> dict[str, str]:
    """Paths the command line builds from a data directory."""
    j = lambda n: os.path.join(data_dir, n)
    if dataset == "signum":
        return {"anno_path": j("signum_sents_anno_eng.txt"), "trans_path": j("signum_sents_trans_eng.txt")}
    if dataset == "phoenix":
        return {f"{s}_path": j(f"phoenix2014T.{s}.gloss") for s in PIPE_SPLITS}
    if dataset == "aslg":
        return {"gloss_path": j("aslg_pc12_glosses.txt"), "text_path": j("aslg_pc12_text.txt"),
                "combined_path": j("aslg_pc12_combined.txt")}
    raise ValueError(f"Unsupported dataset type: {dataset}")
