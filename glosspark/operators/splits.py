"""Deterministic sampling and splits.

Randomness is a content hash: each row's place in a pseudo-random order is
(hash(seed:key), hash(row)), independent of partitioning and reproducible in
SQL. Sizes are exact: `exact_cut` finds the boundary rows with bounded
histograms instead of sorting or windowing the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.functions import lexicon as L
from glosspark.operators.ordinals import exact_cut, rank_keys

SMALL_N = 100_000   # up to this many rows, a top-N sort (per-partition top-N, then merge) is cheaper


def _keyed(df: DataFrame, key, seed) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return rank_keys(df, k, sorted(df.columns), seed)


def sample_exact(df: DataFrame, n: int, key="id", seed=L.DEFAULT_SEED) -> DataFrame:
    """Exactly n rows (all rows when the table has no more than n)."""
    kd = _keyed(df, key, seed)
    if n <= SMALL_N:
        return kd.orderBy("_h", "_t").limit(n).drop("_h", "_t")
    return exact_cut(kd, [n]).filter(F.col("_side") == 0).drop("_h", "_t", "_side")


def head_in_order(df: DataFrame, n: int, key="id", seed=L.DEFAULT_SEED) -> DataFrame:
    """the first min(n, rows) rows of a split in its shuffled order (with that order)."""
    kd = _keyed(df, key, seed)
    return kd.orderBy("_h", "_t").limit(n)


def assign_split(df: DataFrame, sizes_from_n, names: list[str], key="id", seed=L.DEFAULT_SEED,
                 split_col: str = "split", keep_keys: bool = False) -> DataFrame:
    """Generic exact split: `sizes_from_n(n)` gives the cut points in rank order.
    `keep_keys` keeps the order columns (_h, _t) for later first-seen logic."""
    kd = _keyed(df, key, seed)
    cut = exact_cut(kd, sizes_from_n)
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_side") + 1)
    out = cut.withColumn(split_col, name).drop("_side")
    return out if keep_keys else out.drop("_h", "_t")


def train_validation(df: DataFrame, test_size: float = 0.2, key="id", seed=L.DEFAULT_SEED) -> DataFrame:
    """SP1: validation = ceil(test_size * n) rows, the rest train."""
    return assign_split(df, lambda n: [math.ceil(test_size * n)], ["validation", "train"], key, seed)


def three_way_halves(df: DataFrame, key="id", seed=L.DEFAULT_SEED) -> DataFrame:
    """SP2: 20 % held out (ceil), split in half: test = ceil(0.5 * held), eval = rest."""
    def cuts(n):
        held = math.ceil(0.2 * n)
        return [math.ceil(0.5 * held), held]
    return assign_split(df, cuts, ["test", "eval", "train"], key, seed)


def three_way_floors(df: DataFrame, key="id", seed=L.DEFAULT_SEED, keep_keys: bool = False) -> DataFrame:
    """SP3: train = int(0.8 n), val = int(0.1 n), test = the rest."""
    return assign_split(df, lambda n: [int(0.8 * n), int(0.8 * n) + int(0.1 * n)],
                        ["train", "val", "test"], key, seed, keep_keys=keep_keys)


def parent_id(id_col: str = "id") -> Column:
    """SP5: augmented rows (`<id>_aug`) share their parent's key."""
    return F.regexp_replace(F.col(id_col), "_aug$", "")


def grouped_train_validation(df: DataFrame, test_size: float = 0.2, seed=L.DEFAULT_SEED) -> DataFrame:
    """SP5 leak-safe mode: the split is decided per parent, so a pair and its augmented
    copies land on the same side. Sizes are exact in parents (ceil of the parent count).

    Only the distinct parents are cut; the place of the last validation parent in the hash order is one
    row, and every row compares its own parent's place with it, without a join."""
    parents = df.select(parent_id().alias("id")).distinct()
    cut = assign_split(parents, lambda n: [math.ceil(test_size * n)], ["validation", "train"], "id", seed, keep_keys=True)
    last = cut.filter(F.col("split") == "validation").agg(F.max(F.struct("_h", "_t")).alias("m")).first()["m"]
    if last is None:
        return df.withColumn("split", F.lit("train"))
    keyed = rank_keys(df.withColumn("_pid", parent_id()), F.col("_pid"), ["_pid"], seed)
    side = F.when(F.struct("_h", "_t") <= F.struct(F.lit(last["_h"]), F.lit(last["_t"])), "validation").otherwise("train")
    return keyed.withColumn("split", side).drop("_pid", "_h", "_t")
