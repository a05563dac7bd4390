"""Ordinals and exact cuts: exact sizes, disjoint sides, skew, partition invariance."""

import math

import pytest
from pyspark.sql import functions as F

from glosspark.operators.joins import positional_pairs
from glosspark.operators.ordinals import exact_cut, rank_keys, sorted_ordinal, with_ordinal
from glosspark.operators.splits import sample_exact, three_way_floors, train_validation
from glosspark.sources.lines import read_lines


def test_read_lines_numbers_physical_lines(spark, tmp_path):
    p = tmp_path / "f.txt"
    lines = [f"line {i}" if i % 7 else "" for i in range(5000)]
    p.write_text("\n".join(lines) + "\n")
    got = read_lines(spark, str(p)).collect()
    assert sorted((r.ord, r.value) for r in got) == list(enumerate(lines))


def test_sorted_ordinal_dense(spark):
    df = spark.range(20000).withColumn("k", F.xxhash64("id")).repartition(7)
    o = sorted_ordinal(df, ["k"]).select("k", "ord").collect()
    assert [r.ord for r in sorted(o, key=lambda r: r.k)] == list(range(20000))


def test_exact_cut_hot_group(spark):
    """A third of the rows are one identical row; a cut falls inside that group."""
    n = 3000
    rows = [(f"id{i}", "x") for i in range(2 * n // 3)] + [("hot", "same")] * (n // 3)
    df = spark.createDataFrame(rows, "id string, v string").repartition(5)
    kd = rank_keys(df, F.col("id"), ["id", "v"], 42)
    hot_rank = sorted(r.k for r in kd.select(F.struct("_h", "_t").alias("k")).collect()).index(
        kd.filter(F.col("id") == "hot").select(F.struct("_h", "_t").alias("k")).first().k)
    cuts = [hot_rank + 100, hot_rank + 700]
    out = exact_cut(kd, cuts).groupBy("_side").count().collect()
    sizes = {r["_side"]: r["count"] for r in out}
    assert sizes == {0: cuts[0], 1: cuts[1] - cuts[0], 2: n - cuts[1]}


def test_split_sizes_and_invariance(spark):
    df = spark.range(12345).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"))
    a = train_validation(df.repartition(1)).collect()
    b = train_validation(df.repartition(16)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    val = sum(1 for r in a if r.split == "validation")
    assert val == math.ceil(0.2 * 12345)
    f = three_way_floors(df).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in f} == {"train": 9876, "val": 1234, "test": 1235}
    assert sample_exact(df, 777).count() == 777


def test_positional_pairs_report_a_shorter_text_side(spark):
    gloss = spark.createDataFrame([(i, f"G{i}") for i in range(5)], "ord long, gloss string")
    text = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "ord long, translation string")
    assert positional_pairs(gloss, text).count() == 5
    assert positional_pairs(gloss.filter("ord < 3"), text).count() == 3
    with pytest.raises(ValueError, match="5 gloss lines, 3 text lines"):
        positional_pairs(gloss, text.filter("ord < 3"))
