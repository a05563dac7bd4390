"""Rules on lines that fire them, stored splits, user functions, batches and grouped splits."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from glosspark.operators import inference as INF
from glosspark.operators import splits as SP
from glosspark.operators import vocab as V
from glosspark.plans import catalog as CT
from glosspark.plans import fixtures as FX
from glosspark.plans import spiced as SC
from glosspark.sources import sinks, tables
from tests.conftest import SF001


def test_every_rule_changes_rows(spark):
    """At least 20 rows come out other than their trimmed, single-spaced, lower- or upper-cased selves."""
    rows = SC.spiced(spark, SF001).cache()
    plain = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    changed = {}
    for name, fn, _, col in CT._T_OPS:
        changed[name] = rows.filter(F.col(col).isNotNull()).filter(plain(fn(F.col(col))) != plain(F.col(col))).count()
    only_case = {"t1_clean_translation", "t1_clean_gloss", "t9b_process_gloss_target"}     # these trim and change case, no more
    assert {n: c for n, c in changed.items() if c < 20 and n not in only_case} == {}
    for name, fn, _, col in CT._T_OPS:
        if name in only_case:
            assert rows.filter(F.col(col).isNotNull() & (fn(F.col(col)) != F.col(col))).count() >= 20, name
    assert rows.filter("gloss is null").count() >= 20 and rows.filter("translation is null").count() >= 20
    assert rows.filter("trim(translation) = ''").count() >= 20 and rows.filter("id = 'same'").count() >= 20
    rows.unpersist()


def test_stored_splits_are_pruned(spark, tmp_path):
    df = FX.pairs(spark, SF001, extra=("lang",)).select("id", F.col("lang").alias("dataset"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("v"))
    df = df.select("id", "dataset", F.when(F.col("v"), "validation").otherwise("train").alias("split")).cache()
    path = str(tmp_path / "splits")
    sinks.write_splits(df, path, ["dataset", "split"])
    for split in ("validation", "train"):
        got = tables.stored_split(spark, path, split)
        assert got.count() == df.filter(F.col("split") == split).count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and f"= {split}" in plan.split("PartitionFilters")[1]
    wanted = spark.createDataFrame([("en",), ("de",)], "dataset string").filter("length(dataset) = 2")
    some = tables.stored_split(spark, path, "train", datasets=wanted)
    assert some.count() == df.filter("split = 'train' and dataset in ('en', 'de')").count()
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(tables.stored_splits(spark, path)) == ["train", "validation"]
    df.unpersist()


def test_user_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}", i * 2) for i in range(25)], "id long, text string, x long").repartition(3)

    def sizes():
        return lambda batch: {"n": [len(batch["id"])], "first": [min(batch["id"])]}
    got = INF.map_batches(df, sizes, "n long, first long", batch_rows=4).collect()
    assert sum(r["n"] for r in got) == 25 and max(r["n"] for r in got) <= 4
    assert INF.map_batches(df.limit(0), sizes, "n long, first long").count() == 0

    def odd():
        def run(row):
            if row["id"] == 7:
                raise ValueError("seven")
            return [] if row["id"] % 2 else [{"id": row["id"], "y": row["text"]}, {"id": row["id"], "y": None}]
        return run
    with pytest.raises(Exception, match="seven"):
        INF.map_rows(df, odd, "id long, y string").collect()
    rows = INF.map_rows(df, odd, "id long, y string", error_col="why").collect()
    assert len(rows) == 13 * 2 + 1 and [r["why"] for r in rows if r["why"]] == ["ValueError: seven"]


def test_a_failing_batch_names_itself(spark):
    def bad():
        return lambda batch: {"y": batch["id"], "z": batch["id"][1:]}
    with pytest.raises(Exception, match="column lengths"):
        INF.map_batches(spark.range(5), bad, "y long, z long").collect()
    with pytest.raises(Exception, match="no column"):
        INF.map_batches(spark.range(5), lambda: (lambda b: {"y": b["id"]}), "y long, z long").collect()


def test_batches_are_dense_and_padded(spark):
    rows = [(f"i{k:03}", [1] * (k * 37 % 23)) for k in range(100)] + [("null", None), ("same", [5]), ("same", [5])]
    df = spark.createDataFrame(rows, "id string, ids array<int>").repartition(7)
    got = collections.defaultdict(list)
    for r in V.form_batches(df, "ids", 32, order=["id"]).collect():
        got[r["batch"]].append(r["ids"])
    assert {b: len(x) for b, x in got.items()} == {0: 32, 1: 32, 2: 32, 3: 7}
    lengths = sorted(len(x or []) for _, x in rows)
    for b, x in got.items():
        assert {len(s) for s in x} == {max(lengths[32 * b:32 * b + 32])}
    assert V.form_batches(df.limit(0), "ids", 32, order=["id"]).count() == 0


def test_grouped_split_keeps_families_and_sizes(spark):
    ids = [f"p{i}" for i in range(101)]
    df = spark.createDataFrame([(i,) for i in ids for _ in range(2)] + [(f"{i}_aug",) for i in ids[::2]], "id string")
    out = SP.grouped_train_validation(df)
    side = collections.defaultdict(set)
    for r in out.collect():
        side[r["id"].removesuffix("_aug")].add(r["split"])
    assert all(len(s) == 1 for s in side.values()) and sum(s == {"validation"} for s in side.values()) == math.ceil(0.2 * 101)
    assert out.count() == df.count() and out.columns == ["id", "split"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert SP.grouped_train_validation(df.limit(0)).count() == 0
