"""Mixing sources to target weights (native DataFrame operations only).

Every document gets a hash-random key. Within a source, documents are dealt by
key into about sqrt(n) ranges; the word counts of the ranges give, by a prefix
sum over ranges, the one range in which the source's budget ends, and a running
sum inside that range gives the exact cut. So no source is ever sorted in one
task, and the corpus itself is not shuffled: each document compares its own key
with the cut of its source. A budget above the source's size repeats the source
in whole epochs and cuts the last one.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; documents whose key ties (repeated rows) at the cut share what is
left in proportion to their size, rounded down; an empty table gives no rows;
output columns replace input columns of the same name, others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosspark.llm.common import checkpointed, md5_60, small_side, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix"
_HALF = 30  # keys have 60 bits
_PRIVATE = {"_key", "_src", "_epochs", "_cut", "_tied", "_left"}


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_size, n) -> the same with `target`: weights by code-point order of
    the source name (null last), `share` of all words dealt by weight, a target stopping at
    `max_repeats` sizes and the excess dealt again by weight until none is above.

    In order of cap/weight, the level that shares what earlier (capped) sources leave among
    the rest rises while sources are capped and falls afterwards: its maximum is the final
    level. The unpartitioned windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (sizes.withColumn("_rank", F.row_number().over(by_name))
            .withColumn("_w", w)
            .withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
            .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
            .withColumn("_level", (F.lit(float(share)) * F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                        / F.sum("_w").over(after))
            .withColumn("_level", F.max("_level").over(everything))
            .withColumn("target", F.least("_cap", F.greatest(F.col("_level"), F.lit(0.0)) * F.col("_w")))
            .select("source", "source_size", "n", "target"))


def with_size_and_key(docs: DataFrame, id_col="doc_id", text_col="text", seed=SEED) -> DataFrame:
    """`size` (words) and `_key` (60 random bits from seed, id and text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({
        "size": word_count(F.col(text_col)),
        "_key": md5_60(F.lit(seed), F.col(id_col), F.md5(text.cast("binary"))),
    })


def cuts(keyed: DataFrame, **targets) -> DataFrame:
    """One row per source: whole epochs, and where the last epoch ends: keys below `_cut`
    are taken whole, the key `_cut` (with `_tied` words) gives `_left` words."""
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = checkpointed(source_targets(sizes, **targets).withColumns({
        "_budget": F.floor("target").cast("long"),
        "_ranges": F.ceil(F.sqrt("n")).cast("long"),
    }).withColumns({
        "_epochs": F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)),
    }).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size")))

    g = small_side(goal.select(F.col("source").alias("_s"), "_ranges", "_rest"))
    rng = F.shiftright(F.shiftright("_key", _HALF) * F.col("_ranges"), _HALF)
    ranged = keyed.join(g, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_range", rng)
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
            .filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words"))))
    e = small_side(checkpointed(edge.select(F.col("source").alias("_es"), F.col("_range").alias("_er"), "_before")))

    inside = (ranged.join(e, F.col("source").eqNullSafe(F.col("_es")) & (F.col("_range") == F.col("_er")))
              .groupBy("source", "_key", "_before", "_rest").agg(F.sum("size").alias("_tied")))
    run = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (inside.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_tied").over(run), F.lit(0)))
           .filter((F.col("_upto") <= F.col("_rest")) & (F.col("_rest") < F.col("_upto") + F.col("_tied")))
           .select(F.col("source").alias("_cs"), F.col("_key").alias("_cut"), "_tied", (F.col("_rest") - F.col("_upto")).alias("_left")))
    return (goal.join(cut, goal["source"].eqNullSafe(cut["_cs"]), "left")
            .select(goal["source"].alias("_src"), "source_size", "target", "_epochs", "_cut", "_tied", "_left"))


def apply_cuts(keyed: DataFrame, per_source: DataFrame) -> DataFrame:
    """Attach source_size, target and taken to every document."""
    part = (F.when(F.col("_key") < F.col("_cut"), F.col("size"))
            .when(F.col("_key") == F.col("_cut"), F.expr("(size * _left) div _tied"))
            .otherwise(F.lit(0)))
    side = small_side(checkpointed(per_source))
    return (keyed.drop("source_size", "target", "taken")
            .join(side, F.col("source").eqNullSafe(F.col("_src")))
            .withColumn("taken", (F.col("_epochs") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long"))
            .drop("_src", "_epochs", "_cut", "_tied", "_left"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED, **targets) -> DataFrame:
    """All documents with size, source_size, target and taken (words, repeats counted).
    Keeps every input column; `source_col` is read as the source."""
    own = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in _PRIVATE and c not in (id_col, text_col, source_col)}
    docs = docs.withColumnsRenamed(own)                 # columns of the input with the names used here
    named = docs if source_col == "source" else docs.withColumn("source", F.col(source_col))
    keyed = with_size_and_key(named, id_col, text_col, seed)
    narrow = checkpointed(keyed.select("source", "size", "_key"))
    return apply_cuts(keyed, cuts(narrow, **targets)).drop("_key").withColumnsRenamed({v: k for k, v in own.items()})
