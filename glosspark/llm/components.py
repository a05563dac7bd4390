"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import checkpointed, small_side


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, label): every linked node with the smallest node it reaches.

    Each round takes the smallest label among the neighbours and its own (a partial aggregate, so
    a hub is no hot group) and then the label of the label; it ends when a round changes nothing.
    The labels have one row per key, so a skewed key can be split; where they are measured small
    they are broadcast."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        known = small_side(labels)
        near = both.join(known.withColumnsRenamed({"node": "b"}), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        better = (near.unionByName(labels.select("node", "label", F.col("label").alias("old")))
                  .groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")))
        of = known.withColumnsRenamed({"label": "further", "node": "label"})
        jumped = checkpointed(better.join(of, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if jumped.filter("label <> old").limit(1).count() == 0:
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: components of the labels that the links join, applied to all."""
    known = small_side(labels)
    at = links.join(known.withColumnsRenamed({"node": "a", "label": "la"}), "a", "left").join(known.withColumnsRenamed({"node": "b", "label": "lb"}), "b", "left")
    joined = checkpointed(at.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
    of = components(joined).withColumnsRenamed({"label": "to", "node": "label"})
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).select("node", F.col("node").alias("label"))
    every = labels.unionByName(ends).groupBy("node").agg(F.min("label").alias("label"))
    return checkpointed(every.join(small_side(of), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
