"""Corpus preparation on a stream of document files (Structured Streaming).

Every preparation step is a stateless column expression, so the same plan
runs on `readStream`: new document files are split into lines, normalised,
band-filtered and appended to a sink. Progress lives in a checkpoint under
the cluster's shared checkpoint folder, so a restarted query resumes exactly.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.functions import normalize as N
from glosspark.plans.corpus import length_band
from glosspark.plans.fixtures import derive_gloss
from glosspark.session import checkpoint_dir

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def prepare_lines(docs: DataFrame) -> DataFrame:
    """documents -> (id, gloss, text) prepared for text->gloss, batch or streaming alike."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = lines.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id"),
        N.process_gloss_target(derive_gloss(F.col("line"))).alias("gloss"),
        N.process_text(F.col("line")).alias("text"))
    return length_band(out)


def stream_prepared(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming DataFrame over parquet document files matching `path` (a directory or glob)."""
    docs = (spark.readStream.schema(DOCUMENTS_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))
    return prepare_lines(docs)


def start_to_parquet(df: DataFrame, out_path: str, name: str = "prepared", available_now: bool = True):
    """Append the prepared stream to parquet; checkpoint in the shared checkpoint folder, one per
    name and output, so that two streams never share offsets."""
    key = hashlib.sha256(out_path.encode()).hexdigest()[:16]
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), "streams", f"{name}-{key}")
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
