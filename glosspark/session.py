"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "glosspark") -> SparkSession:
    """Local session with AQE on and the web UI off (tests, bench)."""
    parts = shuffle_partitions or (8 if cores == "*" else max(2, int(cores)))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GLOSSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: spark.checkpoint.dir, else the one the context has.

    Only a local master gets a folder of our own; a cluster must name one, as a driver's
    local folder is not seen by executors."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="glosspark-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system its scheme names (the default one without)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallelism(df: DataFrame, key: str, factor: int = 2) -> DataFrame:
    """Spread a scan that arrives in too few partitions (one small file / one row group).

    Large tables already come in thousands of splits, so this is a no-op there
    (no shuffle); only a source with fewer partitions than the cluster has
    cores is hash-distributed on its key. (Round-robin would not do: its row
    placement depends on which columns survive pruning, so two branches of one
    plan could see different partitions.)
    """
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() < want // factor:
        return df.repartition(want, key)
    return df
