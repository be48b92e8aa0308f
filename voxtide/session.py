"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "voxtide", cpus: int | None = None, **conf) -> SparkSession:
    """A session for local runs; a cluster brings its own settings."""
    builder = SparkSession.builder.appName(app)
    if cpus:
        builder = builder.master(f"local[{cpus}]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A session on this machine alone (tests, laptops) that names none gets a local
    folder, and its checkpoints land there too. On any other master a folder that
    all executors share has to be named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="voxtide-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder, one tree per application."""
    app = spark.sparkContext.applicationId
    return os.path.join(checkpoint_root(spark), "voxtide", app, f"{purpose}-{uuid.uuid4().hex}")


def clear_shared(spark: SparkSession) -> None:
    """Remove what this application wrote below the shared folder, once its
    results have been stored elsewhere."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_root(spark), "voxtide", spark.sparkContext.applicationId))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back. The plan starts anew, the
    rows are computed once, and a lost executor costs a read."""
    path = shared_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
