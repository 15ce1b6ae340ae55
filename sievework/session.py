"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievework", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Whole documents travel through the one Arrow UDF: keep batches small in bytes.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``, gone when the session ends.

    Where the setting is absent, a session in this one process (``local``) gets a folder of its
    own; on a cluster that would be a folder other machines cannot see, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or (
            spark.sparkContext.master.startswith("local-cluster")
        ):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = os.path.join(root, f"{label}-{uuid.uuid4().hex}")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a reliable lineage cut."""
    path = work_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
