"""The folder that every executor sees."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only if it is unset and the master is local (tests)."""
    out = spark.conf.get("spark.checkpoint.dir", None)
    if not out:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        out = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
        spark.conf.set("spark.checkpoint.dir", out)
    return out.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
