"""Trajectory steps as JSON lines, appended, in folders by a hash of the session.

A session's steps are read from its own folder alone; lines that are no step are kept aside, blank ones skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders; a number for the life of a log.
FOLDERS = 64
SCHEMA = "timestamp timestamp, step_type string, session_id string, data map<string,string>, line string"
STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def folder(session_id: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(folders)).cast("int")


def append(steps: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """steps: timestamp, step_type, session_id, data (map of strings). Nothing that is there changes."""
    rows = steps.select("timestamp", "step_type", "session_id", "data").withColumn("folder", folder(F.col("session_id"), folders))
    rows.repartition("folder").write.mode("append").partitionBy("folder").options(**STAMP).json(path)


def end_sessions(finals: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Appends each session's final answer: session_id, timestamp, data. Sessions without data get no step."""
    append(finals.where("data is not null").withColumn("step_type", F.lit("FINAL_ANSWER")), path, folders)


def read(spark: SparkSession, path: str, sessions: list[str] | None = None, folders: int = FOLDERS) -> DataFrame:
    """Steps, and in `line` what could not be read as one; of the sessions alone if they are named (their folders alone are read)."""
    out = spark.read.schema("value string, folder int").text(path)
    if sessions is not None:
        named = spark.createDataFrame([(s,) for s in sessions], "s string").select(folder(F.col("s"), folders).alias("f")).distinct().collect()
        out = out.where(F.col("folder").isin([r["f"] for r in named]))
    step = F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "line"} | STAMP)
    out = out.where(F.trim("value") != "").select(step.alias("s")).select("s.*")
    return out if sessions is None else out.where(F.col("session_id").isin(sessions))
