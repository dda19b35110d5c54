"""Live notices: events become messages, delivered once a batch to a table that subscribers follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The events that have a message type of their own, which is their name.
MESSAGE_TYPES = ["step_start", "code_generated", "code_output", "sub_llm_spawn", "sub_llm_result", "final_result", "error"]


def message_type(kind: Column) -> Column:
    return F.when(F.lower(kind).isin(MESSAGE_TYPES), F.lower(kind)).otherwise("unknown")


def messages(events: DataFrame) -> DataFrame:
    """session_id, type, timestamp, message (JSON). events: session_id, kind, ts, data (map of strings)."""
    out = events.select("session_id", message_type(F.col("kind")).alias("type"), F.col("ts").alias("timestamp"), "data")
    return out.select("session_id", "type", "timestamp", F.to_json(F.struct("type", "timestamp", "session_id", "data")).alias("message"))


def deliver(stream: DataFrame, out: str, checkpoint: str, subscribed: DataFrame | None = None, per_trigger: dict | None = None) -> None:
    """Runs the stream over what there is. A batch is a folder of its own, written anew if the batch is run again, so a
    restart gives no message twice. With `subscribed` (session_id), only those sessions' messages."""

    def write(batch: DataFrame, number: int) -> None:
        rows = messages(batch)
        if subscribed is not None:
            rows = rows.join(subscribed.select("session_id").distinct(), "session_id", "left_semi")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)
