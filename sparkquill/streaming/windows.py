"""Event-time operators: the same functions serve batch tables and streams (give streams a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(df: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Event time as TIMESTAMP; with `late`, a watermark that drops what comes later than that."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def tumbling(df: DataFrame, size: str, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, size: str, slide: str, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, size, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, gap: str, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def deduplicated(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Streams: the first event of a key within the watermark; batch: the first event of a key."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(keys)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(ts))).where("__r = 1").drop("__r")


def assembled(chunks: DataFrame, gap_s: int = 30) -> DataFrame:
    """Responses put together from streamed chunks (stream, call, seq, ts, chunk, done, error). A gap without a chunk of
    any call of the stream ends all of its calls."""
    w = Window.partitionBy("stream").orderBy("ts", "seq")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > gap_s * 1_000_000
    part = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    out = chunks.withColumn("part", part).groupBy("stream", "part", "call").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "").alias("response"), F.count("*").alias("chunks"), F.bool_or("done").alias("done"), F.count("error").alias("errors"))
    return out.withColumn("outcome", F.when(F.col("errors") > 0, "error").when(F.col("done"), "complete").otherwise("timeout")).drop("done", "errors")


def file_stream(spark: SparkSession, folder: str, file: str, late: str | None = None) -> DataFrame:
    """A stream of the Parquet files of that name in a folder."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return events(spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder), late=late)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is, into Parquet; the checkpoint lets it go on from there."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
