"""Ingestion as one lazy plan: files -> detected -> read -> cleaned -> described -> chunked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import chunking, text
from ..sources import detect, readers

#: Stages of a document and what share of the work is done after each.
STAGES = {"validate": 5, "store": 10, "parse": 30, "clean": 50, "metadata": 70, "chunk": 85, "embed": 90, "save": 95}


def documents(files: DataFrame, boilerplate: bool = False, prefer_extension: bool = True) -> DataFrame:
    """(doc_id, path, format, status, error_message, raw_text, cleaned_text, title, language, counts) of files.

    A file that is refused or can't be read is failed with its reason; the others go on.
    """
    refused = detect.upload_reason(F.col("path"), F.col("length"))
    checked = detect.detect(files.withColumn("refused", refused), prefer_extension)
    good = readers.read(checked.where("refused is null"))
    bad = checked.where("refused is not null").select("path", "format", F.lit(None).cast("string").alias("text"), F.col("refused").alias("error"))
    rows = good.unionByName(bad).withColumn("cleaned_text", text.clean(F.col("text"), boilerplate))
    c = F.col("cleaned_text")
    return rows.select(
        F.sha2("path", 256).alias("doc_id"),
        "path",
        text.file_name(F.regexp_extract("path", r"([^/\\]*)$", 1)).alias("file_name"),
        "format",
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"),
        F.col("error").alias("error_message"),
        F.col("text").alias("raw_text"),
        "cleaned_text",
        text.title(c).alias("title"),
        text.language(c).alias("language"),
        F.length(c).cast("long").alias("char_count"),
        text.word_count(c).cast("long").alias("word_count"),
    )


def chunks(docs: DataFrame, size: int = SETTINGS.chunking.size, overlap: int = SETTINGS.chunking.overlap) -> DataFrame:
    """One row a chunk of every completed document, with a stable key."""
    out = chunking.exploded(docs.where("status = 'completed'"), chunking.chunk(F.col("cleaned_text"), size, overlap), "doc_id")
    return out.withColumn("chunk_id", F.concat("doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")))


def batch_result(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


def progress(log: DataFrame) -> DataFrame:
    """log: doc_id, stage, ts -> the latest stage, its percent and the stages so far."""
    percent = F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))])
    out = log.groupBy("doc_id").agg(F.max_by("stage", "ts").alias("stage"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "stage"))), lambda x: x["stage"]).alias("stages"))
    return out.withColumn("percent", F.coalesce(F.try_element_at(percent, F.col("stage")), F.lit(100)))
