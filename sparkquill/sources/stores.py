"""Document, chunk and vector tables: save, look up, update, delete -- as rewrites of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key isn't among the ids (deletion)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def with_status(df: DataFrame, ids: DataFrame, status: str, error: str | None = None, key: str = "doc_id") -> DataFrame:
    marked = df.join(ids.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    hit = F.col("__hit").isNotNull()
    return marked.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("error_message", F.when(hit, F.lit(error)).otherwise(F.col("error_message"))).drop("__hit")


def listed(df: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0, key: str = "doc_id") -> DataFrame:
    return (df.where(F.col("status") == status) if status else df).orderBy(key).offset(offset).limit(limit)


def chunk_key(doc: str = "doc_id", index: str = "chunk_index"):
    return F.concat(F.col(doc).cast("string"), F.lit("_chunk_"), F.col(index).cast("string"))


def vector_stats(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.agg(F.count("*").alias("points"), F.max(F.size(vector)).alias("dimensions"), F.lit("cosine").alias("metric"))
