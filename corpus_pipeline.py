"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import decontaminate, jaccard, mixing, pii, toxicity
from sparkquill.llm.common import drop, save
from sparkquill.llm.queries import remainder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from the same labelled rows as the operator's query."""
    train = ~F.coalesce(remainder(5) == 0, F.lit(False))
    return toxicity.reject(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), train)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows."""
    return pii.redact(docs, chars_col="n_chars").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    return mixing.mix(docs)


STAGES = [("toxicity", non_toxic), ("near_duplicates", unique), ("decontamination", decontaminated), ("personal_data", redacted), ("mixing", mixed)]

#: The trained stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # the next stage's table is written
            drop(before)
        before = docs
    return docs
