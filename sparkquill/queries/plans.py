"""Whole plans: ingestion, answering with the default model, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators import sessions as S
from ..plans import answer, exports, ingest, models
from ..registry import query, table
from .formats import named
from .search import questions as vector_questions
from .search import vectors
from .selection import QUESTIONS, stemmed
from .sessions import M, messages


@query()
def ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of many formats, some refused and some broken, through ingestion."""
    files = named(spark, sf).withColumn("length", F.length("content"))
    return ingest.documents(files).groupBy("format", "status").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


@query()
def ingest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    files = named(spark, sf).withColumn("length", F.length("content"))
    return ingest.chunks(ingest.documents(files), 40, 5).select("doc_id", "chunk_index", "chunk_id", "tokens")


@query("WITH l AS (SELECT user_id AS doc_id, ['validate', 'store', 'parse', 'clean', 'metadata', 'chunk', 'embed', 'save'][event_id % 8 + 1] AS stage, event_id AS ts FROM events), p AS (SELECT doc_id, arg_max(stage, ts) AS stage, string_agg(stage, ',' ORDER BY ts) AS stages FROM l GROUP BY 1) SELECT *, CASE stage WHEN 'validate' THEN 5 WHEN 'store' THEN 10 WHEN 'parse' THEN 30 WHEN 'clean' THEN 50 WHEN 'metadata' THEN 70 WHEN 'chunk' THEN 85 WHEN 'embed' THEN 90 ELSE 95 END AS percent FROM p")
def ingest_progress(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, ingest.STAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    log = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), stage.alias("stage"), F.col("event_id").alias("ts"))
    return ingest.progress(log).withColumn("stages", F.array_join("stages", ","))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 7 <> 0) AS succeeded, count(*) FILTER (WHERE doc_id % 7 = 0) AS failed FROM documents")
def batch_result(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.batch_result(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("completed").alias("status")))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """qid, query, vector, doc_ids, context_size: the stemmed questions, each over what a hybrid search of all documents finds."""
    v = vectors(spark, sf).select(F.col("doc_id").alias("qid"), "vector")
    size = F.element_at(F.array(*map(F.lit, (5_000, 600_000, 50_000))), (F.col("qid") % 3 + 1).cast("int"))
    q = stemmed(spark, sf).join(v, "qid", "left")
    ids = search.hybrid(table(spark, sf, "documents"), vectors(spark, sf), q, 20).groupBy("qid").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return q.join(ids, "qid", "left").withColumn("context_size", size)


@query()
def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each question by the strategy its rules choose, with the default model."""
    return answer.answers(asked(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), vectors(spark, sf))


@query()
def advanced_context(spark: SparkSession, sf: str) -> DataFrame:
    return answer.advanced(vector_questions(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), vectors(spark, sf))


@query(f"WITH {QUESTIONS} SELECT qid, '[model reply to ' || length(query) || ' characters: ' || left(regexp_replace(regexp_replace(query, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 80) || ']' AS reply, true AS ok, 1 AS attempts, false AS used_fallback FROM qs")
def ask_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.ask(stemmed(spark, sf), F.col("query")).select("qid", "reply", "ok", "attempts", "used_fallback")


@query()
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", models.embed(F.col("text"), 32).alias("e")).select("doc_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query(f"WITH {M} SELECT session_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY created_at, id) AS text FROM m GROUP BY 1")
def export_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    return exports.plain_text(messages(spark, sf))


@query(f"WITH {M}, t AS (SELECT session_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY created_at, id) AS t FROM m GROUP BY 1) SELECT session_id, '<!doctype html><html><head><meta charset=\"utf-8\"><title>' || session_id || '</title></head><body><pre>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></body></html>' AS page FROM t")
def export_html(spark: SparkSession, sf: str) -> DataFrame:
    t = exports.plain_text(messages(spark, sf))
    return t.select("session_id", exports.html_page(F.col("session_id").cast("string"), F.col("text")).alias("page"))


@query()
def export_usage_json(spark: SparkSession, sf: str) -> DataFrame:
    return exports.json_rows(S.token_usage(messages(spark, sf), 1000))
