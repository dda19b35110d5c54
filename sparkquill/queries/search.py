"""Search over documents (keywords) and embeddings (vectors; vec_id stands for doc_id). Questions: benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..operators import search as S
from ..registry import query, table


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """qid, query (each item's whole text), vector (of the same number; null if there is none)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return b.join(vectors(spark, sf).select(F.col("doc_id").alias("qid"), "vector"), "qid", "left")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


_TOK = r"list_filter(list_transform(regexp_split_to_array(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: length(x) > 2)"
BASE = f"""p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS term FROM documents) GROUP BY 1, 2),
d AS (SELECT doc_id, len({_TOK.format("text")}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM p JOIN q USING (term) JOIN f USING (term) JOIN d USING (doc_id), st GROUP BY 1, 2),
v AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b)"""
TOP = "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {0}) WHERE rank <= {1}"
FUSED = """kw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20),
se AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v QUALIFY rank <= 20),
fu AS (SELECT qid, doc_id, sum(part) AS fused_score FROM (SELECT qid, doc_id, 0.7 / (60 + rank) AS part FROM se UNION ALL SELECT qid, doc_id, 0.3 / (60 + rank) FROM kw) GROUP BY 1, 2)"""


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {BASE} {TOP.format('bm', 10)}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.bm25_top_k(table(spark, sf, "documents"), questions(spark, sf), 10), "score")


@query(f"WITH {BASE}, r AS (SELECT * FROM bm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) {TOP.format('r', 10)}")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    only = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return _round(S.bm25_top_k(table(spark, sf, "documents"), questions(spark, sf), 10, only=only), "score")


@query(f"WITH {BASE}, c AS (SELECT term FROM p GROUP BY term) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM d) AS chunks, (SELECT round(avg(dl), 6) FROM d) AS average_length, (SELECT count(*) FROM c) AS terms")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return _round(S.index_stats(d, d.withColumn("chunk_id", F.col("doc_id"))), "average_length")


@query(f"WITH {BASE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY term")
def document_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return S.postings(table(spark, sf, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {BASE} {TOP.format('v', 10)}")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.cosine_top_k(vectors(spark, sf), questions(spark, sf), 10), "score")


@query(f"WITH {BASE}, r AS (SELECT v.* FROM v JOIN embeddings e ON e.vec_id = doc_id WHERE label IN (1, 2) AND score >= 0.2) {TOP.format('r', 5)}")
def vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "embeddings").where("label in (1, 2)").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return _round(S.cosine_top_k(some, questions(spark, sf), 5, threshold=0.2), "score")


@query(f"WITH {BASE}, {FUSED} SELECT qid, doc_id, round(fused_score, 9) AS fused_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(fused_score, 9) DESC, doc_id) AS INTEGER) AS rrf_rank FROM fu QUALIFY rrf_rank <= 10")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.hybrid(table(spark, sf, "documents"), vectors(spark, sf), questions(spark, sf)).withColumn("fused_score", F.round("fused_score", 9))


@query(
    f"WITH {BASE}, {FUSED}, a AS (SELECT 'vector' AS source, qid, doc_id, score, 1.0 AS weight FROM se UNION ALL SELECT 'keyword', qid, doc_id, score, 0.8 FROM kw)"
    " SELECT doc_id, round(sum(score * weight), 6) AS aggregated_score, round(max(score), 6) AS best_score, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, CAST(count(DISTINCT source) AS INTEGER) AS source_count FROM a GROUP BY doc_id HAVING count(DISTINCT source) >= 2"
)
def aggregate_sources(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    se = S.cosine_top_k(vectors(spark, sf), q, 20).select(F.lit("vector").alias("source"), "doc_id", "score", F.lit(1.0).alias("weight"))
    kw = S.bm25_top_k(table(spark, sf, "documents"), q, 20).select(F.lit("keyword").alias("source"), "doc_id", "score", F.lit(0.8).alias("weight"))
    out = S.aggregate_sources(se.union(kw), 2, "doc_id")
    return _round(out.withColumn("sources", F.array_join("sources", ",")), "aggregated_score", "best_score")


def retrieved(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """qid, query, doc_id, content (the whole text), score, rank of the keyword search."""
    q, d = questions(spark, sf), table(spark, sf, "documents")
    return S.with_texts(S.bm25_top_k(d, q, k), d, q.select("qid", "query"), k)


RETRIEVED = f"""{BASE}, top AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20),
re AS (SELECT t.qid, b.text AS query, t.doc_id, d.text AS content, score, rank FROM top t JOIN benchmark b ON b.item_id = t.qid JOIN documents d ON d.doc_id = t.doc_id)"""


@query(
    f"""WITH {RETRIEVED}, w AS (SELECT *, list_distinct({_TOK.format("query")}) AS qw, {_TOK.format("content")} AS cw FROM re),
m AS (SELECT *, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw)) / len(qw) ELSE 0.0 END AS s FROM w)
SELECT qid, doc_id, round(s, 6) AS model_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank, doc_id) AS INTEGER) AS rerank FROM m QUALIFY rerank <= 10"""
)
def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.rerank(retrieved(spark, sf)).select("qid", "doc_id", "model_score", "rerank"), "model_score")


@query(
    f"""WITH {RETRIEVED}, w AS (SELECT *, list_distinct({_TOK.format("query")}) AS qw, {_TOK.format("content")} AS cw, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) AS qs, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) AS cs FROM re),
a AS (SELECT *, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw)) / len(qw) ELSE 0.0 END AS lexical FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lexical, 9) DESC, rank, doc_id) AS p FROM a QUALIFY p <= 12),
c AS (SELECT *, CASE WHEN len(qs) > 0 AND len(cs) > 0 THEN len(list_intersect(qs, cs)) / len(list_distinct(list_concat(qs, cs))) ELSE 0.0 END AS alike FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(alike, 9) DESC, p, doc_id) AS p2 FROM c QUALIFY p2 <= 7)
SELECT qid, doc_id, round(lexical, 6) AS lexical, round(alike, 6) AS alike, round(lexical, 6) AS model, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(lexical, 9) DESC, p2, doc_id) AS INTEGER) AS rerank FROM e QUALIFY rerank <= 4"""
)
def rerank_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Shared words, then likeness, then a model that can't be had, for which shared words stand in."""

    def missing(query, content):
        raise RuntimeError("no such model")

    stages = [S.Stage("lexical", S.lexical_relevance, 12), S.Stage("alike", jaccard, 7), S.Stage("model", missing, 4)]
    return _round(S.rerank_in_stages(retrieved(spark, sf), stages).select("qid", "doc_id", "lexical", "alike", "model", "rerank"), "lexical", "alike", "model")
