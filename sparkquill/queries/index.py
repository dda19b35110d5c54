"""The stored keyword index over documents: built by appends, a replacement and a removal, then searched.

Questions are whole benchmark texts: ranked, as all their words, as a phrase, as any of their sentences, as prefixes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import KeywordIndex, full_words
from ..operators.search import top_k
from ..registry import query, table
from ..sources.shared import shared_dir
from .search import _TOK


def _new(spark: SparkSession, **options) -> KeywordIndex:
    return KeywordIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}", buckets=16, splits=2, **options)


def _chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("document"), F.col("doc_id").alias("chunk"), "text")


def changed_index(spark: SparkSession, sf: str) -> KeywordIndex:
    """English documents, then the others, then new versions of those of low quality; toxic ones are removed."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    low = d.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" revised edition")))
    index = _new(spark).append(_chunks(d.where(english))).append(_chunks(d.where(~english))).append(_chunks(low))
    return index.remove(labels.where("toxic = 1").select(F.col("doc_id").alias("document")))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


_CHANGED = f"""x AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN text || ' revised edition' ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS term FROM x) GROUP BY 1, 2),
d AS (SELECT doc_id, len({_TOK.format("text")}) AS dl FROM x),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN q USING (term) JOIN f USING (term) JOIN d USING (doc_id), st GROUP BY 1, 2)"""
_RANKED = f"WITH {_CHANGED} SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10"


def _ranked(index: KeywordIndex, questions: DataFrame) -> DataFrame:
    found = index.search(questions, k=10).select("qid", F.col("document").alias("doc_id"), "score")
    return top_k(found, 10).withColumn("score", F.round("score", 6))


@query(_RANKED)
def stored_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(changed_index(spark, sf), _questions(spark, sf))


@query(_RANKED)
def merged_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same after all segments were merged into one."""
    return _ranked(changed_index(spark, sf).merge(), _questions(spark, sf))


@query(f"WITH {_CHANGED} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, round(avg(dl), 6) AS average_length, (SELECT count(DISTINCT term) FROM p) AS terms FROM d")
def stored_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return changed_index(spark, sf).stats().withColumn("average_length", F.round("average_length", 6))


@query(f"WITH {_CHANGED} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY term")
def stored_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    return changed_index(spark, sf).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


# ---------------------------------------------------------------------------------- full-text syntax

_FULL = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_WORDS = f"""d AS (SELECT doc_id, {_FULL.format("text")} AS w FROM documents),
b AS (SELECT item_id AS qid, text, {_FULL.format("text")} AS w FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_SCORES = """s AS (SELECT qid, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))) AS score
    FROM (SELECT DISTINCT qid, term FROM t) JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id), st GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 6) AS score FROM m JOIN s USING (qid, doc_id)"""
_ALL = "t AS (SELECT qid, unnest(w) AS term FROM b)"


def _matched(spark: SparkSession, sf: str, wanted) -> DataFrame:
    """wanted: the question in the index's syntax, of the column query."""
    index = _new(spark, tokens=full_words).append(_chunks(table(spark, sf, "documents")))
    found = index.match(_questions(spark, sf).withColumn("query", wanted))
    return found.select("qid", F.col("document").alias("doc_id"), F.round("score", 6).alias("score"))


def _said():
    """The question's words, one space between."""
    return F.array_join(full_words(F.col("query")), " ")


@query(f"WITH {_WORDS}, {_ALL}, m AS (SELECT qid, doc_id FROM b JOIN d ON len(b.w) > 0 AND list_has_all(d.w, b.w)), {_SCORES}")
def match_all_words(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf, _said())


@query(f"WITH {_WORDS}, {_ALL}, m AS (SELECT qid, doc_id FROM b JOIN d ON len(b.w) > 0 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')), {_SCORES}")
def match_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf, F.concat(F.lit('"'), _said(), F.lit('"')))


@query(
    f"""WITH {_WORDS}, e AS (SELECT qid, {_FULL.format("sentence")} AS w FROM (SELECT qid, unnest(regexp_split_to_array(text, '[.!?]')) AS sentence FROM b)),
t AS (SELECT qid, unnest(w) AS term FROM e), m AS (SELECT DISTINCT qid, doc_id FROM e JOIN d ON len(e.w) > 0 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' ')), {_SCORES}"""
)
def match_any_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """Each sentence of the question is a phrase; one of them is enough."""
    phrases = F.transform(F.split("query", "[.!?]"), lambda s: F.concat(F.lit('"'), F.array_join(full_words(s), " "), F.lit('"')))
    return _matched(spark, sf, F.array_join(phrases, " OR "))


@query(
    f"""WITH {_WORDS}, h AS (SELECT DISTINCT qid, unnest(w) AS head FROM b), t AS (SELECT qid, head, term FROM h JOIN f ON starts_with(term, head)),
c AS (SELECT qid, count(*) AS heads FROM h GROUP BY 1), m AS (SELECT qid, doc_id FROM t JOIN p USING (term) JOIN c USING (qid) GROUP BY qid, doc_id, heads HAVING count(DISTINCT head) = heads), {_SCORES}"""
)
def match_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the question begins a word of the document."""
    return _matched(spark, sf, F.array_join(F.transform(full_words(F.col("query")), lambda w: F.concat(w, F.lit("*"))), " "))
