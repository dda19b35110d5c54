"""Selection and citation of retrieved chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection as X
from ..operators.routing import complexity_score
from ..registry import query, table
from .search import RETRIEVED, retrieved


@query(f"WITH {RETRIEVED}, m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM re) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) AS INTEGER) AS selected FROM m WHERE score >= 0.5 * best QUALIFY selected <= 8")
def select_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return X.by_threshold(retrieved(spark, sf), 0.5, 8, relative=True).select("qid", "doc_id", "selected")


@query(
    f"""WITH {RETRIEVED}, b AS (SELECT *, sum(score) OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM re),
ff AS (SELECT *, max(CASE WHEN before > 0 AND score / before < 0.08 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS failed, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS selected FROM b)
SELECT qid, doc_id, CAST(selected AS INTEGER) AS selected FROM ff WHERE failed = 0 AND selected <= 15"""
)
def select_progressively(spark: SparkSession, sf: str) -> DataFrame:
    return X.progressively(retrieved(spark, sf), 15, 0.08).select("qid", "doc_id", "selected")


_WORDS = r"len(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> ''))"
_KW = " + ".join(f"CASE WHEN contains(lower(query), '{w}') THEN 0.05 ELSE 0.0 END" for w in ["compare", "contrast", "difference", "similarities", "analyze", "evaluate", "assess", "relationship", "cause", "effect", "impact", "influence", "trend", "pattern", "correlation", "summary"])
_ST = " + ".join(f"CASE WHEN starts_with(lower(query), '{w}') THEN 0.05 ELSE 0.0 END" for w in ["how", "why", "explain", "what are the", "describe"])
_ADAPTIVE = rf"""WITH RECURSIVE {RETRIEVED},
it AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS i, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '')) AS ws FROM re),
sm AS (SELECT a.qid, a.i, list(CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0 THEN len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) ELSE 0.0 END ORDER BY b.i) AS sims FROM it a JOIN it b USING (qid) GROUP BY 1, 2),
ta AS (SELECT qid, count(*) AS n, CAST(greatest(3, least(floor(count(*) * (0.3 + 0.4 * round(CAST(least(1.0, greatest(0.0, 0.5 + CASE WHEN any_value({_WORDS}) > 20 THEN 0.2 WHEN any_value({_WORDS}) > 10 THEN 0.1 WHEN any_value({_WORDS}) < 5 THEN -0.1 ELSE 0.0 END + any_value({_KW} + {_ST}))) AS DOUBLE), 9))), 10, count(*))) AS INTEGER) AS target FROM re GROUP BY 1),
kp AS (SELECT qid, 0 AS i, CAST([] AS BIGINT[]) AS kept FROM ta
UNION ALL SELECT kp.qid, kp.i + 1, CASE WHEN len(list_filter(kept, lambda k: sims[k] > 0.85)) > 0 THEN kept ELSE list_append(kept, kp.i + 1) END FROM kp JOIN sm ON sm.qid = kp.qid AND sm.i = kp.i + 1),
kk AS (SELECT kp.qid, kept, target FROM kp JOIN ta ON ta.qid = kp.qid AND kp.i = n),
ch AS (SELECT qid, kept, target, 0 AS p, CAST([] AS BIGINT[]) AS chosen FROM kk
UNION ALL SELECT ch.qid, kept, target, p + 1, CASE WHEN len(chosen) >= target OR len(list_filter(chosen, lambda k: sims[k] > 0.8)) > 0 THEN chosen ELSE list_append(chosen, kept[p + 1]) END FROM ch JOIN sm ON sm.qid = ch.qid AND sm.i = kept[p + 1] WHERE p < len(kept)),
fi AS (SELECT qid, target, list_concat(chosen, list_filter(kept, lambda k: NOT list_contains(chosen, k))[1:greatest(0, 3 - len(chosen))]) AS final FROM ch WHERE p = len(kept))
SELECT f.qid, target, CAST(s - 1 AS INTEGER) AS selected, doc_id, round(round(score, 9), 6) AS score FROM (SELECT qid, target, unnest(final) AS i, generate_subscripts(final, 1) AS s FROM fi) f JOIN it ON it.qid = f.qid AND it.i = f.i"""


@query(_ADAPTIVE)
def select_adaptively(spark: SparkSession, sf: str) -> DataFrame:
    return X.adaptively(retrieved(spark, sf)).withColumn("score", F.round("score", 6))


STEMS = ["What is ", "Compare and contrast the trend of ", "Summarize all of ", "How does the impact of ", "Why ", "List ", "Describe everything in the entire "]
QUESTIONS = "qs AS (SELECT item_id AS qid, [{0}][item_id % 7 + 1] || substr(text, 1, 20 + (item_id * 13) % 80) AS query FROM benchmark)".format(", ".join(f"'{s}'" for s in STEMS))


def stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """qid, query: benchmark texts behind stems that make every class of question occur."""
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.col("item_id") % 7 + 1).cast("int"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat(stem, F.substr("text", F.lit(1), (20 + (F.col("item_id") * 13) % 80).cast("int"))).alias("query"))


@query(f"WITH {QUESTIONS} SELECT qid, round(CAST(least(1.0, greatest(0.0, 0.5 + CASE WHEN {_WORDS} > 20 THEN 0.2 WHEN {_WORDS} > 10 THEN 0.1 WHEN {_WORDS} < 5 THEN -0.1 ELSE 0.0 END + {_KW} + {_ST})) AS DOUBLE), 6) AS complexity FROM qs")
def complexity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stemmed(spark, sf).select("qid", F.round(complexity_score(F.col("query")), 6).alias("complexity"))


@query(f"WITH {RETRIEVED}, ff AS (SELECT qid, doc_id, min(rank) AS first FROM re GROUP BY 1, 2) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY first, doc_id) AS INTEGER) AS citation_number, 'cite_' || row_number() OVER (PARTITION BY qid ORDER BY first, doc_id) AS citation_id FROM ff")
def number_citations(spark: SparkSession, sf: str) -> DataFrame:
    return X.citations(retrieved(spark, sf))


@query(f"WITH {RETRIEVED} SELECT qid, count(*) AS total, count(DISTINCT doc_id) AS documents, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score FROM re GROUP BY qid")
def citation_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = X.citation_stats(retrieved(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_score", "max_score", "min_score")})


@query(f"WITH {RETRIEVED} SELECT qid, string_agg(printf('[C%d] [Document: %s, Score: %.3f]', rank, CAST(doc_id AS VARCHAR), score) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM re GROUP BY qid")
def build_context(spark: SparkSession, sf: str) -> DataFrame:
    return X.context(retrieved(spark, sf))


@query(f"WITH {RETRIEVED} SELECT qid, string_agg(printf('[%d] %s (%.2f): %s', rank, CAST(doc_id AS VARCHAR), score, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END), chr(10) ORDER BY rank) AS citations FROM re WHERE rank <= 5 GROUP BY qid")
def format_citations(spark: SparkSession, sf: str) -> DataFrame:
    return X.formatted(retrieved(spark, sf).where("rank <= 5").withColumn("citation_number", F.col("rank")))


@query(
    rf"""WITH {RETRIEVED}, a AS (SELECT item_id AS qid, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM benchmark)),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '\s+'), lambda x: x <> '')) AS sw FROM a),
c AS (SELECT qid, rank AS n, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS cw FROM re),
o AS (SELECT w.qid, pos, sentence, n, len(list_intersect(sw, cw)) / len(sw) AS o FROM w LEFT JOIN c ON c.qid = w.qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY CASE WHEN o > 0.3 THEN o END DESC NULLS LAST, n) AS r FROM o)
SELECT qid, CAST(pos AS INTEGER) AS pos, sentence, CAST(CASE WHEN o > 0.3 THEN n END AS INTEGER) AS citation_number FROM r WHERE r = 1"""
)
def cite_sentences(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return X.cite_sentences(answers, retrieved(spark, sf).withColumn("citation_number", F.col("rank")))


@query("SELECT event_id, array_to_string(list_sort(list_filter([CAST(user_id % 9 AS INTEGER), CAST(event_id % 5 AS INTEGER)], lambda x: x NOT IN (1, 2, 3))[1:(CASE WHEN user_id % 9 = event_id % 5 THEN 1 ELSE 2 END)]), ',') AS invalid FROM events")
def invalid_citations(spark: SparkSession, sf: str) -> DataFrame:
    t = F.format_string("so [%d] and [%d]", F.col("user_id") % 9, F.col("event_id") % 5)
    return table(spark, sf, "events").select("event_id", F.array_join(X.invalid_citations(t, F.array(*map(F.lit, (1, 2, 3)))).cast("array<string>"), ",").alias("invalid"))


_SENTENCES = rf"""WITH {RETRIEVED}, a AS (SELECT item_id AS qid, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM benchmark)),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '\s+'), lambda x: x <> '')) AS sw FROM a),
c AS (SELECT qid, rank AS n, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS cw FROM re),
o AS (SELECT w.qid, pos, sentence, n, len(list_intersect(sw, cw)) / len(sw) AS o FROM w LEFT JOIN c ON c.qid = w.qid),"""


@query(_SENTENCES + """r AS (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY CASE WHEN o > 0.6 THEN o END DESC NULLS LAST, n) AS r FROM o),
g AS (SELECT qid, string_agg(sentence || CASE WHEN o > 0.6 THEN ' [' || n || ']' ELSE '' END, ' ' ORDER BY pos) AS answer FROM r WHERE r = 1 GROUP BY 1)
SELECT item_id AS qid, coalesce(answer, '') AS answer FROM benchmark LEFT JOIN g ON qid = item_id""")
def inline_citations(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return X.with_citations(answers, retrieved(spark, sf).withColumn("citation_number", F.col("rank")))


@query(
    f"""WITH {RETRIEVED}, l AS (SELECT qid, CAST(doc_id % 10 AS VARCHAR) AS document, rank, '  [' || rank || '] Score: ' || printf('%.3f', score) || ': ' || CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS line FROM re),
by_document AS (SELECT qid, document, chr(10) || 'Document: ' || document || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS block FROM l GROUP BY 1, 2)
SELECT qid, 'Sources by Document:' || chr(10) || string_agg(block, chr(10) ORDER BY document) AS citations FROM by_document GROUP BY 1"""
)
def grouped_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose ids end alike count as chunks of one (previews of 100 characters are the feature)."""
    cited = retrieved(spark, sf).withColumn("citation_number", F.col("rank")).withColumn("doc_id", F.col("doc_id") % 10)
    return X.grouped_by_document(cited)


@query()
def select_by_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunk of each cluster of each question's results."""
    from ..operators.clusters import diverse

    return diverse(retrieved(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {RETRIEVED}, a AS (SELECT qid, count(*) AS n, avg(score) AS o, sum(score) AS t FROM re GROUP BY 1), b AS (SELECT qid, count(*) AS m, avg(score) AS s, sum(score) AS k FROM re WHERE rank <= 5 GROUP BY 1)
SELECT qid, round(m / n, 6) AS compression_ratio, round(o, 6) AS avg_score_original, round(s, 6) AS avg_score_selected, round(CASE WHEN t > 0 THEN k / t ELSE 0 END, 6) AS score_retention FROM a JOIN b USING (qid)"""
)
def selection_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = retrieved(spark, sf)
    out = X.selection_stats(r, r.where("rank <= 5"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns[1:]})


@query("SELECT qid, doc_id, n AS citations, CAST(p AS INTEGER) AS place FROM (SELECT user_id AS qid, event_id % 7 AS doc_id, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_id % 7) AS p FROM events WHERE round(value, 2) >= 10 AND event_type <> 'click' GROUP BY 1, 2) WHERE p <= 5")
def most_cited_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as citations: the documents that each user's cite most."""
    cited = table(spark, sf, "events").where("event_type <> 'click'").select(F.col("user_id").alias("qid"), (F.col("event_id") % 7).alias("doc_id"), F.round("value", 2).alias("score"))
    return X.top_documents(X.citations_where(cited, 10))


@query("SELECT event_id, event_type, round(value, 2) AS score FROM events WHERE event_type = 'view' AND user_id % 3 = 0 AND round(value, 2) >= 10")
def find_citations(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "events").select("event_id", "event_type", F.round("value", 2).alias("score"), (F.col("user_id") % 3).alias("session"))
    return X.citations_where(cited, 10, event_type="view", session=0).drop("session")
