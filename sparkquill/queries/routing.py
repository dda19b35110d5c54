"""Routing, cost and suggestion rules over questions made of benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing as R
from ..registry import query, table
from .selection import QUESTIONS, stemmed

SIZES = [5_000, 50_000, 100_000, 600_000]
MODELS = ["gpt-5-mini", "gpt-4o", "gpt-4o-mini-2024", "claude-haiku", "unknown", "GPT-5-nano"]


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """qid, query, size, model."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("qid") % len(xs) + 1).cast("int"))
    return stemmed(spark, sf).withColumn("size", pick(SIZES)).withColumn("model", pick(MODELS))


def _like(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _regex(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, '" + "|".join(f"(?:{p})" for p in patterns) + "')"


_ASKED = f"""{QUESTIONS}, a AS (SELECT qid, query, lower(query) AS q, CAST([{", ".join(map(str, SIZES))}][qid % 4 + 1] AS BIGINT) AS size, [{", ".join(f"'{m}'" for m in MODELS)}][qid % 6 + 1] AS model FROM qs),
b AS (SELECT *, {_like("q", R.MULTI_HOP)} AS multi, {_regex("q", R.COMPARISON)} AS cmp, {_regex("q", R.AGGREGATION)} AS agg, {_like("q", R.QUADRATIC)} AS quad, {_like("q", R.SIMPLE)} AS simple,
    {_like("q", R.EXTENSIVE)} AS ext, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) AS nw FROM a),
c AS (SELECT *, CASE WHEN quad OR agg THEN 'quadratic' WHEN multi OR cmp THEN 'multi_hop' WHEN simple AND nw < 15 THEN 'simple' ELSE 'single_hop' END AS complexity,
    CAST(CASE WHEN (quad OR agg) AND multi THEN 0.85 WHEN quad OR agg THEN 0.75 WHEN multi OR cmp THEN 0.80 WHEN simple AND nw < 15 THEN 0.70 ELSE 0.60 END AS DOUBLE) AS confidence FROM b),
d AS (SELECT *, CASE WHEN ext OR complexity = 'quadratic' THEN 'extensive' WHEN complexity = 'simple' THEN 'minimal' ELSE 'moderate' END AS context_needs FROM c),
e AS (SELECT *, CAST(least(6, CASE complexity WHEN 'simple' THEN 1 WHEN 'single_hop' THEN 2 WHEN 'multi_hop' THEN 3 ELSE 4 END + CAST(cmp AS INT) + CAST(agg AS INT)) AS INTEGER) AS reasoning_depth,
    CAST(floor(CASE complexity WHEN 'simple' THEN 1 WHEN 'single_hop' THEN 3 WHEN 'multi_hop' THEN 10 ELSE 50 END * CASE context_needs WHEN 'minimal' THEN 0.5 WHEN 'moderate' THEN 1.0 ELSE 3.0 END) AS INTEGER) AS chunk_access FROM d),
s AS (SELECT *, CASE WHEN size < 10000 AND complexity = 'simple' THEN 'direct_llm' WHEN complexity = 'single_hop' AND size < 500000 THEN 'rag' WHEN complexity IN ('multi_hop', 'quadratic') AND size > 500000 THEN 'hybrid'
    WHEN complexity IN ('multi_hop', 'quadratic') THEN 'rlm' ELSE 'hybrid' END AS strategy,
    CAST(CASE WHEN size < 10000 AND complexity = 'simple' THEN 0.90 WHEN complexity = 'single_hop' AND size < 500000 THEN 0.85 WHEN complexity IN ('multi_hop', 'quadratic') AND size > 500000 THEN 0.88
    WHEN complexity IN ('multi_hop', 'quadratic') THEN 0.82 ELSE 0.75 END AS DOUBLE) AS sure FROM e)"""
_PRICES = ", ".join(f"({i}, '{m}', {a}::DOUBLE, {b}::DOUBLE)" for i, (m, (a, b)) in enumerate(R.PRICES.items()))
_PRICED = f"""pr(i, name, pin, pout) AS (VALUES {_PRICES}),
m AS (SELECT qid, coalesce(arg_min(pin, CASE WHEN lower(model) = name THEN -1 ELSE i END), 0.001::DOUBLE) AS pin, coalesce(arg_min(pout, CASE WHEN lower(model) = name THEN -1 ELSE i END), 0.003::DOUBLE) AS pout
    FROM a LEFT JOIN pr ON contains(lower(model), name) GROUP BY qid)"""
_OUT = "CASE " + " ".join(f"WHEN {_like('q', ws)} THEN {n}" for ws, n in R.OUTPUT_TOKENS) + " ELSE 1000 END"


@query(f"WITH {_ASKED} SELECT qid, complexity, confidence, context_needs, reasoning_depth, chunk_access, multi AS multi_hop, cmp AS comparison, agg AS aggregation FROM e")
def analyze_questions(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", *[c.alias(k) for k, c in R.analysis(F.col("query")).items()])


@query(f"WITH {_ASKED} SELECT qid, strategy, sure AS confidence, CAST(CASE strategy WHEN 'direct_llm' THEN 1 WHEN 'rag' THEN 5 WHEN 'hybrid' THEN 5 ELSE chunk_access END AS INTEGER) AS chunks FROM s")
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    a = R.analysis(F.col("query"))
    name, sure = R.strategy(a["complexity"], F.col("size"))
    return asked(spark, sf).select("qid", name.alias("strategy"), sure.alias("confidence"), R.estimated_chunks(name, a["chunk_access"]).alias("chunks"))


@query(f"WITH {_ASKED}, {_PRICED} SELECT qid, pin AS price_in, pout AS price_out FROM m")
def model_prices(spark: SparkSession, sf: str) -> DataFrame:
    i, o = R.price(F.col("model"))
    return asked(spark, sf).select("qid", i.alias("price_in"), o.alias("price_out"))


@query(
    f"""WITH {_ASKED}, {_PRICED}, o AS (SELECT a.qid, size, length(query) + 2 AS asked, CAST({_OUT} AS BIGINT) AS ot, CAST(least(size // 5000, 20) AS BIGINT) AS calls, pin, pout FROM a JOIN m USING (qid)),
x AS (SELECT qid, 'direct_llm' AS strategy, CAST((asked + size) // 4 AS BIGINT) AS tokens_in, ot AS tokens_out, pin, pout FROM o
UNION ALL SELECT qid, 'rag', CAST((asked + 25000) // 4 AS BIGINT), 500, pin, pout FROM o
UNION ALL SELECT qid, 'rlm', CAST((asked + least(size, 10000)) // 4 + calls * 502 AS BIGINT), ot + calls * 1000 + 1000, pin, pout FROM o
UNION ALL SELECT qid, 'hybrid', CAST((asked + least(size // 5, 10000)) // 4 + (calls // 2) * 502 AS BIGINT), ot + (calls // 2) * 1000 + 1000, pin, pout FROM o)
SELECT qid, strategy, tokens_in, tokens_out, round(tokens_in / 1000 * pin + tokens_out / 1000 * pout, 9) AS usd, round((tokens_in / 1000 * pin + tokens_out / 1000 * pout) * 1.1::DOUBLE, 9) AS usd_with_buffer FROM x"""
)
def compare_strategy_costs(spark: SparkSession, sf: str) -> DataFrame:
    rows = asked(spark, sf).select("qid", F.explode(R.strategy_costs(F.col("query"), F.col("size"), F.col("model"))).alias("c")).select("qid", "c.*")
    return rows.withColumn("usd_with_buffer", F.round(R.with_buffer(F.col("usd")), 9)).withColumn("usd", F.round("usd", 9))


@query(f"WITH {_ASKED} SELECT qid, array_to_string(list_filter([CASE WHEN size > 500000 THEN 'chunking' END, CASE WHEN complexity = 'quadratic' THEN 'decomposition' END, CASE WHEN {_like('q', ['everything', 'all', 'entire'])} THEN 'keywords' END], lambda x: x IS NOT NULL), ',') AS kinds, (size > 500000 OR complexity = 'quadratic') AS rewrite FROM c")
def suggest_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    s = R.suggestions(F.col("query"), R.analysis(F.col("query"))["complexity"], F.col("size"))
    return asked(spark, sf).select("qid", F.array_join(F.transform(s, lambda x: x["kind"]), ",").alias("kinds"), F.exists(s, lambda x: x["confidence"] > 0.7).alias("rewrite"))


_TOPIC = "CASE " + " ".join(f"WHEN {_like('q', ws)} THEN '{t}'" for t, ws in R.TOPICS.items()) + " " + " ".join(f"WHEN {_like('c', ws)} THEN '{t}_ctx'" for t, ws in R.TOPICS.items()) + " ELSE 'mixed' END"


@query(f"WITH {_ASKED}, t AS (SELECT qid, substr(q, 10) AS q, lower(CASE WHEN qid % 2 = 0 THEN 'who knows' ELSE '' END) AS c FROM a) SELECT qid, {_TOPIC} AS topic FROM t")
def batch_topics(spark: SparkSession, sf: str) -> DataFrame:
    ctx = F.when(F.col("qid") % 2 == 0, "Who knows")
    return asked(spark, sf).select("qid", R.topic(F.substr("query", F.lit(10)), ctx).alias("topic"))


@query(f"WITH {_ASKED} SELECT qid, CASE WHEN contains(lower(model), 'gpt-5') OR contains(lower(model), 'gpt-4o') THEN 'o200k_base' ELSE 'cl100k_base' END AS encoding FROM a")
def tokenizer_names(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", R.encoding(F.col("model")).alias("encoding"))


@query(f"WITH {_ASKED} SELECT qid, upper(strategy) AS strategy_name, CASE strategy WHEN 'direct_llm' THEN 'Direct LLM - Simple Q&A with full context' WHEN 'rag' THEN 'RAG - Vector retrieval with semantic search' WHEN 'rlm' THEN 'RLM - Recursive analysis with sub-LLM calls' ELSE 'Hybrid - RAG pre-filter + RLM deep analysis' END AS description, CAST(floor(round(sure * 100, 6)) AS INTEGER) AS confidence_percent FROM s")
def routing_visibility(spark: SparkSession, sf: str) -> DataFrame:
    name, sure = R.strategy(R.analysis(F.col("query"))["complexity"], F.col("size"))
    described = F.create_map(*[x for k, v in R.DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))])
    return asked(spark, sf).select("qid", F.upper(name).alias("strategy_name"), F.element_at(described, name).alias("description"), F.floor(F.round(sure * 100, 6)).cast("int").alias("confidence_percent"))


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS context_size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def context_size(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").agg(F.sum(F.length("text")).alias("context_size"))
