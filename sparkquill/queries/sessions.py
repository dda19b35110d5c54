"""Session operators over conversations (messages; every third assistant turn counts as a tool's) and events (searches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..operators import sessions as S
from ..operators.search import bm25_top_k
from ..registry import query, table


def messages(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "tool").otherwise(F.col("role"))
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), role.alias("role"), F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 10).otherwise(0).cast("long").alias("tokens"), F.col("turn").alias("created_at"))


def searches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("strategy"), (F.col("event_id") % 20).alias("results"), F.round("value", 2).alias("ms"), F.col("ts").alias("created_at"))


M = """m AS (SELECT conv_id AS session_id, turn AS id, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'tool' ELSE role END AS role, text AS content, CAST(CASE WHEN turn % 2 = 0 THEN turn * 10 ELSE 0 END AS BIGINT) AS tokens, turn AS created_at FROM conversations),
mt AS (SELECT *, CAST(coalesce(nullif(tokens, 0), CASE WHEN length(content) > 0 THEN length(content) // 4 + 1 ELSE 0 END + 4) AS BIGINT) AS tk FROM m)"""
E = "s AS (SELECT user_id AS session_id, event_id AS id, event_type AS strategy, event_id % 20 AS results, round(value, 2) AS ms, ts AS created_at FROM events)"


@query(f"WITH {M}, t AS (SELECT session_id, count(*) AS messages, CAST(sum(tk) AS BIGINT) AS tokens FROM mt GROUP BY 1) SELECT *, round(tokens / 1000 * 100, 6) AS percent, CAST(greatest(0, 1000 - tokens) AS BIGINT) AS remaining, tokens / 1000 >= 0.8 AS near_limit, messages > 6 AND tokens > 800 AS compact FROM t")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return S.token_usage(messages(spark, sf), 1000)


@query(f"WITH {M}, w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS age, sum(tk) OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS running FROM mt) SELECT session_id, id, role FROM w WHERE age <= 2 OR running <= 300")
def retained_messages(spark: SparkSession, sf: str) -> DataFrame:
    return S.retained(messages(spark, sf), 300, 2).select("session_id", "id", "role")


@query(
    f"""WITH {M}, u AS (SELECT session_id, id, content, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS age FROM m WHERE role = 'user'),
r AS (SELECT session_id, string_agg('Q' || n || ': ' || content, ' | ' ORDER BY n) AS ctx FROM (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY age DESC) AS n FROM u WHERE age <= 3) GROUP BY 1),
q AS (SELECT conv_id AS session_id, CASE conv_id % 3 WHEN 0 THEN 'what about it' WHEN 1 THEN 'a long question that needs their context here' ELSE 'one complete question with no vague word at all' END AS query FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT q.session_id, CASE WHEN ctx IS NOT NULL AND q.session_id % 3 <> 2 THEN query || ' [Context: ' || ctx || ']' ELSE query END AS enhanced FROM q LEFT JOIN r USING (session_id)"""
)
def enhance_questions(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    q = F.when(F.col("session_id") % 3 == 0, "what about it").when(F.col("session_id") % 3 == 1, "a long question that needs their context here").otherwise("one complete question with no vague word at all")
    asked = m.select("session_id").distinct().join(S.recent_questions(m), "session_id", "left")
    return asked.select("session_id", S.enhanced(q, F.coalesce("asked", F.array().cast("array<string>"))).alias("enhanced"))


def tool_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with many tool messages, out of events."""
    role = F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool", "tool", "assistant"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), role.alias("role"), F.col("ts").alias("created_at"))


_RUNS = """WITH RECURSIVE o AS (SELECT user_id AS session_id, ['user', 'assistant', 'tool', 'tool', 'assistant'][event_id % 5 + 1] AS role, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
e AS (SELECT * FROM o UNION ALL SELECT session_id, 'end', max(i) + 1 FROM o GROUP BY 1),
s AS (SELECT session_id, i, role, CAST(-1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS tools FROM e WHERE i = 0
UNION ALL SELECT e.session_id, e.i, e.role, CASE WHEN s.first >= 0 AND s.role = 'tool' THEN s.first WHEN s.first < 0 AND s.role = 'assistant' THEN s.i ELSE -1 END, CASE WHEN s.first >= 0 AND s.role = 'tool' THEN s.tools + 1 ELSE 0 END
    FROM s JOIN e ON e.session_id = s.session_id AND e.i = s.i + 1),
r AS (SELECT session_id, CAST(first AS INTEGER) AS first, CAST(CASE WHEN role = 'assistant' THEN i ELSE i - 1 END AS INTEGER) AS last, CAST(tools AS INTEGER) AS tools FROM s
    WHERE first >= 0 AND ((role = 'assistant' AND i - first >= 2) OR (role NOT IN ('assistant', 'tool') AND i - first >= 3)))"""


@query(_RUNS + " SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY first) - 1 AS INTEGER) AS run, first, last, last - first + 1 AS n, tools FROM r")
def compactible_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.compactible(tool_messages(spark, sf))


@query(_RUNS + " SELECT session_id, CASE WHEN sum(tools) > 0 THEN 'Previous conversation included: ' || CAST(sum(tools) AS BIGINT) || ' tool invocations.' ELSE 'Previous conversation with ' || count(*) || ' exchanges.' END AS summary FROM r GROUP BY session_id")
def compaction_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return S.compaction_summary(S.compactible(tool_messages(spark, sf)))


@query(f"WITH {M} SELECT -session_id - 1 AS session_id, id || '-fork' AS id, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, id) || '-fork' AS parent_id, session_id AS forked_from, role, content FROM m")
def fork_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.forked(messages(spark, sf), -F.col("session_id") - 1)


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS age FROM s QUALIFY age <= 50),
u AS (SELECT session_id, strategy, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, strategy) AS k FROM r GROUP BY 1, 2)
SELECT r.session_id, count(*) AS searches, round(avg(ms), 6) AS avg_ms, round(avg(results), 6) AS avg_results, round(avg(ms) FILTER (WHERE age <= 10), 6) AS recent_ms, any_value(u.strategy) AS most_used FROM r JOIN u ON u.session_id = r.session_id AND k = 1 GROUP BY 1"""
)
def search_analytics(spark: SparkSession, sf: str) -> DataFrame:
    return S.search_analytics(searches(spark, sf)).withColumns({c: F.round(c, 6) for c in ("avg_ms", "avg_results", "recent_ms")})


@query(f"WITH {M}, {E}, a AS (SELECT session_id, count(*) AS messages, max(created_at) AS last_activity FROM m GROUP BY 1), b AS (SELECT session_id, count(*) AS searches FROM s GROUP BY 1) SELECT session_id, messages, coalesce(searches, 0) AS searches, last_activity, messages * 200 AS estimated_size FROM a LEFT JOIN b USING (session_id)")
def session_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return S.summaries(messages(spark, sf), searches(spark, sf))


@query(f"WITH {M} SELECT session_id, string_agg('**' || upper(role[1]) || role[2:] || '**: ' || content, chr(10) || chr(10) ORDER BY created_at, id) AS markdown FROM m GROUP BY 1")
def export_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return S.transcript(messages(spark, sf))


@query(f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS age FROM s QUALIFY age <= 20) SELECT session_id, id, strategy, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS INTEGER) AS sequence FROM r")
def search_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return S.timeline(searches(spark, sf), 20).select("session_id", "id", "strategy", "sequence")


@query(f"WITH {E}, a AS (SELECT session_id, max(created_at) + INTERVAL 72 HOUR AS expires_at FROM s GROUP BY 1) SELECT session_id FROM a WHERE expires_at < (SELECT max(ts) + INTERVAL 70 HOUR FROM events)")
def expired_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = searches(spark, sf).groupBy("session_id").agg((F.max("created_at") + F.expr("INTERVAL 72 HOURS")).alias("expires_at"))
    now = table(spark, sf, "events").agg((F.max("ts") + F.expr("INTERVAL 70 HOURS")).alias("now"))
    return S.expired(s.crossJoin(F.broadcast(now)), F.col("now")).select("session_id")


@query(
    f"""WITH {M}, u AS (SELECT session_id, id, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS w FROM m WHERE role = 'user'),
p AS (SELECT a.session_id, a.id, b.id AS earlier, CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0.0 END AS s FROM u a JOIN u b ON a.session_id = b.session_id AND b.id < a.id)
SELECT session_id, id, earlier, round(s, 6) AS similarity FROM p WHERE s > 0.05 QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY s DESC, earlier) <= 5"""
)
def similar_past_questions(spark: SparkSession, sf: str) -> DataFrame:
    u = messages(spark, sf).where("role = 'user'").select("session_id", "id", "content")
    e = u.select("session_id", F.col("id").alias("earlier"), F.col("content").alias("old"))
    pairs = u.join(e, "session_id").where("earlier < id").withColumn("score", jaccard(F.col("content"), F.col("old"))).where("score > 0.05")
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("session_id", "id").orderBy(F.desc("score"), "earlier"))
    return pairs.withColumn("r", best).where("r <= 5").select("session_id", "id", "earlier", F.round("score", 6).alias("similarity"))


_TOK = r"list_filter(list_transform(regexp_split_to_array(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: length(x) > 2)"


@query(
    f"""WITH x AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS term FROM x) GROUP BY 1, 2),
d AS (SELECT doc_id, len({_TOK.format("text")}) AS dl FROM x), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
b AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN q USING (term) JOIN f USING (term) JOIN d USING (doc_id), st GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 5"""
)
def search_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked full-text search over messages, for the benchmark texts."""
    m = messages(spark, sf).select((F.col("session_id") * 1000 + F.col("id")).alias("doc_id"), F.col("content").alias("text"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return bm25_top_k(m, q, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {E}, a AS (SELECT session_id, max(created_at) AS last_activity, CASE WHEN count(*) % 2 = 0 THEN 'active' ELSE 'closed' END AS status FROM s GROUP BY 1) SELECT * FROM a WHERE status = 'active' ORDER BY last_activity DESC, session_id LIMIT 20 OFFSET 5")
def list_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A page of active sessions (paging is the feature)."""
    s = searches(spark, sf).groupBy("session_id").agg(F.max("created_at").alias("last_activity"), F.when(F.count("*") % 2 == 0, "active").otherwise("closed").alias("status"))
    return S.listed(s, "active", 20, 5)


@query(f"WITH {M} SELECT session_id, id, content, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS p FROM m WHERE role = 'user') WHERE p <= 3")
def first_questions(spark: SparkSession, sf: str) -> DataFrame:
    return S.messages_of(messages(spark, sf), "user", 3).select("session_id", "id", "content", "place")


@query(f"WITH {E}, a AS (SELECT session_id FROM s GROUP BY 1 HAVING max(created_at) + INTERVAL 72 HOUR < (SELECT max(ts) + INTERVAL 70 HOUR FROM events)) SELECT session_id, count(*) AS searches FROM s WHERE session_id NOT IN (SELECT session_id FROM a) GROUP BY 1")
def kept_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Searches left when expired sessions are deleted with all they hold."""
    return S.without_expired(searches(spark, sf), expired_sessions(spark, sf)).groupBy("session_id").agg(F.count("*").alias("searches"))


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Forks of all conversations as sessions with settings, and of their messages, each the child of the turn before."""
    from pyspark.sql import Window

    m = messages(spark, sf).withColumn("parent_id", F.lag("id").over(Window.partitionBy("session_id").orderBy("id"))).withColumn("metadata", F.create_map(F.lit("role"), "role"))
    sessions = m.groupBy("session_id").agg(F.concat(F.lit("Talk "), F.first("session_id").cast("string")).alias("title"), F.sum("tokens").alias("tokens"), (F.count("*") / 10).alias("semantic_weight"), F.lit("archived").alias("status"), F.create_map(F.lit("turns"), F.count("*").cast("string")).alias("metadata"))
    return S.fork_graph(sessions, m, -F.col("session_id") - 1, F.timestamp_seconds(F.lit(1_700_000_000)))


@query(f"WITH {M} SELECT -session_id - 1 AS session_id, session_id AS parent_session_id, 'Fork of Talk ' || session_id AS title, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) / 10 AS semantic_weight, 'active' AS status, make_timestamp(1700000000000000) + INTERVAL 72 HOUR AS expires_at, CAST(count(*) AS VARCHAR) AS turns, CAST(session_id AS VARCHAR) AS forked_from FROM m GROUP BY session_id")
def forked_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s, _ = _graph(spark, sf)
    return s.select("session_id", "parent_session_id", "title", "tokens", "semantic_weight", "status", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), F.col("metadata")["turns"].alias("turns"), F.col("metadata")["forked_from"].alias("forked_from"))


@query(f"WITH {M} SELECT -session_id - 1 AS session_id, id || '-fork' AS id, lag(id) OVER (PARTITION BY session_id ORDER BY id) || '-fork' AS parent_id, content, tokens, role AS said_by, 'true' AS forked FROM m")
def forked_messages(spark: SparkSession, sf: str) -> DataFrame:
    _, m = _graph(spark, sf)
    return m.select("session_id", "id", "parent_id", "content", "tokens", F.col("metadata")["role"].alias("said_by"), F.col("metadata")["forked"].alias("forked"))


@query(
    """WITH x AS (SELECT user_id AS session_id, ts, 'find "' || event_type || '" ' || event_id AS query, CASE WHEN event_id % 3 = 0 THEN 'adaptive' WHEN event_id % 2 = 0 THEN 'reranked' ELSE 'hybrid' END AS strategy, event_id % 20 AS results, round(value, 2) AS ms,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events)
SELECT session_id, 'timestamp,query,strategy,results_count,execution_time_ms' || chr(10) || string_agg('"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","' || replace(query, '"', '""') || '","' || strategy || '",' || results || ',' || ms, chr(10) ORDER BY age) AS csv,
    '# Search History' || chr(10) || chr(10) || string_agg('## ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '- **Query**: ' || query || chr(10) || '- **Strategy**: ' || strategy || chr(10) || '- **Results**: ' || results || chr(10) || '- **Time**: ' || printf('%.2f', ms) || 'ms' || chr(10), chr(10) ORDER BY age) AS markdown
FROM x WHERE age <= 50 GROUP BY session_id"""
)
def export_search_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last fifty searches of each session, as CSV and Markdown (the limit is the feature)."""
    i = F.col("id")
    s = searches(spark, sf).withColumn("query", F.concat(F.lit('find "'), "strategy", F.lit('" '), i.cast("string"))).withColumn("strategy", S.strategy_label(i % 2 == 0, i % 3 == 0))
    return S.search_history(s, 50)


_NOW = "2024-01-02 03:04:05"


@query(
    f"""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Session 2024-01-02 03:04' END AS title, 'active' AS status, TIMESTAMP '{_NOW}' + INTERVAL 72 HOURS AS expires_at, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END AS BIGINT) AS parent_session_id,
CASE WHEN c_custkey % 2 = 0 THEN 'adaptive' ELSE 'hybrid' END AS default_search_strategy, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_nationkey / 100 AS DOUBLE) ELSE 0.7::DOUBLE END AS semantic_weight, 0.3::DOUBLE AS keyword_weight, c_custkey % 4 <> 0 AS enable_reranking, true AS enable_citations FROM customer"""
)
def create_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A session for each customer; every third names it, some choose settings or a parent, the rest takes the defaults."""
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(k.alias("session_id"), F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "").alias("title"), F.when(k % 5 == 0, F.col("c_nationkey")).alias("parent_session_id"), F.when(k % 2 == 0, "adaptive").alias("default_search_strategy"), F.when(k % 7 == 0, F.col("c_nationkey") / 100).alias("semantic_weight"), F.when(k % 4 == 0, False).alias("enable_reranking"))
    out = S.created(asked, F.lit(_NOW).cast("timestamp"))
    return out.select("session_id", "title", "status", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), F.col("parent_session_id"), *S.SETTINGS)


@query(f"WITH {E}, u AS (SELECT session_id, max(created_at) AS last_activity, count(*) FILTER (WHERE id % 10 = 0) AS used FROM s GROUP BY 1) SELECT session_id, CASE WHEN used > 0 THEN TIMESTAMP '{_NOW}' ELSE last_activity END AS last_activity FROM u")
def touched_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = searches(spark, sf)
    sessions = s.groupBy("session_id").agg(F.max("created_at").cast("timestamp").alias("last_activity"))
    return S.touched(sessions, s.where("id % 10 = 0"), F.lit(_NOW).cast("timestamp")).select("session_id", F.col("last_activity").cast("timestamp_ntz").alias("last_activity"))


@query(f"WITH {M} SELECT session_id, id, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS INTEGER) AS place FROM m WHERE id % 4 <> 3")
def context_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth turn is a summary here; the rest has no kind."""
    m = messages(spark, sf).withColumn("message_type", F.when(F.col("id") % 4 == 3, "summary"))
    return S.context_messages(m, summaries=False).select("session_id", "id", "role", "content", "place")


@query(f"WITH {M} SELECT session_id, count(*) AS messages FROM m GROUP BY 1 UNION ALL SELECT -session_id - 1, 0 FROM (SELECT DISTINCT session_id FROM m)")
def message_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Of every conversation, and of one without messages beside each."""
    m = messages(spark, sf)
    return S.message_counts(m.select(F.explode(F.array("session_id", -F.col("session_id") - 1)).alias("session_id")), m)


@query(f"WITH {E} SELECT session_id, id, strategy, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS age FROM s QUALIFY age <= 50")
def newest_searches(spark: SparkSession, sf: str) -> DataFrame:
    """The last fifty of each session (the limit is the feature)."""
    return S.newest_searches(searches(spark, sf)).select("session_id", "id", "strategy", "age")
