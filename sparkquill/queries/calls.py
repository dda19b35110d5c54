"""Model-call operators over events: a user is a session, the event's value gives tokens and milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls as C
from ..registry import query, table

NAMES = ["gpt-4o", "gpt-4o-mini", "anthropic/claude-3-opus", "ollama/mistral", "o1", "unknown-model"]
PROVIDERS = ["openai", "anthropic", "ollama"]


def calls(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        e.alias("id"), F.col("ts"), u.alias("session_id"), pick(NAMES, e).alias("model"), pick(PROVIDERS, e).alias("provider"), F.col("event_type").alias("query_type"),
        (e * 37 % 4000).alias("tokens_in"), (u * 13 % 900).alias("tokens_out"), (e % 11 != 0).alias("ok"), (e % 4 + 1).alias("attempts"), (e % 9 == 0).alias("fallback"), (e % 500).alias("ms"), F.concat(F.lit("e"), (e % 3).cast("string")).alias("error"), (u % 25).alias("batch"),
        (u % 10 + 1).alias("priority"), (e * 7 % 1000).alias("size"),
    )


L = f"""c AS (SELECT event_id AS id, ts, user_id AS session_id, [{", ".join(f"'{n}'" for n in NAMES)}][event_id % 6 + 1] AS model, [{", ".join(f"'{n}'" for n in PROVIDERS)}][event_id % 3 + 1] AS provider, event_type AS query_type,
    event_id * 37 % 4000 AS tokens_in, user_id * 13 % 900 AS tokens_out, event_id % 11 <> 0 AS ok, event_id % 4 + 1 AS attempts, event_id % 9 = 0 AS fallback, event_id % 500 AS ms, 'e' || (event_id % 3) AS error, user_id % 25 AS batch, user_id % 10 + 1 AS priority, event_id * 7 % 1000 AS size FROM events),
r(name, win, pin, pout) AS (VALUES {", ".join(f"('{m[1]}', {m[2]}, {m[5]}::DOUBLE, {m[6]}::DOUBLE)" for m in C.MODELS)}),
p AS (SELECT c.*, coalesce(tokens_in / 1000 * pin + tokens_out / 1000 * pout, 0) AS cost, coalesce(win, 4096) AS context_window FROM c LEFT JOIN r ON regexp_extract(model, '([^/]*)$', 1) = name)"""


def priced(spark: SparkSession, sf: str) -> DataFrame:
    return C.priced(calls(spark, sf), C.models(spark))


@query(f"WITH {L} SELECT id, model, round(cost, 9) AS cost, CAST(context_window AS INTEGER) AS context_window FROM p")
def price_calls(spark: SparkSession, sf: str) -> DataFrame:
    return priced(spark, sf).select("id", "model", F.round("cost", 9).alias("cost"), "context_window")


@query(
    f"""WITH {L} SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(query_type) = 0 THEN 'query_type' ELSE 'total' END AS level,
coalesce(provider, model, query_type, 'all') AS name, count(*) AS requests, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM p GROUP BY GROUPING SETS ((), (provider), (model), (query_type))"""
)
def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.cost_report(priced(spark, sf)).withColumn("cost", F.round("cost", 6))


@query(f"WITH {L} SELECT CAST(ts AS DATE) AS day, model, count(*) AS requests, round(sum(cost), 6) AS cost, round(avg(CAST(ok AS INT)), 6) AS success_rate FROM p GROUP BY 1, 2")
def usage_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return C.usage_by_day(priced(spark, sf)).withColumns({c: F.round(c, 6) for c in ("cost", "success_rate")})


@query(
    f"""WITH {L}, f AS (SELECT batch, string_agg(error, ',' ORDER BY id) AS first_errors FROM (SELECT * FROM c WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY batch ORDER BY id) <= 10) GROUP BY 1)
SELECT batch, count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE attempts > 1) AS retried, count(*) FILTER (WHERE fallback) AS fallbacks, CAST(sum(ms) AS BIGINT) AS total_ms,
round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate, count(*) FILTER (WHERE NOT ok) > 0 AND count(*) FILTER (WHERE ok) > 0 AS partial, count(*) FILTER (WHERE ok) = 0 AS complete_failure, coalesce(any_value(first_errors), '') AS first_errors FROM c LEFT JOIN f USING (batch) GROUP BY batch"""
)
def failure_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.failure_summary(calls(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@query("SELECT CAST(a AS INTEGER) AS attempt, least(30.0::DOUBLE, pow(2.0, a)) AS wait, least(1000.0::DOUBLE, pow(1.5, a)) AS sub_wait FROM range(0, 12) t(a)")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.range(12).select(F.col("id").cast("int").alias("attempt"))
    return a.select("attempt", C.backoff(F.col("attempt")).alias("wait"), C.backoff(F.col("attempt"), 1.0, 1.5, 1000.0).alias("sub_wait"))


@query(f"WITH {L}, t AS (SELECT *, query_type AS topic FROM c) SELECT id, topic || '_' || CAST((row_number() OVER (PARTITION BY topic ORDER BY id) - 1) // 10 AS VARCHAR) AS batch FROM t")
def batch_calls(spark: SparkSession, sf: str) -> DataFrame:
    return C.batches(calls(spark, sf).withColumn("topic", F.col("query_type"))).select("id", "batch")


@query(f"WITH {L}, b AS (SELECT query_type || '_' || CAST((row_number() OVER (PARTITION BY query_type ORDER BY id) - 1) // 10 AS VARCHAR) AS b FROM c), g AS (SELECT b, count(*) AS n FROM b GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS calls, count(*) AS groups, round(avg(n), 6) AS average, max(n) AS largest, min(n) AS smallest, round(1 - (count(*) - 1) / sum(n), 6) AS efficiency FROM g")
def batch_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    b = C.batches(calls(spark, sf).withColumn("topic", F.col("query_type")))
    return C.batch_efficiency(b).withColumns({c: F.round(c, 6) for c in ("average", "efficiency")})


@query(
    f"""WITH {L}, k AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY priority DESC, id) AS p, row_number() OVER (PARTITION BY batch ORDER BY size, id) AS s FROM c)
SELECT batch, id, CAST(p AS INTEGER) AS by_priority, CAST(s AS INTEGER) AS by_size, CAST(row_number() OVER (PARTITION BY batch ORDER BY least(2 * p - 1, 2 * s), id) AS INTEGER) AS mixed FROM k"""
)
def execution_order(spark: SparkSession, sf: str) -> DataFrame:
    out = calls(spark, sf).select("batch", "id", "priority", "size")
    for how, name in (("priority", "by_priority"), ("size", "by_size"), ("mixed", "mixed")):
        out = C.execution_order(out, how).withColumnRenamed("place", name)
    return out.drop("priority", "size")


@query(f"WITH {L} SELECT session_id, id FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, id) <= floor(count(*) OVER (PARTITION BY session_id) * 0.1) + 1")
def evict_oldest(spark: SparkSession, sf: str) -> DataFrame:
    return C.evicted(calls(spark, sf).select("session_id", F.col("id").alias("key"), "ts")).select("session_id", F.col("key").alias("id"))


_OPS = "o AS (SELECT event_id AS id, user_id AS key, ts, CASE event_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'invalidate' ELSE 'get' END AS op FROM events)"


@query(
    f"""WITH {_OPS}, l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER w AS lop, last_value(CASE WHEN op <> 'get' THEN ts END IGNORE NULLS) OVER w AS lts FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, coalesce(lop = 'set' AND ts - lts <= INTERVAL 1 DAY, false) AS hit FROM l WHERE op = 'get'"""
)
def cache_lookups(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id") % 5
    ops = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(e == 0, "set").when(e == 1, "invalidate").otherwise("get").alias("op"))
    return C.cache_lookups(ops, 86_400).select("id", "hit")


@query("SELECT user_id AS container, max(event_id % 100) AS peak_cpu, round(avg(event_id % 100), 6) AS avg_cpu, max(event_id % 777) AS peak_memory, round(avg(event_id % 777), 6) AS avg_memory, arg_max(event_id, (ts, event_id)) - arg_min(event_id, (ts, event_id)) AS network FROM events GROUP BY 1")
def resource_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    s = table(spark, sf, "events").select(F.col("user_id").alias("container"), "ts", e.alias("id"), (e % 100).alias("cpu"), (e % 777).alias("memory"), e.alias("network"))
    return C.resource_summary(s).withColumns({c: F.round(c, 6) for c in ("avg_cpu", "avg_memory")})


@query("WITH s AS (SELECT user_id AS c, event_id AS id, ts, event_id * 3 AS ct, event_id * 11 AS st FROM events), d AS (SELECT id, ct - lag(ct) OVER w AS u, st - lag(st) OVER w AS y FROM s WINDOW w AS (PARTITION BY c ORDER BY ts, id)) SELECT id, round(CASE WHEN y > 0 AND u > 0 THEN u / y * 100 ELSE 0.0 END, 6) AS cpu_percent FROM d")
def cpu_percent(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    s = table(spark, sf, "events").select(F.col("user_id").alias("container"), "ts", e.alias("id"), (e * 3).alias("cpu_total"), (e * 11).alias("system_total"))
    return C.cpu_percent(s).select("id", F.round("cpu_percent", 6).alias("cpu_percent"))


@query("SELECT * FROM (VALUES {}) t(provider, model) WHERE model IN ('gpt-4o', 'gpt-4o-mini', 'claude-3-5-sonnet', 'claude-3-opus')".format(", ".join(f"('{m[0]}', '{m[1]}')" for m in C.MODELS)))
def models_with_vision(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_capability(C.models(spark), "vision").select("provider", "model")


@query(
    f"""WITH {_OPS}, l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER w AS lop, last_value(CASE WHEN op <> 'get' THEN ts END IGNORE NULLS) OVER w AS lts FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT key, coalesce(lop = 'set' AND ts - lts <= INTERVAL 1 DAY, false) AS hit FROM l WHERE op = 'get') SELECT key, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(avg(CAST(hit AS INT)), 6) AS rate FROM h GROUP BY key"""
)
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"))
    return C.cache_stats(cache_lookups(spark, sf).join(users, "id")).withColumn("rate", F.round("rate", 6))


@query(f"WITH {L} SELECT count(*) AS calls, round(avg(CAST(ok AS INT)), 6) AS success_rate, round(avg(CAST(fallback AS INT)), 6) AS cache_rate, round(avg(attempts), 6) AS chunks_a_call FROM c")
def outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = C.outcome_stats(calls(spark, sf).withColumnsRenamed({"fallback": "cached", "attempts": "chunks"}))
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "cache_rate", "chunks_a_call")})


@query(
    """WITH o AS (SELECT user_id AS session_id, event_id * 7 % 4 AS key, event_id AS id, ts, CASE event_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'invalidate' ELSE 'get' END AS op FROM events),
k AS (SELECT session_id, key, arg_max(op, (ts, id)) FILTER (WHERE op <> 'get') AS op, max((ts, id)) FILTER (WHERE op <> 'get') AS at FROM o GROUP BY 1, 2),
e AS (SELECT k.session_id, k.at[1] AS ts, (SELECT max(ts) FROM events) - k.at[1] > INTERVAL 30 DAY AS late, coalesce(op = 'set', false) AS held, (SELECT count(*) FROM o WHERE o.session_id = k.session_id AND o.key = k.key AND o.op = 'get' AND (o.ts, o.id) > k.at) AS n FROM k)
SELECT session_id, count(*) FILTER (WHERE held AND NOT late) AS entries, count(*) FILTER (WHERE held AND late) AS expired, round(coalesce(avg(n) FILTER (WHERE held AND NOT late), 0), 6) AS avg_accesses, min(ts) FILTER (WHERE held AND NOT late) AS oldest, max(ts) FILTER (WHERE held AND NOT late) AS newest FROM e GROUP BY 1"""
)
def session_cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Caches of four keys a user; entries live thirty days."""
    e = F.col("event_id")
    events = table(spark, sf, "events")
    op = F.when(e % 5 == 0, "set").when(e % 5 == 1, "invalidate").otherwise("get")
    ops = events.select(F.col("user_id").alias("session_id"), (e * 7 % 4).alias("key"), e.alias("id"), F.col("ts").cast("timestamp").alias("ts"), op.alias("op"))
    now = events.agg(F.max("ts").cast("timestamp").alias("now"))
    out = C.session_cache_stats(ops, now.scalar(), 30 * 86_400)
    return out.select("session_id", "entries", "expired", F.round("avg_accesses", 6).alias("avg_accesses"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("oldest", "newest")))
