"""Keyed state over events: limits, breakers, caches, windows; and one query that runs as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources.shared import shared_dir
from ..streaming import caches, client, folds, notices, windows
from ..streaming.machines import Breaker, Bucket, Budget


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = windows.events(table(spark, sf, "events"))
    return e.select("event_id", "user_id", "ts", "event_type", F.round("value", 2).alias("value"), folds.seconds("ts").alias("at"), (F.col("event_id") * 53 % 900).cast("double").alias("need"), (F.col("event_id") % 3 > 0).alias("ok"))


LIMIT, BREAK = Bucket(rpm=0.001, tpm=600, burst=3), Breaker(failures=2, open_s=40_000, probes=3, successes=2)


_E = "e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, epoch_us(ts) / 1000000 AS now, CAST(event_id * 53 % 900 AS DOUBLE) AS need, event_id % 3 > 0 AS ok FROM events)"
_BUCKET = f"""WITH RECURSIVE {_E},
s AS (SELECT e.*, 3.0::DOUBLE AS r1, 600.0::DOUBLE AS t1 FROM e WHERE rn = 1
UNION ALL SELECT e.*, least(3.0::DOUBLE, CASE WHEN s.r1 >= 1 AND s.t1 >= s.need THEN s.r1 - 1 ELSE s.r1 END + (e.now - s.now) * 0.001::DOUBLE / 60),
    least(600.0::DOUBLE, CASE WHEN s.r1 >= 1 AND s.t1 >= s.need THEN s.t1 - s.need ELSE s.t1 END + (e.now - s.now) * 600::DOUBLE / 60) FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, r1 >= 1 AND t1 >= need AS allowed, CASE WHEN r1 >= 1 AND t1 >= need THEN 0.0::DOUBLE ELSE round(greatest((1 - r1) * 60 / 0.001::DOUBLE, (need - t1) * 60 / 600::DOUBLE, 0.0::DOUBLE), 6) END AS wait FROM s"""
_NEXT = """CASE WHEN blocked THEN 'open' WHEN st = 'closed' THEN CASE WHEN NOT ok AND failed + 1 >= 2 THEN 'open' ELSE 'closed' END WHEN NOT ok THEN 'open' WHEN good + 1 >= 2 THEN 'closed' ELSE 'half_open' END"""
_BREAKER = f"""WITH RECURSIVE {_E},
s AS (SELECT event_id, user_id, rn, now, ok, 'closed' AS st, 0 AS failed, 0 AS good, 0.0::DOUBLE AS opened, false AS blocked FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.rn, e.now, e.ok, CASE WHEN x.st = 'open' AND e.now - x.opened >= 40000 THEN 'half_open' ELSE x.st END, x.failed, x.good, x.opened, x.st = 'open' AND e.now - x.opened < 40000
    FROM (SELECT user_id, rn, {_NEXT} AS st, CASE WHEN blocked OR st <> 'closed' THEN 0 WHEN ok THEN 0 ELSE failed + 1 END AS failed, CASE WHEN NOT blocked AND st = 'half_open' AND ok AND good + 1 < 2 THEN good + 1 ELSE 0 END AS good,
        CASE WHEN NOT blocked AND {_NEXT} = 'open' THEN now ELSE opened END AS opened FROM s) x JOIN e ON e.user_id = x.user_id AND e.rn = x.rn + 1)
SELECT event_id, NOT blocked AS allowed, {_NEXT} AS state FROM s"""


@query(_BUCKET)
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", "user_id", "at", "need")
    return folds.fold(e, "user_id", ["at", "event_id"], LIMIT, ["at", "need"], "allowed boolean, wait double").select("event_id", "allowed", "wait")


@query(_BREAKER)
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", "user_id", "at", "ok")
    return folds.fold(e, "user_id", ["at", "event_id"], BREAK, ["at", "ok"], "allowed boolean, state string").select("event_id", "allowed", "state")


@query("WITH d AS (SELECT event_id, user_id, ts, event_id % 4 AS depth FROM events), r AS (SELECT *, count(*) FILTER (WHERE depth < 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM d) SELECT event_id, depth < 2 AND k <= 20 AS allowed, CAST(least(k, 20) AS BIGINT) AS calls FROM r")
def recursion_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", "user_id", "at", (F.col("event_id") % 4).alias("depth"))
    return folds.fold(e, "user_id", ["at", "event_id"], Budget(3, 20), ["depth"], "allowed boolean, calls bigint").select("event_id", "allowed", "calls")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(round(value, 2)), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf), "1 hour", ["event_type"]).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) - o * INTERVAL 1 HOUR AS TIMESTAMP) AS start, user_id, count(*) AS n FROM events, range(0, 6) r(o) GROUP BY 1, 2")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding(_events(spark, sf), "6 hours", "1 hour", ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.sessions(_events(spark, sf), "2 hours", ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("k", F.struct("ts", "event_id"))
    return windows.deduplicated(e, ["user_id", "event_type"], "k").select("user_id", "event_type", "event_id")


@query(
    """WITH c AS (SELECT user_id % 20 AS stream, user_id AS call, event_id AS seq, ts, event_type || ' ' AS chunk, event_id % 13 = 0 AS done, CASE WHEN event_id % 101 = 0 THEN 'x' END AS error FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stream ORDER BY ts, seq) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS gap FROM c),
p AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY stream ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g)
SELECT stream, part, call, string_agg(chunk, '' ORDER BY seq) AS response, count(*) AS chunks, CASE WHEN count(error) > 0 THEN 'error' WHEN bool_or(done) THEN 'complete' ELSE 'timeout' END AS outcome FROM p GROUP BY 1, 2, 3"""
)
def assemble_streams(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    c = _events(spark, sf).select((F.col("user_id") % 20).alias("stream"), F.col("user_id").alias("call"), e.alias("seq"), "ts", F.concat("event_type", F.lit(" ")).alias("chunk"), (e % 13 == 0).alias("done"), F.when(e % 101 == 0, "x").alias("error"))
    return windows.assembled(c, 3600)


@query(_BREAKER)
def streamed_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """The circuit breaker as a Structured Streaming job over the events file; its rows equal the batch fold's."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    s = windows.file_stream(spark, sf, "events.parquet").select("event_id", "user_id", folds.seconds("ts").alias("at"), (F.col("event_id") % 3 > 0).alias("ok"))
    out = folds.live(s, "user_id", ["at", "event_id"], BREAK, ["at", "ok"], "allowed boolean, state string").select("event_id", "allowed", "state")
    return windows.run_to_end(out, f"{at}/out", f"{at}/checkpoint")


# ----------------------------------------------------------------------------------- caches and the client chain

LRU_CAPACITY = 3
_USES = "u AS (SELECT event_id, user_id, event_type || (event_id % 3) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_DISTANCES = f"""{_USES}, b AS (SELECT *, lag(rn) OVER (PARTITION BY user_id, key ORDER BY rn) AS before FROM u),
r AS (SELECT b.event_id, b.user_id, b.rn, b.key, CASE WHEN b.before IS NOT NULL THEN count(DISTINCT o.key) END AS distance FROM b LEFT JOIN u o ON o.user_id = b.user_id AND o.rn > b.before AND o.rn < b.rn GROUP BY b.event_id, b.user_id, b.rn, b.key, b.before)"""


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    """Look-ups of each user: fifteen keys, in order."""
    return _events(spark, sf).select("event_id", "user_id", "at", F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("key"))


@query(f"WITH {_DISTANCES} SELECT event_id, CAST(distance AS BIGINT) AS distance FROM r")
def reuse_distances(spark: SparkSession, sf: str) -> DataFrame:
    return folds.fold(_uses(spark, sf), "user_id", ["at", "event_id"], caches.Reuse(), ["key"], "distance bigint").select("event_id", "distance")


@query(f"WITH {_DISTANCES} SELECT user_id, CAST(c AS INTEGER) AS capacity, count(*) FILTER (WHERE distance < c) AS hits, count(*) AS lookups FROM r, (SELECT unnest([1, 2, 4, 8]) AS c) GROUP BY 1, 2")
def lru_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache of each capacity would have hit, out of one pass."""
    distances = folds.fold(_uses(spark, sf), "user_id", ["at", "event_id"], caches.Reuse(), ["key"], "distance bigint")
    return caches.hit_rates(distances, [1, 2, 4, 8], "user_id")


@query(
    f"""WITH {_DISTANCES}, m AS (SELECT r.event_id, o.key, max(o.rn) AS used FROM r JOIN u o ON o.user_id = r.user_id AND o.rn < r.rn WHERE distance IS NULL OR distance >= {LRU_CAPACITY} GROUP BY 1, 2),
v AS (SELECT event_id, key AS evicted FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY used DESC) = {LRU_CAPACITY})
SELECT event_id, coalesce(distance < {LRU_CAPACITY}, false) AS hit, evicted FROM r LEFT JOIN v USING (event_id)"""
)
def lru_lookups(spark: SparkSession, sf: str) -> DataFrame:
    return folds.fold(_uses(spark, sf), "user_id", ["at", "event_id"], caches.Lru(LRU_CAPACITY), ["at", "key"], "hit boolean, evicted string").select("event_id", "hit", "evicted")


CLIENT = client.Client(BREAK, LIMIT, ttl_s=20_000, timeout_s=0)
_CHAIN = """WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, epoch_us(ts) / 1000000 AS now, event_type AS key, CAST(event_id * 53 % 900 AS DOUBLE) AS need, event_id % 3 > 0 AS ok, event_id % 7 = 0 AS blank FROM events),
s AS (SELECT e.*, CAST([] AS STRUCT(k VARCHAR, w DOUBLE)[]) AS cache, 'closed' AS st, 0 AS failed, 0 AS good, 0.0::DOUBLE AS opened, 3.0::DOUBLE AS r, 600.0::DOUBLE AS t, CAST(NULL AS DOUBLE) AS last FROM e WHERE rn = 1
UNION ALL SELECT e.*, x.cache, x.st, x.failed, x.good, x.opened, x.r, x.t, x.last FROM (
    SELECT user_id, rn, CASE WHEN called AND ok AND NOT blank THEN list_append(list_filter(cache, lambda c: c.k <> key), {'k': key, 'w': now}) ELSE cache END AS cache,
        CASE WHEN NOT called THEN b WHEN b = 'closed' THEN CASE WHEN NOT ok AND failed + 1 >= 2 THEN 'open' ELSE 'closed' END WHEN NOT ok THEN 'open' WHEN g + 1 >= 2 THEN 'closed' ELSE 'half_open' END AS st,
        CASE WHEN NOT called THEN failed WHEN b = 'closed' THEN CASE WHEN ok THEN 0 ELSE failed + 1 END WHEN ok AND g + 1 >= 2 THEN 0 ELSE failed END AS failed,
        CASE WHEN NOT called THEN g WHEN b = 'half_open' AND ok AND g + 1 < 2 THEN g + 1 ELSE 0 END AS good,
        CASE WHEN called AND NOT ok AND (b = 'half_open' OR failed + 1 >= 2) THEN now ELSE opened END AS opened,
        CASE WHEN NOT called THEN r WHEN r1 >= 1 AND t1 >= need THEN r1 - 1 ELSE r1 END AS r, CASE WHEN NOT called THEN t WHEN r1 >= 1 AND t1 >= need THEN t1 - need ELSE t1 END AS t, CASE WHEN called THEN now ELSE last END AS last
    FROM (SELECT *, NOT hit AND b <> 'open' AS called FROM (SELECT *, len(list_filter(cache, lambda c: c.k = key AND now - c.w <= 20000)) > 0 AS hit,
        CASE WHEN len(list_filter(cache, lambda c: c.k = key AND now - c.w <= 20000)) = 0 AND st = 'open' AND now - opened >= 40000 THEN 'half_open' ELSE st END AS b,
        CASE WHEN st = 'open' THEN 0 ELSE good END AS g, least(3.0::DOUBLE, r + coalesce(now - last, 0) * 0.001::DOUBLE / 60) AS r1, least(600.0::DOUBLE, t + coalesce(now - last, 0) * 600::DOUBLE / 60) AS t1 FROM s))) x
    JOIN e ON e.user_id = x.user_id AND e.rn = x.rn + 1),
h AS (SELECT *, len(list_filter(cache, lambda c: c.k = key AND now - c.w <= 20000)) > 0 AS hit, least(3.0::DOUBLE, r + coalesce(now - last, 0) * 0.001::DOUBLE / 60) AS r1, least(600.0::DOUBLE, t + coalesce(now - last, 0) * 600::DOUBLE / 60) AS t1 FROM s),
c AS (SELECT *, NOT hit AND NOT (st = 'open' AND now - opened < 40000) AS called FROM h)
SELECT event_id, CASE WHEN hit THEN 'cache' WHEN NOT called THEN 'refused' WHEN ok THEN 'model' ELSE 'failed' END AS served, called AND NOT (r1 >= 1 AND t1 >= need) AS limited, CAST(CASE WHEN called AND ok THEN need ELSE 0 END AS BIGINT) AS spent FROM c"""


def _calls(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return e.select(i.alias("id"), F.col("user_id").alias("provider"), "ts", folds.seconds("ts").alias("at"), F.col("event_type").alias("key"), (i * 53 % 900).cast("double").alias("need"), (i % 3 > 0).alias("ok"), (i % 7 == 0).alias("blank"))


@query(_CHAIN)
def client_chain(spark: SparkSession, sf: str) -> DataFrame:
    calls = _calls(windows.events(table(spark, sf, "events"))).drop("ts")
    return client.chained(calls, CLIENT).select(F.col("id").alias("event_id"), "served", "limited", "spent")


@query(_CHAIN)
def streamed_client_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The chain as a Structured Streaming job with a state each for cache, breaker and bucket."""
    at = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex[:12]}"
    out = client.live_chain(_calls(windows.file_stream(spark, sf, "events.parquet").withWatermark("ts", "1 hour")), CLIENT, only_watermark=True)
    return windows.run_to_end(out.select(F.col("id").alias("event_id"), "served", "limited", "spent"), f"{at}/out", f"{at}/checkpoint")


@query("SELECT user_id AS session_id, max(ts) AS last_activity FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def swept_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that a sweep deletes: timers fire when the watermark, an hour behind, has passed six hours after their last event."""
    at = f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex[:12]}"
    s = windows.file_stream(spark, sf, "events.parquet").withWatermark("ts", "1 hour").select(F.col("user_id").alias("session_id"), "ts", folds.seconds("ts").alias("at"))
    out = windows.run_to_end(client.expiring(s, 6 * 3600), f"{at}/out", f"{at}/checkpoint")
    return out.select("session_id", F.timestamp_micros(F.round(F.col("last_activity") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("last_activity"))


@query("WITH x AS (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) SELECT user_id AS session_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT user_id FROM x) GROUP BY 1")
def swept_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the sessions' events after the sweep."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"))
    return e.join(swept_sessions(spark, sf).select("session_id"), "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("events"))


_KINDS = ["STEP_START", "STEP_END", "CODE_GENERATED", "CODE_OUTPUT", "SUB_LLM_SPAWN", "SUB_LLM_RESULT", "LLM_TOKEN", "ERROR", "PROGRESS", "FINAL_RESULT"]


@query(
    f"""WITH e AS (SELECT *, {_KINDS!r}[event_id % 10 + 1] AS kind FROM events)
SELECT 's' || user_id AS session_id, CASE WHEN kind IN ('STEP_START', 'CODE_GENERATED', 'CODE_OUTPUT', 'SUB_LLM_SPAWN', 'SUB_LLM_RESULT', 'FINAL_RESULT', 'ERROR') THEN lower(kind) ELSE 'unknown' END AS type, ts, CAST(event_id AS VARCHAR) AS event
FROM e WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) % 2 = 0)"""
)
def live_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of all events of sessions that are followed (those with an even number of events)."""
    at = f"{shared_dir(spark)}/notices-{uuid.uuid4().hex[:12]}"
    session, i = F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i % 10 + 1).cast("int")).alias("kind")
    stream = windows.file_stream(spark, sf, "events.parquet").select(session, kind, "ts", F.create_map(F.lit("event"), i.cast("string")).alias("data"))
    followed = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n % 2 = 0").select(session)
    notices.deliver(stream, f"{at}/out", f"{at}/checkpoint", followed)
    out = notices.delivered(spark, f"{at}/out")
    return out.select("session_id", "type", F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.get_json_object("message", "$.data.event").alias("event"))
