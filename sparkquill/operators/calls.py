"""Model calls: prices, cost reports, outcomes of batches, caches, order of execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Provider, model, context window, streaming, functions, USD per 1,000 tokens in and out, capabilities.
MODELS = [
    ("openai", "gpt-4o", 128000, True, True, 0.0025, 0.010, ["vision", "functions", "json_mode"]),
    ("openai", "gpt-4o-mini", 128000, True, True, 0.00015, 0.0006, ["vision", "functions", "json_mode"]),
    ("openai", "o1", 128000, False, False, 0.015, 0.060, ["reasoning"]),
    ("openai", "o3-mini", 128000, False, False, 0.0011, 0.0044, ["reasoning"]),
    ("anthropic", "claude-3-5-sonnet", 200000, True, True, 0.003, 0.015, ["vision", "functions", "tool_use"]),
    ("anthropic", "claude-3-opus", 200000, True, True, 0.015, 0.075, ["vision", "functions", "tool_use", "highest_quality"]),
    ("ollama", "llama3.2", 128000, True, False, 0.0, 0.0, ["local", "privacy"]),
    ("ollama", "mistral", 32768, True, False, 0.0, 0.0, ["local", "privacy"]),
]
# Models to try in turn.
FALLBACKS = {
    "smart": ["claude-3-opus", "gpt-4o", "claude-3-5-sonnet", "gpt-4o-mini"],
    "fast": ["gpt-4o-mini", "claude-3-5-sonnet", "gpt-4o"],
    "cheap": ["gpt-4o-mini", "ollama/llama3.2"],
    "local": ["ollama/llama3.2", "ollama/mistral"],
}
DEFAULT_WINDOW = 4096


def models(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*MODELS, *more], "provider string, model string, context_window int, streaming boolean, functions boolean, price_in double, price_out double, capabilities array<string>")


def with_capability(registry: DataFrame, capability: str | None = None, provider: str | None = None) -> DataFrame:
    out = registry.where(F.array_contains("capabilities", capability)) if capability else registry
    return out.where(F.col("provider") == provider) if provider else out


def fallback_chain(name: str) -> list[str]:
    return FALLBACKS.get(name, FALLBACKS["smart"])


def priced(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds cost to calls (model, tokens_in, tokens_out); a model that isn't registered costs nothing. Names may carry their provider."""
    r = registry.select(F.col("model").alias("m"), "price_in", "price_out", "context_window")
    short = F.regexp_extract(F.col("model"), r"([^/]*)$", 1)
    out = calls.join(F.broadcast(r), short == F.col("m"), "left")  # the registry is a short list
    cost = F.coalesce(F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out"), F.lit(0.0))
    return out.withColumn("cost", cost).withColumn("context_window", F.coalesce("context_window", F.lit(DEFAULT_WINDOW))).drop("m", "price_in", "price_out")


def cost_report(calls: DataFrame) -> DataFrame:
    """Requests, tokens and cost: in all, by provider, by model and by query type, in one pass."""
    calls.createOrReplaceTempView("__quill_calls")
    return calls.sparkSession.sql(
        """SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(query_type) = 0 THEN 'query_type' ELSE 'total' END AS level,
        coalesce(provider, model, query_type, 'all') AS name, count(*) AS requests, sum(tokens_in + tokens_out) AS tokens, sum(cost) AS cost
        FROM __quill_calls GROUP BY GROUPING SETS ((), (provider), (model), (query_type))"""
    )


def usage_by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("ts").alias("day"), "model").agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"), F.avg(F.col("ok").cast("int")).alias("success_rate"))


def failure_summary(calls: DataFrame, group: str = "batch") -> DataFrame:
    """calls: batch, id, ok, attempts, fallback, ms, error."""
    bad = F.col("failed")
    out = calls.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("ok")).alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if(F.col("fallback")).alias("fallbacks"),
        F.sum("ms").alias("total_ms"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("id", "error")))).alias("errors"),
    )
    return out.withColumns({"success_rate": F.col("succeeded") / F.col("total"), "partial": (bad > 0) & (F.col("succeeded") > 0), "complete_failure": F.col("succeeded") == 0, "first_errors": F.array_join(F.transform(F.slice("errors", 1, 10), lambda e: e["error"]), ",")}).drop("errors")


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(factor), attempt))


def batches(calls: DataFrame, size: int = 10) -> DataFrame:
    """Adds batch: calls of one topic in groups of at most `size`, in order of id."""
    n = F.row_number().over(Window.partitionBy("topic").orderBy("id"))
    return calls.withColumn("batch", F.concat("topic", F.lit("_"), F.floor((n - 1) / size).cast("string")))


def batch_efficiency(batched: DataFrame) -> DataFrame:
    g = batched.groupBy("batch").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("calls"), F.count("*").alias("groups"), F.avg("n").alias("average"), F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn("efficiency", 1 - (F.col("groups") - 1) / F.col("calls"))


def execution_order(calls: DataFrame, how: str = "mixed", group: str = "batch") -> DataFrame:
    """Adds place: by priority (high first), by size (small first), or the two orders in turn, each call once. calls: batch, id, priority, size."""
    p = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("priority"), "id"))
    s = F.row_number().over(Window.partitionBy(group).orderBy("size", "id"))
    key = {"priority": p, "size": s, "mixed": F.least(2 * p - 1, 2 * s)}[how]
    return calls.withColumn("key", key).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("key", "id"))).drop("key")


def evicted(entries: DataFrame, group: str = "session_id") -> DataFrame:
    """The oldest tenth, and one, of each cache. entries: session_id, key, ts."""
    n = F.count("*").over(Window.partitionBy(group))
    age = F.row_number().over(Window.partitionBy(group).orderBy("ts", "key"))
    return entries.withColumn("n", n).withColumn("age", age).where(F.col("age") <= F.floor(F.col("n") * 0.1) + 1).drop("n", "age")


def cache_lookups(operations: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """Whether each read finds a value written within ttl_s before it. operations: key, ts (timestamp), op (set, get, invalidate), id."""
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != "get", F.struct("op", "ts")), True).over(w)
    fresh = (last["op"] == "set") & (F.unix_micros("ts") - F.unix_micros(last["ts"]) <= ttl_s * 1_000_000)
    return operations.withColumn("last", last).withColumn("hit", F.coalesce(F.when(last.isNotNull(), fresh), F.lit(False))).drop("last").where("op = 'get'")


def resource_summary(samples: DataFrame, group: str = "container") -> DataFrame:
    """Peaks, averages and what the network moved. samples: container, ts, cpu, memory, network."""
    return samples.groupBy(group).agg(F.max("cpu").alias("peak_cpu"), F.avg("cpu").alias("avg_cpu"), F.max("memory").alias("peak_memory"), F.avg("memory").alias("avg_memory"), (F.max_by("network", F.struct("ts", "id")) - F.min_by("network", F.struct("ts", "id"))).alias("network"))


def cpu_percent(samples: DataFrame, group: str = "container") -> DataFrame:
    """100 * growth of the container's CPU time over growth of the system's, between samples."""
    w = Window.partitionBy(group).orderBy("ts", "id")
    used, system = F.col("cpu_total") - F.lag("cpu_total").over(w), F.col("system_total") - F.lag("system_total").over(w)
    return samples.withColumn("cpu_percent", F.when((system > 0) & (used > 0), used / system * 100).otherwise(0.0))


def cache_stats(lookups: DataFrame, group: str = "key") -> DataFrame:
    """lookups: key, hit -> hits, misses, rate."""
    return lookups.groupBy(group).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("int")).alias("rate"))


def session_cache_stats(operations: DataFrame, now: Column | None = None, ttl_s: int = 3600) -> DataFrame:
    """(session_id, entries, expired, avg_accesses, oldest, newest) of each session's cache after its operations.

    operations: session_id, key, ts, op (set, get, invalidate), id. An entry is a key whose last write is a set; its accesses
    are the reads since. With `now`, entries older than ttl_s are expired and not counted as entries. A session whose keys
    are all gone has 0 entries, 0 accesses and no oldest or newest.
    """
    when = F.struct("ts", "id")
    w = Window.partitionBy("session_id", "key").orderBy("ts", "id")
    writes = F.count_if(F.col("op") != "get").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    eras = operations.withColumn("era", writes).groupBy("session_id", "key", "era").agg(F.count_if(F.col("op") == "get").alias("accesses"), F.max_by("op", F.when(F.col("op") != "get", when)).alias("op"), F.max(F.when(F.col("op") != "get", F.col("ts"))).alias("ts"))
    last = eras.groupBy("session_id", "key").agg(F.max_by(F.struct("op", "ts", "accesses"), "era").alias("last")).select("session_id", "last.*")
    held = F.coalesce(F.col("op") == "set", F.lit(False))
    late = F.lit(False) if now is None else F.unix_micros(now) - F.unix_micros("ts") > ttl_s * 1_000_000
    live = held & ~late
    return last.groupBy("session_id").agg(F.count_if(live).alias("entries"), F.count_if(held & late).alias("expired"), F.coalesce(F.avg(F.when(live, F.col("accesses"))), F.lit(0.0)).alias("avg_accesses"), F.min(F.when(live, F.col("ts"))).alias("oldest"), F.max(F.when(live, F.col("ts"))).alias("newest"))


def outcome_stats(calls: DataFrame) -> DataFrame:
    """calls: ok, cached, chunks -> counts, success and cache rates, chunks a call."""
    return calls.agg(F.count("*").alias("calls"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.avg(F.col("cached").cast("int")).alias("cache_rate"), F.avg("chunks").alias("chunks_a_call"))
