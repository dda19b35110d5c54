"""Conversations: histories, token budgets, compaction, forks, analytics, export.

messages: session_id, id, role, content, tokens, created_at (ordered within a session by created_at, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import session_tokens

S = SETTINGS.sessions
# Words that refer back.
PRONOUNS = ["it", "its", "they", "them", "their", "this", "that", "these", "those"]


def _newest() -> Window:
    return Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))


def _oldest() -> Window:
    return Window.partitionBy("session_id").orderBy("created_at", "id")


def message_tokens() -> Column:
    """Stored tokens, or an estimate, with four for the message itself."""
    return F.coalesce(F.nullif(F.col("tokens"), F.lit(0)), session_tokens(F.col("content")) + 4).cast("long")


def token_usage(messages: DataFrame, most: int = S.max_tokens) -> DataFrame:
    total = F.sum(message_tokens())
    out = messages.groupBy("session_id").agg(F.count("*").alias("messages"), total.alias("tokens"))
    share = F.col("tokens") / most
    return out.withColumns({"percent": F.round(share * 100, 6), "remaining": F.greatest(F.lit(0), F.lit(most) - F.col("tokens")).cast("long"), "near_limit": share >= S.compact_above, "compact": (F.col("messages") > S.keep_messages) & (F.col("tokens") > F.lit(S.compact_above * most))})


def retained(messages: DataFrame, tokens: int = S.keep_tokens, least: int = S.keep_messages) -> DataFrame:
    """The newest messages that fit, and at least `least`."""
    running = F.sum(message_tokens()).over(_newest().rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("age", F.row_number().over(_newest())).withColumn("running", running).where((F.col("age") <= least) | (F.col("running") <= tokens))


def recent_questions(messages: DataFrame, n: int = 3) -> DataFrame:
    """(session_id, asked): the last n of the user's messages, oldest first."""
    users = messages.where("role = 'user'").withColumn("age", F.row_number().over(_newest())).where(F.col("age") <= n)
    return users.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("o"), "content"))), lambda x: x["content"]).alias("asked"))


def enhanced(question: Column, asked: Column) -> Column:
    """With earlier questions, if there are any and it has a pronoun or fewer than five words."""
    tokens = F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != "")
    vague = F.exists(tokens, lambda w: w.isin(PRONOUNS)) | (F.size(tokens) < 5)
    context = F.array_join(F.transform(asked, lambda q, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), q)), " | ")
    return F.when(vague & (F.size(asked) > 0), F.concat(question, F.lit(" [Context: "), context, F.lit("]"))).otherwise(question)


def compactible(messages: DataFrame) -> DataFrame:
    """(session_id, run, first, last, n, tools): runs that start at an assistant's message, take in tools and end with
    the next assistant's, of three or more. The fold keeps only positions, not texts."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "role"))), lambda m: m["role"])
    none = F.array().cast("array<struct<first:int,last:int,tools:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(0).alias("tools"), none.alias("out"))

    def step(a: Column, role: Column) -> Column:
        i, open_ = a["i"], a["first"] >= 0
        tool, assistant = role == "tool", role == "assistant"
        closes = open_ & assistant
        run = F.struct(a["first"].alias("first"), F.when(closes, i).otherwise(i - 1).alias("last"), a["tools"].alias("tools"))
        long_enough = F.when(closes, i - a["first"] >= 2).otherwise(open_ & ~tool & (i - a["first"] >= 3))
        first = F.when(open_ & tool, a["first"]).when(closes, -1).when(~open_ & assistant, i).otherwise(-1)
        return F.struct((i + 1).alias("i"), first.alias("first"), F.when(open_ & tool, a["tools"] + 1).otherwise(0).alias("tools"), F.when(long_enough, F.array_append(a["out"], run)).otherwise(a["out"]).alias("out"))

    def finish(a: Column) -> Column:
        rest = F.struct(a["first"].alias("first"), (a["i"] - 1).alias("last"), a["tools"].alias("tools"))
        return F.when((a["first"] >= 0) & (a["i"] - a["first"] >= 3), F.array_append(a["out"], rest)).otherwise(a["out"])

    runs = messages.groupBy("session_id").agg(F.aggregate(ordered, start, step, finish).alias("runs"))
    out = runs.select("session_id", F.posexplode("runs").alias("run", "r"))
    return out.select("session_id", "run", "r.first", "r.last", (F.col("r.last") - F.col("r.first") + 1).alias("n"), "r.tools")


def compaction_summary(runs: DataFrame) -> DataFrame:
    out = runs.groupBy("session_id").agg(F.count("*").alias("runs"), F.sum("tools").alias("tools"))
    said = F.when(F.col("tools") > 0, F.concat(F.lit("Previous conversation included: "), F.col("tools").cast("string"), F.lit(" tool invocations."))).otherwise(F.concat(F.lit("Previous conversation with "), F.col("runs").cast("string"), F.lit(" exchanges.")))
    return out.select("session_id", said.alias("summary"))


def forked(messages: DataFrame, new_id: Column) -> DataFrame:
    """Copies under a new session id; ids get a suffix, and parents point at the copies."""
    suffix = lambda c: F.concat(F.col(c).cast("string"), F.lit("-fork"))
    parent = F.lag("id").over(_oldest())
    return messages.withColumn("parent", parent).select(new_id.alias("session_id"), suffix("id").alias("id"), F.concat(F.col("parent").cast("string"), F.lit("-fork")).alias("parent_id"), F.col("session_id").alias("forked_from"), "role", "content")


def search_analytics(searches: DataFrame, most: int = 50, recent: int = 10) -> DataFrame:
    """Of the last searches of each session. searches: session_id, id, strategy, results, ms, created_at."""
    rows = searches.withColumn("age", F.row_number().over(_newest())).where(F.col("age") <= most)
    counted = rows.groupBy("session_id").agg(F.count("*").alias("searches"), F.avg("ms").alias("avg_ms"), F.avg("results").alias("avg_results"), F.avg(F.when(F.col("age") <= recent, F.col("ms"))).alias("recent_ms"))
    used = rows.groupBy("session_id", "strategy").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.min_by("strategy", F.struct(-F.col("n"), "strategy")).alias("most_used"))
    return counted.join(used, "session_id")


def summaries(messages: DataFrame, searches: DataFrame) -> DataFrame:
    """Counts by session, children aggregated before they meet."""
    m = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("created_at").alias("last_activity"))
    s = searches.groupBy("session_id").agg(F.count("*").alias("searches"))
    return m.join(s, "session_id", "left").select("session_id", "messages", F.coalesce("searches", F.lit(0)).alias("searches"), "last_activity", (F.col("messages") * 200).alias("estimated_size"))


def transcript(messages: DataFrame) -> DataFrame:
    """(session_id, markdown): a whole conversation as one text."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit("**: "), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("markdown"))


def timeline(searches: DataFrame, most: int = 100) -> DataFrame:
    """The newest searches of a session in order of time, numbered."""
    rows = searches.withColumn("age", F.row_number().over(_newest())).where(F.col("age") <= most)
    return rows.withColumn("sequence", F.row_number().over(_oldest())).drop("age")


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") < now)


def listed(sessions: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the sessions, of one status or all, the latest active first (ties by id)."""
    some = sessions if status is None else sessions.where(F.col("status") == status)
    return some.orderBy(F.desc("last_activity"), "session_id").offset(offset).limit(limit)


def messages_of(messages: DataFrame, role: str | None = None, limit: int | None = None) -> DataFrame:
    """Each session's messages, of one role or all, numbered from the oldest; the first `limit` of them."""
    some = messages if role is None else messages.where(F.col("role") == role)
    numbered = some.withColumn("place", F.row_number().over(_oldest()))
    return numbered if limit is None else numbered.where(F.col("place") <= limit)


def without_expired(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of a table of a session's parts (messages, searches, citations) once expired sessions are deleted."""
    return rows.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def fork_graph(sessions: DataFrame, messages: DataFrame, new_id: Column, now: Column, ttl_hours: int = S.ttl_hours) -> tuple[DataFrame, DataFrame]:
    """Sessions and their messages, copied under new ids.

    sessions: session_id, title, status, tokens, metadata (map of strings) and any settings, which are copied as they are;
    messages: session_id, id, parent_id, metadata and any others. Copies are active until `now` and the time to live; their
    metadata say what they are copies of. A copied message's parent is the parent's copy; a parent outside the session is none.
    """
    with_new = sessions.withColumn("__new", new_id)
    born = F.map_from_arrays(F.array(F.lit("forked_from"), F.lit("forked_at")), F.array(F.col("session_id").cast("string"), now.cast("string")))
    merged = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("forked_from", "forked_at")), born)
    copies = with_new.withColumns({"title": F.concat(F.lit("Fork of "), F.coalesce("title", F.lit(""))), "status": F.lit("active"), "expires_at": now + F.make_dt_interval(hours=F.lit(ttl_hours)), "parent_session_id": F.col("session_id"), "metadata": merged})
    ids = with_new.select("session_id", F.col("__new").alias("__to"))
    mine = messages.join(ids, "session_id")
    known = messages.select(F.col("session_id").alias("__s"), F.col("id").alias("__p"))
    linked = mine.join(known, (F.col("session_id") == F.col("__s")) & (F.col("parent_id") == F.col("__p")), "left")
    copy = lambda c: F.concat(c.cast("string"), F.lit("-fork"))
    flagged = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "forked"), F.create_map(F.lit("forked"), F.lit("true")))
    moved = linked.withColumns({"session_id": F.col("__to"), "id": copy(F.col("id")), "parent_id": copy(F.col("__p")), "metadata": flagged}).drop("__to", "__s", "__p")
    return copies.withColumn("session_id", F.col("__new")).drop("__new"), moved


def strategy_label(reranked: Column, adaptive: Column) -> Column:
    """How a search was done: adaptive before reranked before hybrid."""
    return F.when(F.coalesce(adaptive, F.lit(False)), "adaptive").when(F.coalesce(reranked, F.lit(False)), "reranked").otherwise("hybrid")


def search_history(searches: DataFrame, most: int = 1_000) -> DataFrame:
    """(session_id, csv, markdown): the newest `most` searches of each session, newest first (the limit is the feature).

    searches: session_id, id, query, strategy, results, ms, created_at. Quotes in a question are doubled in CSV.
    """
    rows = searches.withColumn("age", F.row_number().over(_newest())).where(F.col("age") <= most)
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat_ws(",", q(stamp), q(F.col("query")), q(F.col("strategy")), F.col("results").cast("string"), F.col("ms").cast("string"))
    entry = F.concat(F.lit("## "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.format_string("\n- **Query**: %s\n- **Strategy**: %s\n- **Results**: %d\n- **Time**: %.2fms\n", "query", "strategy", F.col("results").cast("long"), "ms"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("age", c.alias("said")))), lambda x: x["said"])
    head = F.lit("timestamp,query,strategy,results_count,execution_time_ms")
    return rows.groupBy("session_id").agg(F.array_join(F.concat(F.array(head), ordered(line)), "\n").alias("csv"), F.array_join(F.concat(F.array(F.lit("# Search History\n")), ordered(entry)), "\n").alias("markdown"))


#: Settings of a new session where its request names none.
SETTINGS = {"default_search_strategy": "hybrid", "semantic_weight": 0.7, "keyword_weight": 0.3, "enable_reranking": True, "enable_citations": True}


def created(requests: DataFrame, now: Column, ttl_hours: int = S.ttl_hours) -> DataFrame:
    """New sessions, active until `now` and the time to live; titled by date where a request has no title or an empty one.

    requests: session_id and any of title, parent_session_id, metadata (map of strings) and the settings; what is absent or
    null gets its default. Further columns stay.
    """
    given = lambda name, kind: F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)
    title = F.coalesce(F.nullif(given("title", "string"), F.lit("")), F.concat(F.lit("Session "), F.date_format(now, "yyyy-MM-dd HH:mm")))
    kinds = {str: "string", float: "double", bool: "boolean"}
    settings = {k: F.coalesce(given(k, kinds[type(v)]), F.lit(v)) for k, v in SETTINGS.items()}
    metadata = F.coalesce(given("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    parent = given("parent_session_id", requests.schema["session_id"].dataType.simpleString())
    return requests.withColumns({"title": title, "status": F.lit("active"), "created_at": now, "last_activity": now, "expires_at": now + F.make_dt_interval(hours=F.lit(ttl_hours)), "parent_session_id": parent, "metadata": metadata, **settings})


def touched(sessions: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """All sessions; those among the ids of `used` were active `now`. Ids that are no session's change nothing."""
    ids = used.select(F.col("session_id").alias("__used")).where("__used is not null").distinct()
    return sessions.join(ids, F.col("session_id") == F.col("__used"), "left").withColumn("last_activity", F.when(F.col("__used").isNotNull(), now).otherwise(F.col("last_activity"))).drop("__used")


def context_messages(messages: DataFrame, summaries: bool = True) -> DataFrame:
    """Each session's messages from the oldest, numbered, with summaries of compacted ones or without. message_type: its kind; null is no summary."""
    some = messages if summaries else messages.where(~F.col("message_type").eqNullSafe("summary"))
    return messages_of(some)


def message_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, messages) of the asked sessions, summaries included; 0 for those without any."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return sessions.select("session_id").distinct().join(n, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def newest_searches(searches: DataFrame, limit: int = 50) -> DataFrame:
    """The `limit` newest searches of each session, numbered from the newest (ties: the later id first)."""
    return searches.withColumn("age", F.row_number().over(_newest())).where(F.col("age") <= limit)
