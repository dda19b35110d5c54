"""Trajectories made of events: a user and day is one run, three levels of nested sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectories as T
from ..registry import query, table
from ..sources import trajectory_log
from ..sources.shared import shared_dir

KINDS = ["ROOT_LLM_START", "ROOT_LLM_COMPLETE", "CODE_EXECUTION_START", "CODE_EXECUTION_COMPLETE", "SUB_LLM_SPAWN", "SUB_LLM_COMPLETE", "SOMETHING_ELSE"]


def steps(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    sid = F.concat(F.lit("r"), F.when(e % 4 > 0, F.concat(F.lit("-sub-"), (e % 2).cast("string"))).otherwise(""), F.when(e % 4 == 3, F.concat(F.lit("-sub-"), (e % 3).cast("string"))).otherwise(""))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (e * 5 % 7 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("root"), sid.alias("session_id"), e.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("step_type"), (e * 31 % 2000).alias("tokens_in"), F.when(e % 3 > 0, e * 17 % 700).alias("tokens_out"))


_KNOWN = "CASE WHEN step_type = 'SOMETHING_ELSE' THEN 'ERROR' ELSE step_type END"
L = f"""s AS (SELECT user_id AS root, 'r' || CASE WHEN event_id % 4 > 0 THEN '-sub-' || (event_id % 2) ELSE '' END || CASE WHEN event_id % 4 = 3 THEN '-sub-' || (event_id % 3) ELSE '' END AS session_id, event_id AS seq, ts,
    [{", ".join(f"'{k}'" for k in KINDS)}][event_id * 5 % 7 + 1] AS step_type, event_id * 31 % 2000 AS tokens_in, CASE WHEN event_id % 3 > 0 THEN event_id * 17 % 700 END AS tokens_out FROM events),
b AS (SELECT *, coalesce(tokens_in, 0) / 1000 * 0.0015::DOUBLE + coalesce(tokens_out, 0) / 1000 * 0.006::DOUBLE AS cost,
    last_value(CASE WHEN step_type LIKE '%\\_START' ESCAPE '\\' OR step_type LIKE '%\\_SPAWN' ESCAPE '\\' THEN ts END IGNORE NULLS) OVER (PARTITION BY root, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begun FROM s),
d AS (SELECT *, CASE WHEN step_type LIKE '%\\_COMPLETE' ESCAPE '\\' THEN (epoch_us(ts) - epoch_us(begun)) / 1000 END AS ms FROM b),
n0 AS (SELECT root, session_id, arg_max({_KNOWN}, seq) AS step_type, arg_max(tokens_in, seq) AS tokens_in, max(seq) AS mseq, arg_max(cost, seq) AS cost, arg_max(ts, seq) AS ts, arg_max(ms, seq) FILTER (WHERE ms IS NOT NULL) AS ms, count(*) AS steps,
    (length(session_id) - length(replace(session_id, '-sub-', ''))) // 5 AS depth, nullif(regexp_extract(session_id, '^(.*)-sub-[^-]*$', 1), '') AS pid FROM d GROUP BY 1, 2),
n AS (SELECT n0.*, s.tokens_out, CASE WHEN EXISTS (SELECT 1 FROM n0 p WHERE p.root = n0.root AND p.session_id = n0.pid) THEN pid END AS parent_id FROM n0 JOIN s ON s.root = n0.root AND s.seq = mseq)"""


@query(f"WITH {L} SELECT root, session_id, step_type, tokens_in, tokens_out, round(cost, 9) AS cost, round(ms, 3) AS ms, steps, CAST(depth AS INTEGER) AS depth, parent_id FROM n")
def trajectory_tree(spark: SparkSession, sf: str) -> DataFrame:
    return T.nodes(steps(spark, sf)).drop("ts").withColumn("cost", F.round("cost", 9)).withColumn("ms", F.round("ms", 3))


@query(f"WITH {L} SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY ts, session_id) AS INTEGER) AS place, session_id, step_type, round(epoch_us(ts) / 1000 + coalesce(ms, 0), 3) AS end_ms FROM n")
def trajectory_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return T.timeline(T.nodes(steps(spark, sf))).drop("ts").withColumn("end_ms", F.round("end_ms", 3))


@query(
    f"""WITH {L} SELECT root, CASE WHEN grouping(depth) = 0 THEN 'depth' WHEN grouping(step_type) = 0 THEN 'type' ELSE 'total' END AS level, coalesce(CAST(depth AS VARCHAR), step_type, 'all') AS name, count(*) AS nodes,
CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS tokens_in, CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS tokens_out, round(sum(cost), 9) AS cost FROM n GROUP BY GROUPING SETS ((root), (root, depth), (root, step_type))"""
)
def trajectory_costs(spark: SparkSession, sf: str) -> DataFrame:
    return T.cost_breakdown(T.nodes(steps(spark, sf))).withColumn("cost", F.round("cost", 9))


@query(
    f"""WITH {L}, a AS (SELECT root, count(*) AS steps, count(*) FILTER (WHERE contains({_KNOWN}, 'LLM')) AS llm_calls, count(*) FILTER (WHERE NOT contains({_KNOWN}, 'LLM') AND contains({_KNOWN}, 'CODE')) AS code_runs, count(*) FILTER (WHERE {_KNOWN} = 'ERROR') AS errors, round(sum(cost), 9) AS total_cost FROM d GROUP BY 1)
SELECT a.*, x.max_depth, x.avg_ms FROM a JOIN (SELECT root, CAST(max(depth) AS INTEGER) AS max_depth, round(avg(CASE WHEN ms > 0 THEN ms END), 0) AS avg_ms FROM n GROUP BY 1) x USING (root)"""
)
def trajectory_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = steps(spark, sf)
    return T.statistics(s, T.nodes(s)).withColumn("total_cost", F.round("total_cost", 9)).withColumn("avg_ms", F.round("avg_ms", 0))


@query(
    f"""WITH {L} SELECT root, 'digraph "' || root || '" {{' || chr(10) || string_agg('  "' || session_id || '" [label="' || step_type || '"];' || CASE WHEN parent_id IS NOT NULL THEN chr(10) || '  "' || parent_id || '" -> "' || session_id || '";' ELSE '' END, chr(10) ORDER BY session_id) || chr(10) || '}}' AS dot FROM n GROUP BY root"""
)
def trajectory_dot(spark: SparkSession, sf: str) -> DataFrame:
    return T.dot_lines(T.nodes(steps(spark, sf)))


@query(
    f"""WITH RECURSIVE {L}, r AS (SELECT root, session_id, session_id AS anc, cost FROM n UNION ALL SELECT root, session_id, regexp_extract(anc, '^(.*)-sub-[^-]*$', 1), cost FROM r WHERE contains(anc, '-sub-'))
SELECT r.root, r.anc AS session_id, count(*) - 1 AS descendants, round(sum(r.cost), 9) AS subtree_cost FROM r JOIN n ON n.root = r.root AND n.session_id = r.anc GROUP BY 1, 2"""
)
def trajectory_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    return T.subtrees(T.nodes(steps(spark, sf))).withColumn("subtree_cost", F.round("subtree_cost", 9))


@query(f"WITH {L} SELECT root, session_id, parent_id, CAST(depth * 250 AS INTEGER) AS x, CAST((row_number() OVER (PARTITION BY root, depth ORDER BY session_id) - 1) * 100 AS INTEGER) AS y FROM n")
def trajectory_positions(spark: SparkSession, sf: str) -> DataFrame:
    return T.positions(T.nodes(steps(spark, sf)))


@query(f"WITH {L} SELECT root, count(*) FILTER (WHERE parent_id IS NOT NULL) AS calls, CAST(max(depth) AS INTEGER) AS max_depth, count(*) AS nodes FROM n GROUP BY root")
def recursion_stats(spark: SparkSession, sf: str) -> DataFrame:
    return T.recursion_stats(T.nodes(steps(spark, sf)))


@query(
    f"""WITH {L}, c AS (SELECT root, parent_id, arg_max(ts, (ts, session_id)) AS ts, arg_max(coalesce(ms, 0), (ts, session_id)) AS ms FROM n WHERE parent_id IS NOT NULL GROUP BY 1, 2)
SELECT n.root, round(CASE WHEN c.ms <> 0 THEN epoch_us(c.ts) / 1000 + c.ms - epoch_us(n.ts) / 1000 ELSE 0 END, 2) AS total_ms FROM n LEFT JOIN c ON c.root = n.root AND c.parent_id = n.session_id WHERE n.parent_id IS NULL AND depth = 0"""
)
def trajectory_spans(spark: SparkSession, sf: str) -> DataFrame:
    return T.root_spans(T.nodes(steps(spark, sf))).withColumn("total_ms", F.round("total_ms", 2))


@query(f"WITH {L} SELECT root, string_agg(repeat('  ', depth) || session_id, chr(10) ORDER BY string_split(session_id, '-sub-')) AS calls FROM n GROUP BY root")
def call_trees(spark: SparkSession, sf: str) -> DataFrame:
    return T.call_tree(T.nodes(steps(spark, sf)))


@query(f"WITH {L}, a AS (SELECT DISTINCT user_id AS root, 'r-sub-' || (user_id % 4) AS session_id FROM events) SELECT a.root, a.session_id, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM a LEFT JOIN n ON n.root = a.root AND n.session_id = a.session_id")
def current_depths(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    asked = table(spark, sf, "events").select(u.alias("root"), F.concat(F.lit("r-sub-"), (u % 4).cast("string")).alias("session_id")).distinct()
    return T.depths_of(T.nodes(steps(spark, sf)), asked)


# ------------------------------------------------------------------------------------------------- log


def logged(spark: SparkSession, sf: str) -> str:
    """A log of all steps, appended in two parts, in which every second user's run is ended."""
    path = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex[:12]}"
    e = table(spark, sf, "events")
    steps = e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.upper("event_type").alias("step_type"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.create_map(F.lit("value"), F.round("value", 2).cast("string"), F.lit("id"), F.col("event_id").cast("string")).alias("data"))
    early = F.col("data")["id"].cast("bigint") < 100
    trajectory_log.append(steps.where(early), path, 8)
    trajectory_log.append(steps.where(~early), path, 8)
    ended = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("timestamp"), F.count("*").alias("n"))
    trajectory_log.end_sessions(ended.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), "timestamp", F.create_map(F.lit("answer"), F.col("n").cast("string")).alias("data")), path, 8)
    return path


_LOGGED = """lg AS (SELECT 's' || user_id AS session_id, upper(event_type) AS step_type, ts, CAST(event_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS answer, event_id AS o FROM events
UNION ALL SELECT 's' || user_id, 'FINAL_ANSWER', max(ts), NULL, CAST(count(*) AS VARCHAR), NULL FROM events WHERE user_id % 2 = 0 GROUP BY user_id)"""


@query(f"WITH {_LOGGED} SELECT session_id, step_type, ts, id, answer FROM lg")
def trajectory_log_steps(spark: SparkSession, sf: str) -> DataFrame:
    s = trajectory_log.read(spark, logged(spark, sf), folders=8).where("line is null")
    return s.select("session_id", "step_type", F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.col("data")["id"].alias("id"), F.col("data")["answer"].alias("answer"))


@query(f"WITH {_LOGGED} SELECT session_id, step_type, ts, id, answer FROM lg WHERE session_id IN ('s1', 's2')")
def trajectory_log_of_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Two sessions' steps (point look-up is the feature), from their folders alone."""
    s = trajectory_log.read(spark, logged(spark, sf), ["s1", "s2"], 8)
    return s.select("session_id", "step_type", F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.col("data")["id"].alias("id"), F.col("data")["answer"].alias("answer"))


@query(
    f"""WITH {L}, born AS (SELECT root, session_id, min(ts) AS b FROM s GROUP BY 1, 2)
SELECT s.root, s.session_id, s.seq, CAST((length(s.session_id) - length(replace(s.session_id, '-sub-', ''))) // 5 AS INTEGER) AS depth, round((epoch_us(s.ts) - epoch_us(b)) / 1000000, 6) AS seconds FROM s JOIN born USING (root, session_id) WHERE step_type = 'SUB_LLM_COMPLETE'"""
)
def recursion_exits(spark: SparkSession, sf: str) -> DataFrame:
    """Every completed nested call leaves its session; a session that never was, asked for by each run, has no line."""
    s = steps(spark, sf)
    exits = s.where("step_type = 'SUB_LLM_COMPLETE'").select("root", "session_id", "ts", "seq")
    unknown = s.select("root").distinct().select("root", F.lit("none").alias("session_id"), F.current_timestamp().alias("ts"), F.lit(-1).cast("long").alias("seq"))
    return T.exit_log(s, exits.unionByName(unknown)).select("root", "session_id", "seq", "depth", F.round("seconds", 6).alias("seconds"))


@query(
    f"""WITH {L}, a AS (SELECT root, count(*) AS steps, count(*) FILTER (WHERE {_KNOWN} = 'ERROR') AS errors FROM d GROUP BY 1),
x AS (SELECT root, count(*) AS nodes, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, max(depth) AS max_depth, string_agg(session_id, ',' ORDER BY ts, session_id) AS in_time, string_agg(session_id || ':' || step_type, ',' ORDER BY session_id) AS tree FROM n GROUP BY 1)
SELECT root, '1.0.0' AS version, nodes, tree, in_time, tokens_in, steps, errors, CAST(max_depth AS BIGINT) AS max_depth FROM a JOIN x USING (root)"""
)
def trajectory_json(spark: SparkSession, sf: str) -> DataFrame:
    """Whole bundles, written as JSON and read back."""
    kind = "export_metadata STRUCT<version: STRING>, tree STRUCT<nodes: ARRAY<STRUCT<session_id: STRING, step_type: STRING>>>, timeline ARRAY<STRUCT<place: INT, session_id: STRING>>, costs ARRAY<STRUCT<level: STRING, tokens_in: BIGINT>>, statistics STRUCT<steps: BIGINT, errors: BIGINT, max_depth: BIGINT>"
    j = T.json_bundles(steps(spark, sf)).select("root", F.from_json("json", kind).alias("j")).select("root", "j.*")
    total = F.filter("costs", lambda c: c["level"] == "total")[0]["tokens_in"]
    said = F.transform("tree.nodes", lambda x: F.concat(x["session_id"], F.lit(":"), x["step_type"]))
    return j.select("root", F.col("export_metadata.version").alias("version"), F.size("tree.nodes").cast("long").alias("nodes"), F.array_join(said, ",").alias("tree"), F.array_join("timeline.session_id", ",").alias("in_time"), total.alias("tokens_in"), "statistics.steps", "statistics.errors", "statistics.max_depth")


@query(
    f"""WITH {L}, a AS (SELECT root, count(*) AS steps, count(*) FILTER (WHERE contains({_KNOWN}, 'LLM')) AS llm_calls, count(*) FILTER (WHERE NOT contains({_KNOWN}, 'LLM') AND contains({_KNOWN}, 'CODE')) AS code_runs, count(*) FILTER (WHERE {_KNOWN} = 'ERROR') AS errors FROM d GROUP BY 1),
x AS (SELECT root, max(depth) AS max_depth, string_agg('<tr><td>' || session_id || '</td><td>' || step_type || '</td><td>' || depth || '</td><td>' || tokens_in || '</td><td>' || coalesce(CAST(tokens_out AS VARCHAR), '') || '</td></tr>', chr(10) ORDER BY ts, session_id) AS r FROM n GROUP BY 1)
SELECT root, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Trajectory ' || root || '</title></head><body>' || chr(10) || '<h1>Trajectory ' || root || '</h1>' || chr(10)
|| '<p>' || steps || ' steps, ' || llm_calls || ' model calls, ' || code_runs || ' code runs, ' || errors || ' errors, depth ' || max_depth || '</p>' || chr(10) || '<table>' || chr(10)
|| '<tr><th>session</th><th>step</th><th>depth</th><th>tokens in</th><th>tokens out</th></tr>' || chr(10) || r || chr(10) || '</table>' || chr(10) || '</body></html>' AS html FROM a JOIN x USING (root)"""
)
def trajectory_html(spark: SparkSession, sf: str) -> DataFrame:
    return T.html_reports(steps(spark, sf))


@query(
    f"""WITH {L}, v AS (SELECT root, session_id, step_type, ms + 0.25::DOUBLE AS ms, coalesce(tokens_in, 0) * 100 + coalesce(tokens_out, 0) AS t, cost * 5 + 0.0000001::DOUBLE AS c FROM n)
SELECT root, session_id, CASE step_type WHEN 'ROOT_LLM_START' THEN 'Root LLM Start' WHEN 'ROOT_LLM_COMPLETE' THEN 'Root LLM Complete' WHEN 'CODE_EXECUTION_START' THEN 'Code Execution Start' WHEN 'CODE_EXECUTION_COMPLETE' THEN 'Code Execution Complete'
    WHEN 'SUB_LLM_SPAWN' THEN 'Sub-LLM Spawn' WHEN 'SUB_LLM_COMPLETE' THEN 'Sub-LLM Complete' ELSE 'Error' END AS label,
CASE step_type WHEN 'ROOT_LLM_START' THEN '#3b82f6' WHEN 'ROOT_LLM_COMPLETE' THEN '#2563eb' WHEN 'CODE_EXECUTION_START' THEN '#eab308' WHEN 'CODE_EXECUTION_COMPLETE' THEN '#ca8a04' WHEN 'SUB_LLM_SPAWN' THEN '#22c55e' WHEN 'SUB_LLM_COMPLETE' THEN '#16a34a' ELSE '#ef4444' END AS color,
CASE WHEN ms IS NULL THEN 'N/A' WHEN ms < 1000 THEN printf('%.0fms', ms) WHEN ms < 60000 THEN printf('%.1fs', ms / 1000) ELSE CAST(floor(ms / 60000) AS BIGINT) || 'm ' || printf('%.1fs', (ms - 60000 * floor(ms / 60000)) / 1000) END AS duration,
format('{{:,}}', t) AS tokens, CASE WHEN c < 0.01 THEN printf('$%.2f¢', c * 100) ELSE printf('$%.4f', c) END AS cost FROM v"""
)
def trajectory_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and costs are scaled so that every form occurs; the small offsets keep halves away from rounding."""
    tree = T.nodes(steps(spark, sf)).withColumns({"ms": F.col("ms") + 0.25, "tokens_in": F.coalesce("tokens_in", F.lit(0)) * 100, "cost": F.col("cost") * 5 + 1e-7})
    return T.labels(tree)
