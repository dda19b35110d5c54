"""Execution trajectories: trees of steps by session id, durations, timelines, roll-ups, export.

steps: root, session_id (parent and child joined by `-sub-`), seq, ts (timestamp), step_type, tokens_in, tokens_out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# USD per 1,000 tokens in and out of trajectory costs.
PRICE_IN, PRICE_OUT = 0.0015, 0.006
TYPES = ["ROOT_LLM_START", "ROOT_LLM_COMPLETE", "CODE_EXECUTION_START", "CODE_EXECUTION_COMPLETE", "SUB_LLM_SPAWN", "SUB_LLM_COMPLETE", "ERROR", "RECURSION_LIMIT_HIT", "FINAL_ANSWER"]


def known_type(step_type: Column) -> Column:
    return F.when(step_type.isin(TYPES), step_type).otherwise("ERROR")


def depth(session_id: Column) -> Column:
    return F.regexp_count(session_id, F.lit("-sub-"))


def parent(session_id: Column) -> Column:
    return F.nullif(F.regexp_extract(session_id, r"^(.*)-sub-[^-]*$", 1), F.lit(""))


def step_cost() -> Column:
    return F.coalesce("tokens_in", F.lit(0)) / 1000 * PRICE_IN + F.coalesce("tokens_out", F.lit(0)) / 1000 * PRICE_OUT


def nodes(steps: DataFrame) -> DataFrame:
    """One row a session id: its last step, its place in the tree, and the time of its last completed pair."""
    t = F.col("step_type")
    w = Window.partitionBy("root", "session_id").orderBy("seq")
    begun = F.last(F.when(t.endswith("_START") | t.endswith("_SPAWN"), F.col("ts")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ms = F.when(t.endswith("_COMPLETE"), (F.unix_micros("ts") - F.unix_micros(begun)) / 1000)
    timed = steps.withColumn("step_type", known_type(t)).withColumn("ms", ms).withColumn("cost", step_cost())
    out = timed.groupBy("root", "session_id").agg(F.max_by(F.struct("step_type", "tokens_in", "tokens_out", "cost", "ts"), "seq").alias("last"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("ms"), F.count("*").alias("steps"))
    out = out.select("root", "session_id", "last.*", "ms", "steps").withColumn("depth", depth(F.col("session_id")))
    ids = out.select("root", F.col("session_id").alias("pid"))
    return out.withColumn("pid", parent(F.col("session_id"))).join(ids.withColumn("has", F.lit(True)), ["root", "pid"], "left").withColumn("parent_id", F.when(F.col("has"), F.col("pid"))).drop("pid", "has")


def timeline(tree: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("root").orderBy("ts", "session_id"))
    return tree.select("root", n.alias("place"), "session_id", "step_type", "ts", (F.unix_micros("ts") / 1000 + F.coalesce("ms", F.lit(0.0))).alias("end_ms"))


def cost_breakdown(tree: DataFrame) -> DataFrame:
    """By depth, by type and in all, in one pass."""
    tree.createOrReplaceTempView("__quill_tree")
    return tree.sparkSession.sql(
        """SELECT root, CASE WHEN grouping(depth) = 0 THEN 'depth' WHEN grouping(step_type) = 0 THEN 'type' ELSE 'total' END AS level, coalesce(CAST(depth AS STRING), step_type, 'all') AS name,
        count(*) AS nodes, sum(coalesce(tokens_in, 0)) AS tokens_in, sum(coalesce(tokens_out, 0)) AS tokens_out, sum(cost) AS cost FROM __quill_tree GROUP BY GROUPING SETS ((root), (root, depth), (root, step_type))"""
    )


def statistics(steps: DataFrame, tree: DataFrame) -> DataFrame:
    t = known_type(F.col("step_type"))
    llm = F.contains(t, F.lit("LLM"))
    s = steps.groupBy("root").agg(F.count("*").alias("steps"), F.count_if(llm).alias("llm_calls"), F.count_if(~llm & F.contains(t, F.lit("CODE"))).alias("code_runs"), F.count_if(t == "ERROR").alias("errors"), F.sum(step_cost()).alias("total_cost"))
    d = tree.groupBy("root").agg(F.max("depth").alias("max_depth"), F.avg(F.when(F.col("ms") > 0, F.col("ms"))).alias("avg_ms"))
    return s.join(d, "root")


def dot_lines(tree: DataFrame) -> DataFrame:
    """(root, dot): a GraphViz digraph."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    node = F.concat(F.lit("  "), q("session_id"), F.lit(" [label="), q("step_type"), F.lit("];"))
    edge = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("\n  "), q("parent_id"), F.lit(" -> "), q("session_id"), F.lit(";"))).otherwise("")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", F.concat(node, edge).alias("l")))), lambda x: x["l"]), "\n")
    return tree.groupBy("root").agg(F.concat(F.lit('digraph "'), F.col("root").cast("string"), F.lit('" {\n'), lines, F.lit("\n}")).alias("dot"))


def subtrees(tree: DataFrame, most_depth: int = 20) -> DataFrame:
    """(root, session_id, descendants, subtree_cost), by joining ancestors out of the ids (no iteration)."""
    parts = F.split("session_id", "-sub-")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-sub-"))
    lines = tree.select("root", F.explode(up).alias("ancestor"), "cost")
    return lines.groupBy("root", "ancestor").agg((F.count("*") - 1).alias("descendants"), F.sum("cost").alias("subtree_cost")).join(tree.select("root", F.col("session_id").alias("ancestor")), ["root", "ancestor"], "left_semi").withColumnRenamed("ancestor", "session_id")


def positions(tree: DataFrame) -> DataFrame:
    """Coordinates for drawing: a column a depth, a row a node of that depth."""
    n = F.row_number().over(Window.partitionBy("root", "depth").orderBy("session_id")) - 1
    return tree.select("root", "session_id", "parent_id", (F.col("depth") * 250).alias("x"), (n * 100).alias("y"))


def recursion_stats(tree: DataFrame) -> DataFrame:
    """Calls, nodes and the greatest depth of each run."""
    return tree.groupBy("root").agg(F.count_if(F.col("parent_id").isNotNull()).alias("calls"), F.max("depth").alias("max_depth"), F.count("*").alias("nodes"))


def node(tree: DataFrame, root, session_id: str) -> DataFrame:
    return tree.where((F.col("root") == root) & (F.col("session_id") == session_id))


def bundle(steps: DataFrame) -> dict[str, DataFrame]:
    """Everything about trajectories; the tree is built once and may be cached by the caller."""
    tree = nodes(steps)
    return {"tree": tree, "timeline": timeline(tree), "costs": cost_breakdown(tree), "statistics": statistics(steps, tree)}


def root_spans(tree: DataFrame) -> DataFrame:
    """(root, total_ms): from the root's time to the end of its last child; 0 without a child that has a duration."""
    top = tree.where("parent_id is null and depth = 0").select("root", F.col("session_id").alias("parent_id"), F.unix_micros("ts").alias("begun"))
    child = tree.where("parent_id is not null").groupBy("root", "parent_id").agg(F.max_by(F.struct("ts", "ms"), F.struct("ts", "session_id")).alias("c"))
    end = F.unix_micros("c.ts") / 1000 + F.col("c.ms")
    return top.join(child, ["root", "parent_id"], "left").select("root", F.when(F.col("c.ms") != 0, end - F.col("begun") / 1000).otherwise(0.0).alias("total_ms"))


def call_tree(tree: DataFrame) -> DataFrame:
    """(root, calls): each run's nested calls, a line a node, indented by depth, every node before its children."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "session_id")
    ordered = F.array_sort(F.collect_list(F.struct(F.split("session_id", "-sub-").alias("path"), line.alias("line"))))
    return tree.groupBy("root").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("calls"))


def depths_of(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: root, session_id -> its depth, 0 for those that the tree doesn't know."""
    return asked.join(tree.select("root", "session_id", "depth"), ["root", "session_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def exit_log(steps: DataFrame, exits: DataFrame) -> DataFrame:
    """exits (root, session_id, ts, any others) of known sessions, with depth and the seconds that each had been open."""
    born = steps.groupBy("root", "session_id").agg(F.min("ts").alias("__born"))
    open_for = (F.unix_micros("ts") - F.unix_micros("__born")) / 1_000_000
    return exits.join(born, ["root", "session_id"]).withColumns({"depth": depth(F.col("session_id")), "seconds": open_for}).drop("__born")


def json_bundles(steps: DataFrame) -> DataFrame:
    """(root, json): tree, timeline, costs and statistics of each run as one JSON text.

    A run's nodes meet in one row, as one text needs; runs are bounded by the recursion budget.
    """
    listed = lambda df, name, *order: df.groupBy("root").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in ("root", *order))))).alias(name))
    parts = bundle(steps)
    tree, line, costs = listed(parts["tree"], "nodes", "session_id"), listed(parts["timeline"], "timeline", "place"), listed(parts["costs"], "costs", "level", "name")
    facts = parts["statistics"]
    facts = facts.select("root", F.struct(*(c for c in facts.columns if c != "root")).alias("statistics"))
    all_parts = tree.join(line, "root").join(costs, "root").join(facts, "root")
    head = F.struct(F.lit("1.0.0").alias("version"), F.col("root").alias("session_id"))
    return all_parts.select("root", F.to_json(F.struct(head.alias("export_metadata"), F.struct("nodes").alias("tree"), "timeline", "costs", "statistics")).alias("json"))


def html_reports(steps: DataFrame) -> DataFrame:
    """(root, html): a page without outside parts, with a run's figures and its nodes in order of time."""
    tree = nodes(steps)
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit("<td>"), safe(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *(cell(F.col(c)) for c in ("session_id", "step_type", "depth", "tokens_in", "tokens_out")), F.lit("</tr>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "session_id", row.alias("row")))), lambda x: x["row"])
    rows = tree.groupBy("root").agg(F.array_join(ordered, "\n").alias("rows"))
    s = statistics(steps, tree).join(rows, "root")
    title = F.concat(F.lit("Trajectory "), safe(F.col("root").cast("string")))
    figures = F.format_string("<p>%d steps, %d model calls, %d code runs, %d errors, depth %d</p>", *(F.col(c).cast("long") for c in ("steps", "llm_calls", "code_runs", "errors", "max_depth")))
    head = F.lit("<tr><th>session</th><th>step</th><th>depth</th><th>tokens in</th><th>tokens out</th></tr>\n")
    page = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>\n<h1>"), title, F.lit("</h1>\n"), figures, F.lit("\n<table>\n"), head, F.col("rows"), F.lit("\n</table>\n</body></html>"))
    return s.select("root", page.alias("html"))


# The colours in which steps are shown, by type; of others.
COLORS = {
    "ROOT_LLM_START": "#3b82f6",
    "ROOT_LLM_COMPLETE": "#2563eb",
    "CODE_EXECUTION_START": "#eab308",
    "CODE_EXECUTION_COMPLETE": "#ca8a04",
    "SUB_LLM_SPAWN": "#22c55e",
    "SUB_LLM_COMPLETE": "#16a34a",
    "RECURSION_LIMIT_HIT": "#f97316",
    "ERROR": "#ef4444",
    "FINAL_ANSWER": "#6b7280",
}
OTHER_COLOR = "#9ca3af"


def step_label(step_type: Column) -> Column:
    """A type in words: `SUB_LLM_SPAWN` is Sub-LLM Spawn."""
    words = F.initcap(F.replace(step_type, F.lit("_"), F.lit(" ")))
    return F.replace(F.replace(words, F.lit("Llm"), F.lit("LLM")), F.lit("Sub LLM"), F.lit("Sub-LLM"))


def step_color(step_type: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair))[step_type], F.lit(OTHER_COLOR))


def cost_text(usd: Column) -> Column:
    """Dollars with four decimals; below a cent, cents with two (the dollar sign stays in front)."""
    return F.when(usd < 0.01, F.format_string("$%.2f¢", usd * 100)).otherwise(F.format_string("$%.4f", usd))


def tokens_text(n: Column) -> Column:
    return F.format_number(n, 0)


def elapsed_text(ms: Column) -> Column:
    """Milliseconds, seconds with a decimal from one second, minutes and seconds from one minute; N/A for null."""
    in_minutes = F.format_string("%dm %.1fs", F.floor(ms / 60_000), (ms % 60_000) / 1000)
    return F.when(ms.isNull(), "N/A").when(ms < 1000, F.format_string("%.0fms", ms)).when(ms < 60_000, F.format_string("%.1fs", ms / 1000)).otherwise(in_minutes)


def labels(tree: DataFrame) -> DataFrame:
    """(root, session_id, label, color, duration, tokens, cost): what a display shows of each node."""
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    kind = F.col("step_type")
    return tree.select("root", "session_id", step_label(kind).alias("label"), step_color(kind).alias("color"), elapsed_text(F.col("ms").cast("double")).alias("duration"), tokens_text(tokens).alias("tokens"), cost_text(F.col("cost")).alias("cost"))
