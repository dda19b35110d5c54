"""Exports: JSON, CSV, Markdown, HTML and plain text, as rows or files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write(df: DataFrame, path: str, fmt: str, by: list[str] | None = None) -> None:
    """json or csv (with a header), appended; `by` makes a folder a value, such as a session."""
    w = df.write.mode("append")
    w = w.partitionBy(*by) if by else w
    w.option("header", "true").csv(path) if fmt == "csv" else w.json(path)


def html_page(title, body):
    """One self-contained page: escaped text in a column expression."""
    safe = body
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body><pre>"), safe, F.lit("</pre></body></html>"))


def plain_text(messages: DataFrame) -> DataFrame:
    """(session_id, text): one `ROLE: content` line a message."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("l")))), lambda x: x["l"])
    return messages.groupBy("session_id").agg(F.array_join(ordered, "\n").alias("text"))
