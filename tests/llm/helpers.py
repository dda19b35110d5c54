"""Edge cases every operator must take: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

#: Names that operators use for columns of their own.
CLASHING = ["n", "key", "hash", "size", "score", "row", "cid", "h", "rank", "target", "component", "keys", "rep", "vec", "threshold", "spans", "id"]
WORDS = [f"w{i}" for i in range(4000)]
LONG = " ".join(WORDS * 5)
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again today", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "de", None),
    (6, LONG, "fr", "a"),
    (7, LONG + " tail", "fr", "b"),
    (8, "one", "es", "c"),
    (None, "no id here but some words to count for everyone", "en", "c"),
    (9, "é\x00ü \x1c   　 end <|endoftext|> x@y.zz +1 (337) 555-9217", None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def edge_docs(spark):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in DOCS], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, score string, n string")


def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
