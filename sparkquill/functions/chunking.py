"""Chunking as folds over arrays: every function returns array<struct<...>>; `exploded` makes rows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import let, strip

CHUNK = "struct<content:string,start:bigint,end:bigint,tokens:bigint>"


def _chunk(content: Column, start: Column, end: Column, size: Column) -> Column:
    return F.struct(content.alias("content"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.floor(size / 4).cast("long").alias("tokens"))


def pack_paragraphs(text: Column, size: int, overlap: int = 0, separator: str = "\n\n") -> Column:
    """Paragraphs gathered up to `size` characters. A chunk that overflows ends before the paragraph; the next begins
    with its last `overlap` characters. A longer paragraph is never split. Offsets count packed text."""
    parts = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    none = F.array().cast(f"array<{CHUNK}>")
    start = F.struct(F.lit("").alias("buf"), F.lit(0).cast("long").alias("pos"), none.alias("out"))

    def closed(a: Column) -> Column:
        n = F.length(a["buf"])
        return F.array_append(a["out"], _chunk(strip(a["buf"]), a["pos"], a["pos"] + n, n))

    def step(a: Column, p: Column) -> Column:
        para = F.concat(p, F.lit(separator))
        some = F.length(a["buf"]) > 0
        over = F.length(a["buf"]) + F.length(para) > size
        tail = F.when(F.length(a["buf"]) > overlap, F.right(a["buf"], F.lit(overlap))).otherwise(a["buf"]) if overlap else F.lit("")
        buf = F.when(over, F.concat(tail, para)).otherwise(F.concat(a["buf"], para))
        pos = F.when(over & some, a["pos"] + F.length(a["buf"]) - overlap).otherwise(a["pos"])
        return F.struct(buf.alias("buf"), pos.alias("pos"), F.when(over & some, closed(a)).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.when(strip(a["buf"]) != "", closed(a)).otherwise(a["out"]))


def chunk(text: Column, size: int = 100_000, overlap: int = 1_000) -> Column:
    """Empty text gives none; text that fits gives one chunk as it is; else paragraphs are packed."""
    whole = F.array(_chunk(text, F.lit(0), F.length(text), F.length(text)))
    return F.when(F.length(text) == 0, F.array().cast(f"array<{CHUNK}>")).when(F.length(text) <= size, whole).otherwise(pack_paragraphs(text, size, overlap))


def fixed(text: Column, size: int, overlap: int = 0) -> Column:
    """At most `size` characters, cut after the last space or line end inside if there is one; ends with the text."""

    def cut(t: Column, at: Column) -> Column:
        piece = F.substr(t, at + 1, F.lit(size))
        broken = F.length(F.regexp_extract(piece, r"(?s)\A.*[ \n]", 0))
        return F.when(at + size >= F.length(t), F.length(t) - at).when(broken > 0, broken).otherwise(size)

    def of(t: Column) -> Column:
        step = max(1, size - overlap)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{CHUNK}>").alias("out"), F.lit(False).alias("done"))

        def go(a: Column, _: Column) -> Column:
            def with_length(n: Column) -> Column:
                end = a["at"] + n
                return F.struct(F.greatest(end - overlap, a["at"] + 1).alias("at"), F.array_append(a["out"], _chunk(F.substr(t, a["at"] + 1, n), a["at"], end, n)).alias("out"), (end >= F.length(t)).alias("done"))

            return F.when(a["done"], a).otherwise(let(cut(t, a["at"]), with_length))

        # No chunk is shorter than one character, and most are near `size`.
        rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(t) - 1)) if overlap else F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(t) - 1)), lambda i: (i % max(1, step // 8)) == 0)
        return F.when(F.length(t) == 0, F.array().cast(f"array<{CHUNK}>")).otherwise(F.aggregate(rounds, start, go, lambda a: a["out"]))

    return let(text, of)


def pack_context(text: Column, size: int) -> Column:
    """array<string>: paragraphs as they are, gathered while their own lengths stay within `size`."""
    start = F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    joined = lambda a: F.array_append(a["out"], F.array_join(a["cur"], "\n\n"))

    def step(a: Column, p: Column) -> Column:
        over = (a["n"] + F.length(p) > size) & (F.size(a["cur"]) > 0)
        return F.struct(F.when(over, F.array(p)).otherwise(F.array_append(a["cur"], p)).alias("cur"), F.when(over, F.length(p)).otherwise(a["n"] + F.length(p)).alias("n"), F.when(over, joined(a)).otherwise(a["out"]).alias("out"))

    packed = F.aggregate(F.split(text, "\n\n"), start, step, lambda a: F.when(F.size(a["cur"]) > 0, joined(a)).otherwise(a["out"]))
    return F.when(F.length(text) > 0, packed).otherwise(F.array().cast("array<string>"))


def sections(text: Column, heads: Column) -> Column:
    """array<struct<title, body>>: the text cut where each heading is first found."""
    places = F.array_sort(F.filter(F.transform(heads, lambda h: F.struct(F.position(h, text).alias("at"), h.alias("title"))), lambda x: x["at"] > 0))

    def of(ps: Column) -> Column:
        end = lambda i: F.coalesce(F.get(ps, i + 1)["at"], F.length(text) + 1)
        return F.transform(ps, lambda p, i: F.struct(p["title"].alias("title"), F.substr(text, p["at"], end(i) - p["at"]).alias("body")))

    return let(places, of)


def exploded(df: DataFrame, chunks: Column, key: str) -> DataFrame:
    """One row a chunk: key, chunk_index, and the chunk's fields."""
    return df.select(key, F.posexplode(chunks).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")


def rechunk_metadata(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """For each new chunk (key, chunk_index, start, end) what the old chunks (key, start, end, page, is_table, is_code) it overlaps say."""
    o = old.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), "page", "is_table", "is_code")
    joined = new.join(o, (F.col(key) == F.col("k")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left")
    return joined.groupBy(key, "chunk_index").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.coalesce(F.bool_or("is_table"), F.lit(False)).alias("is_table"), F.coalesce(F.bool_or("is_code"), F.lit(False)).alias("is_code"), F.count("k").alias("overlapping"))
