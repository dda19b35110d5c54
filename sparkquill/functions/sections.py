"""Chunking by sections: folds over (title, body) that carry titles, overlap and page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import CHUNK, _chunk, chunk
from .expr import let, strip

SECTION = "struct<title:string,body:string>"
TITLED = CHUNK.replace("struct<", "struct<title:string,")
PAGED = CHUNK.replace("struct<", "struct<page:int,")


def _section(title: Column, body: Column) -> Column:
    return F.struct(title.alias("title"), body.alias("body"))


def markdown_sections(text: Column) -> Column:
    """array<struct<title, body>>: lines under each heading; what comes before the first has an empty title.

    A heading without lines below it gives a section only at the end of the text.
    """

    def of(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda line, i: F.when(F.rlike(strip(line), F.lit(r"^#{1,6}\s+.+$")), i)), lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            end = lambda i: F.coalesce(F.get(at, i + 1), F.size(lines))
            title = lambda h: F.when(h < 0, F.lit("")).otherwise(strip(F.get(lines, h)))
            parts = F.transform(at, lambda h, i: F.struct(title(h).alias("title"), F.array_join(F.slice(lines, h + 2, end(i) - h - 1), "\n").alias("body"), (end(i) - h - 1).alias("n"), ((i == F.size(at) - 1) & (h >= 0)).alias("last")))
            return F.transform(F.filter(parts, lambda p: (p["n"] > 0) | p["last"]), lambda p: _section(p["title"], p["body"]))

        return let(F.concat(F.array(F.lit(-1)), heads), cut)

    return let(F.split(text, "\n"), of)


def sections_at(text: Column, heads: Column) -> Column:
    """array<struct<title, body>>: each heading is looked for behind what the ones before it took, once; its section ends
    where any other heading is next found. Text before the first heading has an empty title; the rest goes to the last."""
    none = F.array().cast(f"array<{SECTION}>")

    def joined(out: Column, more: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(_section(last["title"], F.concat(last["body"], more))))
        return F.when(F.size(out) > 0, grown).otherwise(F.array(_section(F.lit(""), more)))

    def step(a: Column, head: Column) -> Column:
        rest = a["rest"]

        def found(at: Column) -> Column:
            behind = at + F.length(head)
            others = F.filter(F.transform(heads, lambda h: F.when(h != head, F.position(h, rest, behind)).otherwise(0)), lambda p: p > 0)
            until = F.coalesce(F.array_min(others), F.length(rest) + 1)
            before = F.when(at > 1, joined(a["out"], F.substr(rest, F.lit(1), at - 1))).otherwise(a["out"])
            taken = F.struct(F.substr(rest, until).alias("rest"), F.array_append(before, _section(head, F.substr(rest, behind, until - behind))).alias("out"))
            return F.when(at > 0, taken).otherwise(a)

        return let(F.position(head, rest), found)

    return F.aggregate(heads, F.struct(text.alias("rest"), none.alias("out")), step, lambda a: F.when(F.length(a["rest"]) > 0, joined(a["out"], a["rest"])).otherwise(a["out"]))


def pack_sections(parts: Column, size: int, overlap: int = 0, opening: bool = False) -> Column:
    """Sections gathered up to `size` characters; a section is never split, a chunk begins with the last `overlap` characters.

    A chunk's title is its first section's. With `opening`, as for Markdown, only a section that opens a chunk because it
    did not fit before names it, so the first chunk has a title only if its first section is too long by itself.
    """
    none = F.array().cast(f"array<{TITLED}>")
    start = F.struct(F.lit("").alias("buf"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("title"), F.lit(0).alias("n"), none.alias("out"))

    def closed(a: Column) -> Column:
        n = F.length(a["buf"])
        c = _chunk(strip(a["buf"]), a["pos"], a["pos"] + n, n)
        return F.array_append(a["out"], F.struct(a["title"].alias("title"), c["content"].alias("content"), c["start"].alias("start"), c["end"].alias("end"), c["tokens"].alias("tokens")))

    def step(a: Column, s: Column) -> Column:
        full = F.concat(s["title"], F.lit("\n"), s["body"], F.lit("\n\n"))
        some = F.length(a["buf"]) > 0
        over = F.length(a["buf"]) + F.length(full) > size
        shut = over & some
        tail = F.right(a["buf"], F.lit(overlap)) if overlap else F.lit("")
        names = over if opening else shut | (a["n"] == 0)
        return F.struct(
            F.when(shut, F.concat(tail, full)).otherwise(F.concat(a["buf"], full)).alias("buf"),
            F.when(shut, a["pos"] + F.length(a["buf"]) - overlap).otherwise(a["pos"]).alias("pos"),
            F.when(names, s["title"]).otherwise(a["title"]).alias("title"),
            (a["n"] + 1).alias("n"),
            F.when(shut, closed(a)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(strip(a["buf"]) != "", closed(a)).otherwise(a["out"]))


def markdown_chunks(text: Column, size: int = 100_000, overlap: int = 1_000) -> Column:
    return pack_sections(markdown_sections(text), size, overlap, opening=True)


def semantic_chunks(text: Column, heads: Column, size: int = 100_000, overlap: int = 1_000) -> Column:
    """By given headings; empty text gives none."""
    return F.when(F.length(text) > 0, pack_sections(sections_at(text, heads), size, overlap)).otherwise(F.array().cast(f"array<{TITLED}>"))


def page_chunks(pages: Column, size: int = 100_000, overlap: int = 1_000) -> Column:
    """One chunk a page or slide, with its number from 1; a page over `size` gives several. Empty pages give none."""
    cut = lambda p, i: F.transform(chunk(p, size, overlap), lambda c: F.struct((i + 1).alias("page"), c["content"].alias("content"), c["start"].alias("start"), c["end"].alias("end"), c["tokens"].alias("tokens")))
    return F.flatten(F.transform(pages, cut))
