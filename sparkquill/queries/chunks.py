"""Chunking over the documents table (line ends doubled, so that lines are paragraphs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import sections as S
from ..functions import text as T
from ..registry import query, table

SIZE, OVERLAP = 600, 50


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))


PACK = r"""WITH RECURSIVE p AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
q AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM p {where}),
f AS (SELECT doc_id, ps, 0 AS i, '' AS buf, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS s FROM q
UNION ALL SELECT doc_id, ps, i + 1,
    CASE WHEN i + 1 > len(ps) THEN '' WHEN length(buf) + length(ps[i + 1]) + 2 > {size} THEN right(buf, {overlap}) || ps[i + 1] || chr(10) || chr(10) ELSE buf || ps[i + 1] || chr(10) || chr(10) END,
    CASE WHEN i + 1 <= len(ps) AND length(buf) + length(ps[i + 1]) + 2 > {size} AND buf <> '' THEN pos + length(buf) - {overlap} ELSE pos END,
    CASE WHEN buf <> '' AND (i + 1 > len(ps) OR length(buf) + length(ps[i + 1]) + 2 > {size}) THEN buf END,
    CASE WHEN buf <> '' AND (i + 1 > len(ps) OR length(buf) + length(ps[i + 1]) + 2 > {size}) THEN pos END
    FROM f WHERE i <= len(ps)),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, regexp_replace(done, '^\s+|\s+$', '', 'g') AS content, s AS start, s + length(done) AS "end", CAST(length(done) // 4 AS BIGINT) AS tokens FROM f WHERE done IS NOT NULL)"""


@query(PACK.format(size=SIZE, overlap=OVERLAP, where="") + ' SELECT doc_id, chunk_index, content, start, "end", tokens FROM c')
def pack_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return C.exploded(paragraphs(spark, sf), C.pack_paragraphs(F.col("text"), SIZE, OVERLAP), "doc_id")


@query(
    PACK.format(size=SIZE, overlap=OVERLAP, where=f"WHERE length(t) > {SIZE}")
    + f""" SELECT doc_id, chunk_index, content, start, "end", tokens FROM c UNION ALL
SELECT doc_id, 0, t, 0, CAST(length(t) AS BIGINT), CAST(length(t) // 4 AS BIGINT) FROM p WHERE length(t) BETWEEN 1 AND {SIZE}"""
)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return C.exploded(paragraphs(spark, sf), C.chunk(F.col("text"), SIZE, OVERLAP), "doc_id")


@query(
    r"""WITH RECURSIVE f AS (SELECT doc_id, text AS t, 0 AS p, 0 AS n FROM documents
UNION ALL SELECT doc_id, t, p + n, CASE WHEN p + n + 500 >= length(t) THEN length(t) - p - n
    WHEN length(regexp_extract(substr(t, p + n + 1, 500), '(?s)^.*[ \n]')) > 0 THEN length(regexp_extract(substr(t, p + n + 1, 500), '(?s)^.*[ \n]')) ELSE 500 END FROM f WHERE p + n < length(t))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS chunk_index, substr(t, p + 1, n) AS content, CAST(p AS BIGINT) AS start, CAST(p + n AS BIGINT) AS "end", CAST(n // 4 AS BIGINT) AS tokens FROM f WHERE n > 0"""
)
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.exploded(table(spark, sf, "documents"), C.fixed(F.col("text"), 500), "doc_id")


@query(
    r"""WITH RECURSIVE q AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
f AS (SELECT doc_id, ps, 1 AS i, length(ps[1]) AS n, 0 AS g FROM q
UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN n + length(ps[i + 1]) > 700 THEN length(ps[i + 1]) ELSE n + length(ps[i + 1]) END, CASE WHEN n + length(ps[i + 1]) > 700 THEN g + 1 ELSE g END FROM f WHERE i < len(ps))
SELECT doc_id, g AS chunk_index, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS content FROM f GROUP BY doc_id, g"""
)
def pack_context(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(spark, sf).select("doc_id", F.posexplode(C.pack_context(F.col("text"), 700)).alias("chunk_index", "content"))


@query(PACK.format(size=SIZE, overlap=OVERLAP, where="") + " SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(length(content)) // count(*) AS BIGINT) AS average, count(*) FILTER (WHERE contains(lower(content), 'tion')) AS with_term FROM c GROUP BY doc_id")
def context_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = pack_paragraphs(spark, sf)
    n = F.length("content")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(n).cast("long").alias("chars"), F.floor(F.sum(n) / F.count("*")).cast("long").alias("average"), F.count_if(F.contains(F.lower("content"), F.lit("tion"))).alias("with_term"))


@query(PACK.format(size=SIZE, overlap=OVERLAP, where="") + " SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM c WHERE chunk_index BETWEEN 1 AND 3 GROUP BY doc_id")
def chunk_range(spark: SparkSession, sf: str) -> DataFrame:
    c = pack_paragraphs(spark, sf).where(F.col("chunk_index").between(1, 3))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n").alias("content"))


@query(
    r"""WITH d AS (SELECT doc_id, 'Alpha' || chr(10) || text || chr(10) || 'Omega ' || doc_id || chr(10) || 'tail' AS t FROM documents)
SELECT doc_id, 0 AS pos, 'Alpha' AS title, substr(t, 1, strpos(t, 'Omega ') - 1) AS body FROM d UNION ALL SELECT doc_id, 1, 'Omega ', substr(t, strpos(t, 'Omega ')) FROM d"""
)
def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Alpha\n"), "text", F.lit("\nOmega "), F.col("doc_id").cast("string"), F.lit("\ntail"))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    cut = C.sections(F.col("t"), F.array(F.lit("Omega "), F.lit("Alpha"), F.lit("Not there")))
    return d.select("doc_id", F.posexplode(cut).alias("pos", "s")).select("doc_id", "pos", "s.*")


_OLD = """o AS (SELECT doc_id, s * 400 AS start, s * 400 + 400 AS "end", CAST(s + 1 AS BIGINT) AS page, s % 3 = 0 AS is_table, s % 5 = 0 AS is_code FROM (SELECT doc_id, unnest(range(0, (length(text) + 399) // 400)) AS s FROM documents))"""


@query(
    PACK.format(size=SIZE, overlap=OVERLAP, where="")
    + f""", {_OLD} SELECT c.doc_id, chunk_index, min(page) AS first_page, max(page) AS last_page, coalesce(bool_or(is_table), false) AS is_table, coalesce(bool_or(is_code), false) AS is_code, count(page) AS overlapping
FROM c LEFT JOIN o ON c.doc_id = o.doc_id AND c.start < o."end" AND c."end" > o.start GROUP BY 1, 2"""
)
def rechunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.explode(F.expr("sequence(0, cast((length(text) - 1) div 400 as int))")).alias("s"))
    old = old.select("doc_id", (F.col("s") * 400).alias("start"), (F.col("s") * 400 + 400).alias("end"), (F.col("s") + 1).cast("long").alias("page"), (F.col("s") % 3 == 0).alias("is_table"), (F.col("s") % 5 == 0).alias("is_code"))
    return C.rechunk_metadata(pack_paragraphs(spark, sf), old, "doc_id")


@query(r"""SELECT doc_id, CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens FROM documents GROUP BY doc_id""")
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("doc_id").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("total_tokens"))


# ------------------------------------------------------------------------------------------- by sections

LINES = PACK.replace("replace(text, chr(10), chr(10) || chr(10))", "text").replace("string_split(t, chr(10) || chr(10))", "string_split(t, chr(10))").replace("|| chr(10) || chr(10)", "|| chr(10)").replace("+ 2 >", "+ 1 >")


@query(LINES.format(size=SIZE, overlap=0, where="") + ' SELECT doc_id, chunk_index, content, start, "end", tokens FROM c')
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """As pages without mark-up are cut: at single line ends, without overlap."""
    return C.exploded(table(spark, sf, "documents").select("doc_id", "text"), C.pack_paragraphs(F.col("text"), SIZE, 0, "\n"), "doc_id")


_TRANSCRIPTS = "md AS (SELECT conv_id AS doc_id, string_agg('## ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)"
_LINES = r"""l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM md),
k AS (SELECT *, regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^#{1,6}\s+.+$') AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM k),
a AS (SELECT doc_id, s, coalesce(max(CASE WHEN head THEN regexp_replace(line, '^\s+|\s+$', '', 'g') END), '') AS title, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '') AS body, count(*) FILTER (WHERE NOT head) AS n FROM g GROUP BY 1, 2),
sec AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS pos, title, body FROM (SELECT *, s = max(s) OVER (PARTITION BY doc_id) AS last FROM a) WHERE n > 0 OR last)"""


def _packed(sections: str, size: int, overlap: int, opening: bool) -> str:
    """Sections (doc_id, pos, title, body) gathered one by one."""
    names = "over" if opening else "(over AND buf <> '') OR i = 0"
    return f"""WITH RECURSIVE {sections},
p AS (SELECT doc_id, list(title ORDER BY pos) AS titles, list(title || chr(10) || body || chr(10) || chr(10) ORDER BY pos) AS ps FROM sec GROUP BY 1),
f AS (SELECT doc_id, titles, ps, 0 AS i, '' AS buf, CAST(0 AS BIGINT) AS pos, '' AS title, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS s, CAST(NULL AS VARCHAR) AS named FROM p
UNION ALL SELECT doc_id, titles, ps, i + 1,
    CASE WHEN i + 1 > len(ps) THEN '' WHEN over AND buf <> '' THEN right(buf, {overlap}) || ps[i + 1] ELSE buf || ps[i + 1] END,
    CASE WHEN i + 1 <= len(ps) AND over AND buf <> '' THEN pos + length(buf) - {overlap} ELSE pos END,
    CASE WHEN i + 1 <= len(ps) AND ({names}) THEN titles[i + 1] ELSE title END,
    CASE WHEN buf <> '' AND (i + 1 > len(ps) OR over) THEN buf END, CASE WHEN buf <> '' AND (i + 1 > len(ps) OR over) THEN pos END, title
    FROM (SELECT *, length(buf) + length(ps[i + 1]) > {size} AS over FROM f) WHERE i <= len(ps)),
c AS (SELECT doc_id, i, named AS title, regexp_replace(done, '^\\s+|\\s+$', '', 'g') AS content, s AS start, s + length(done) AS "end", CAST(length(done) // 4 AS BIGINT) AS tokens FROM f WHERE done IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, title, content, start, "end", tokens FROM c WHERE content <> ''""".replace("\\\\", "\\")


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as one Markdown text, a heading a turn."""
    line = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(lines, "\n").alias("text"))


@query(f"WITH {_TRANSCRIPTS}, {_LINES} SELECT doc_id, pos, title, body FROM sec")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts(spark, sf).select("doc_id", F.posexplode(S.markdown_sections(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", "s.*")


@query(_packed(f"{_TRANSCRIPTS}, {_LINES}", 700, 60, True))
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.exploded(transcripts(spark, sf), S.markdown_chunks(F.col("text"), 700, 60), "doc_id")


_HEADS = ["## user 0", "## assistant 3", "## assistant 1", "## user 2", "## nowhere"]
_FOUND = f"""{_TRANSCRIPTS}, hs AS (SELECT {_HEADS!r} AS hs),
r AS (SELECT doc_id, t AS rest, CAST([] AS STRUCT(title VARCHAR, body VARCHAR)[]) AS out, 0 AS i FROM md
UNION ALL SELECT doc_id, CASE WHEN place > 0 THEN substr(rest, CAST(until AS INTEGER)) ELSE rest END,
    CASE WHEN place > 0 THEN list_append(CASE WHEN place = 1 THEN out WHEN len(out) = 0 THEN [{{'title': '', 'body': left(rest, CAST(place - 1 AS INTEGER))}}] ELSE list_append(out[:len(out) - 1], {{'title': out[len(out)].title, 'body': out[len(out)].body || left(rest, CAST(place - 1 AS INTEGER))}}) END,
        {{'title': h, 'body': substr(rest, CAST(place + length(h) AS INTEGER), CAST(until - place - length(h) AS INTEGER))}}) ELSE out END, i + 1
    FROM (SELECT *, place + length(h) - 1 + coalesce(list_min(list_filter(list_transform(list_filter(hs, lambda x: x <> h), lambda x: strpos(substr(rest, CAST(place + length(h) AS INTEGER)), x)), lambda p: p > 0)), length(rest) - place - length(h) + 2) AS until
        FROM (SELECT r.*, hs, hs[i + 1] AS h, strpos(rest, hs[i + 1]) AS place FROM r, hs WHERE i < len(hs)))),
sec AS (SELECT doc_id, unnest(o).title AS title, unnest(o).body AS body, generate_subscripts(o, 1) AS pos FROM (SELECT doc_id, CASE WHEN rest = '' THEN out WHEN len(out) = 0 THEN [{{'title': '', 'body': rest}}] ELSE list_append(out[:len(out) - 1], {{'title': out[len(out)].title, 'body': out[len(out)].body || rest}}) END AS o FROM r WHERE i = {len(_HEADS)}))"""


@query(_packed(_FOUND, 700, 60, False))
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.exploded(transcripts(spark, sf), S.semantic_chunks(F.col("text"), F.array(*map(F.lit, _HEADS)), 700, 60), "doc_id")


_TURNS = PACK.replace("replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents", "coalesce(text, '') AS t FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")


@query(
    _TURNS.format(size=150, overlap=20, where="WHERE length(t) > 150")
    + """, x AS (SELECT doc_id, chunk_index, content, start, "end", tokens FROM c UNION ALL SELECT doc_id, 0, t, 0, length(t), CAST(length(t) // 4 AS BIGINT) FROM p WHERE length(t) BETWEEN 1 AND 150)
SELECT doc_id // 1000 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, chunk_index) - 1 AS INTEGER) AS chunk_index, CAST(dense_rank() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS INTEGER) AS page, content, start, "end", tokens FROM x"""
)
def slide_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns as slides: one chunk each, several for a long one."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    pages = table(spark, sf, "conversations").where("length(text) > 0").groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("pages"))
    return C.exploded(pages, S.page_chunks(F.col("pages"), 150, 20), "doc_id")
