"""Cleaning, metadata and scalar text functions over the documents, pages, benchmark and events tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table


def _noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with control characters, odd white space and repeated lines."""
    t = F.concat(F.lit("\r\n  "), F.replace(F.col("text"), F.lit(" "), F.lit("  \t ")), F.lit("\x0c\n \n\n\n"), F.substring("text", 1, 40), F.lit("\x01 "))
    return table(spark, sf, "documents").select("doc_id", t.alias("t"))


_N = "n AS (SELECT doc_id, concat(chr(13) || chr(10) || '  ', replace(text, ' ', '  ' || chr(9) || ' '), chr(12) || chr(10) || ' ' || chr(10) || chr(10) || chr(10), substr(text, 1, 40), chr(1) || ' ') AS t FROM documents)"
_CONTROLS = r"regexp_replace(replace({0}, chr(13), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
_ARTIFACTS = r"regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, chr(12), ''), chr(65279), ''), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\t *', ' ', 'g')"
_SPACE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t\x0B\f]+\n', chr(10), 'g'), '[ \t\x0B\f]+$', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


@query(f"WITH {_N} SELECT doc_id, {_CONTROLS.format('t')} AS out FROM n")
def clean_controls(spark: SparkSession, sf: str) -> DataFrame:
    return _noisy(spark, sf).select("doc_id", T.strip_controls(F.col("t")).alias("out"))


@query(f"WITH {_N} SELECT doc_id, {_ARTIFACTS.format('t')} AS out FROM n")
def clean_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return _noisy(spark, sf).select("doc_id", T.strip_artifacts(F.col("t")).alias("out"))


@query(f"WITH {_N} SELECT doc_id, {_SPACE.format('t')} AS out FROM n")
def clean_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return _noisy(spark, sf).select("doc_id", T.normalize_whitespace(F.col("t")).alias("out"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter(string_split(text || chr(10) || 'Page 3 of 9' || chr(10) || doc_id, chr(10)),
    lambda x: NOT regexp_matches(x, '(?i)Page \d+ of \d+|^\d+$|Copyright ©? \d{4}|All rights reserved|Confidential|\[Date\]|\[Page \d+\]')), chr(10)) AS out FROM documents"""
)
def clean_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.lit("\nPage 3 of 9\n"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.drop_boilerplate(t).alias("out"))


_DEDUPE = r"""l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split({0}, chr(10)) AS ls FROM {1})),
k AS (SELECT *, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS key FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS r FROM k),
u AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key = '' OR r = 1), '') AS d FROM f GROUP BY doc_id)"""


@query(f"WITH {_DEDUPE.format('text', 'documents')} SELECT doc_id, d AS out FROM u")
def clean_duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.dedupe_lines(F.col("text")).alias("out"))


@query(f"WITH {_N}, c AS (SELECT doc_id, {_SPACE.format(_ARTIFACTS.format(_CONTROLS.format('t')))} AS t FROM n), {_DEDUPE.format('t', 'c')}" + r" SELECT doc_id, regexp_replace(d, '^\s+|\s+$', '', 'g') || chr(10) AS out FROM u")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _noisy(spark, sf).select("doc_id", T.clean(F.col("t")).alias("out"))


@query()
def repair_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.repair_encoding(F.col("text")).alias("out"))


@query(r"SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS word_count FROM documents")
def document_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("char_count"), T.word_count(t).cast("long").alias("word_count"))


@query()
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", T.language(F.col("text")).alias("detected"))


_TITLE = r"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# ' || lang || ' ' || doc_id || chr(10) WHEN 1 THEN '  ' || source || chr(10) || '=====' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 2 THEN 'SHORT TITLE ' || doc_id || chr(10) ELSE '' END || text AS t FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS raw FROM (SELECT doc_id, string_split(t, chr(10))[1:20] AS ls FROM d)),
s AS (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, lead(regexp_replace(raw, '^\s+|\s+$', '', 'g')) OVER (PARTITION BY doc_id ORDER BY i) AS under FROM l),
c AS (SELECT doc_id, i, CASE WHEN starts_with(line, '# ') THEN regexp_replace(substr(line, 3), '^\s+|\s+$', '', 'g')
    WHEN line <> '' AND (regexp_matches(coalesce(under, ''), '^=+$') OR (length(line) < 100 AND upper(line) = line AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}')
    AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) <= 10)) THEN line END AS t FROM s)
SELECT doc_id, arg_min(t, i) FILTER (WHERE t IS NOT NULL) AS title FROM c GROUP BY doc_id"""


@query(_TITLE)
def extract_title(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), "source", F.lit("\n=====\n"))).otherwise("")
    caps = F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("SHORT TITLE "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", T.title(F.concat(head, caps, "text")).alias("title"))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND length(x) < 200)[1] AS title FROM documents""")
def first_line_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.first_short_line(F.col("text")).alias("title"))


@query(
    r"""WITH d AS (SELECT doc_id, '---' || chr(10) || 'title: T' || doc_id || chr(10) || 'author:  ' || source || chr(10) || '---' || chr(10) || '# H' || doc_id || chr(10) || text AS t FROM documents)
SELECT doc_id, 'T' || doc_id AS title, source AS author, 'H' || doc_id AS heading, CAST(length(substr(t, strpos(t, '# H'))) AS BIGINT) AS body_chars FROM d JOIN documents USING (doc_id)"""
)
def markdown_metadata(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("---\ntitle: T"), i, F.lit("\nauthor:  "), "source", F.lit("\n---\n# H"), i, F.lit("\n"), "text")
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    c = F.col("t")
    return d.select("doc_id", T.front_matter(c, "title").alias("title"), T.front_matter(c, "author").alias("author"), F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1).alias("heading"), F.length(T.without_front_matter(c)).cast("long").alias("body_chars"))


@query(
    r"""WITH t AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM documents),
w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), lambda x: length(x) > 2)) AS term FROM t)
SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term"""
)
def search_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(T.search_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


_STOPS = "'what','when','where','which','who','whom','whose','why','how','that','this','these','those','with','from','they','have','were','been','said','each','will','about','could','would','should','there'"


@query(rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{4,}}') AND lower(w) NOT IN ({_STOPS}))))[1:10], ' ') AS keywords FROM benchmark")
def query_keywords(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.routing import keywords

    return table(spark, sf, "benchmark").select("item_id", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


@query(
    r"""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) ELSE 0.0 END AS similarity
FROM b a JOIN b b ON a.item_id < b.item_id"""
)
def word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("tb")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", T.jaccard(F.col("ta"), F.col("tb")).alias("similarity"))


@query(
    r"""SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"""
)
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('see [' || user_id || '] and [' || (event_id % 7) || '][' || (event_id % 7) || '] not [x]', '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))), ',') AS cited FROM events""")
def cited_numbers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.format_string("see [%d] and [%d][%d] not [x]", "user_id", F.col("event_id") % 7, F.col("event_id") % 7)
    return table(spark, sf, "events").select("event_id", F.array_join(T.cited_numbers(t).cast("array<string>"), ",").alias("cited"))


@query(
    r"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Score: ' || (user_id % 15) || '.5 of 10' WHEN 1 THEN 'no number' WHEN 2 THEN 'relevance HIGH' ELSE 'Low' END AS t FROM events)
SELECT event_id, coalesce(greatest(0.0::DOUBLE, least(10.0::DOUBLE, CAST(nullif(regexp_extract(t, '\d+\.?\d*'), '') AS DOUBLE))), 5.0::DOUBLE) AS numeric,
    CAST(CASE WHEN upper(t) LIKE '%HIGH%' THEN 8 WHEN upper(t) LIKE '%MEDIUM%' THEN 5 WHEN upper(t) LIKE '%LOW%' THEN 2 ELSE 5 END AS DOUBLE) AS categorical FROM r"""
)
def parse_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id") % 4
    t = F.when(e == 0, F.concat(F.lit("Score: "), (F.col("user_id") % 15).cast("string"), F.lit(".5 of 10"))).when(e == 1, "no number").when(e == 2, "relevance HIGH").otherwise("Low")
    return table(spark, sf, "events").select("event_id", T.numeric_score(t).alias("numeric"), T.categorical_score(t).alias("categorical"))


@query(
    r"""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x' || chr(10) || 'final_answer = "v' || user_id || '"' || chr(10) || 'end' WHEN 1 THEN 'a' || chr(10) || '  last ' || user_id || '  ' || chr(10) || chr(10) ELSE '' END AS t FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN regexp_extract(t, 'final_answer = "([^"]*)"', 1) WHEN 1 THEN trim(string_split(t, chr(10))[2]) ELSE '' END AS answer FROM r"""
)
def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id").cast("string"), F.col("event_id") % 3
    t = F.when(e == 0, F.concat(F.lit('x\nfinal_answer = "v'), u, F.lit('"\nend'))).when(e == 1, F.concat(F.lit("a\n  last "), u, F.lit("  \n\n"))).otherwise("")
    return table(spark, sf, "events").select("event_id", T.final_answer(t).alias("answer"))


@query(r"""SELECT item_id, sha256('gpt-4o-mini|0.7|1000|sys|' || text) AS response_key, sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) || '|' || lower(regexp_replace(substr(text || text, 1, 1000), '^\s+|\s+$', '', 'g'))) AS session_key FROM benchmark""")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", T.cache_key(*map(F.lit, ("gpt-4o-mini", "0.7", "1000", "sys")), t).alias("response_key"), T.session_cache_key(t, F.concat(t, t)).alias("session_key"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview, left(regexp_replace(source || ' ' || lang || '/é.txt', '[^A-Za-z0-9._-]', '_', 'g'), 255) AS file_name, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(CASE WHEN length(text) > 0 THEN length(text) // 4 + 1 ELSE 0 END AS BIGINT) AS session_tokens FROM documents")
def previews_and_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.preview(t).alias("preview"), T.file_name(F.concat("source", F.lit(" "), "lang", F.lit("/é.txt"))).alias("file_name"), T.estimated_tokens(t).alias("tokens"), T.session_tokens(t).alias("session_tokens"))


@query(
    r"""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'import os; os.system(1)' WHEN 1 THEN 'from math import *' WHEN 2 THEN 'print(1)' ELSE 'eval(x); open(y)' END AS code FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'import os.system' WHEN 1 THEN 'wildcard import' WHEN 2 THEN '' ELSE 'builtin eval,builtin open' END AS warnings FROM c"""
)
def code_safety(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id") % 4
    code = F.when(e == 0, "import os; os.system(1)").when(e == 1, "from math import *").when(e == 2, "print(1)").otherwise("eval(x); open(y)")
    return table(spark, sf, "events").select("event_id", F.array_join(T.code_warnings(code), ",").alias("warnings"))


@query("SELECT p_partkey, CAST(CAST(p_size AS BIGINT) * CASE p_size % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END AS BIGINT) AS bytes FROM part")
def parse_memory(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("k"), F.lit("m"), F.lit("g"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.memory_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("SELECT event_id, CASE WHEN v < 1000 THEN printf('%.0fms', v) WHEN v < 60000 THEN printf('%.1fs', v / 1000) ELSE printf('%.1fm', v / 60000) END AS label FROM (SELECT event_id, CAST(event_id % 200000 AS DOUBLE) + 0.25 AS v FROM events)")
def format_durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.duration((F.col("event_id") % 200000).cast("double") + 0.25).alias("label"))
