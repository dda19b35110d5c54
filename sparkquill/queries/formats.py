"""Detection, readers and stores over files made of table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import detect, html, readers, stores

_EXT = ["txt", "MD", "pdf", "docx", "html", "csv", "json", "yml", "zip", "tar.gz", "py", "rs", "ipynb", "xyz", "markdown", "htm"]
_FILES = "f AS (SELECT event_id, 'dir.v1/name' || event_id || '.' || [{}][event_id % 16 + 1] AS path, event_id % 7 AS kind, user_id FROM events)".format(", ".join(f"'{e}'" for e in _EXT))


def named(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("event_id") % 16 + 1).cast("int"))
    path = F.concat(F.lit("dir.v1/name"), F.col("event_id").cast("string"), F.lit("."), ext)
    k = F.col("event_id") % 7
    u = F.col("user_id").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit('{"a": ['), u, F.lit("]}")))
        .when(k == 1, "<?xml version='1.0'?><a/>")
        .when(k == 2, "<!doctype html><HTML><body>x</body></HTML>")
        .when(k == 3, F.concat(F.lit("# Head "), u))
        .when(k == 4, "a,b\n1,2\n3,4\n")
        .when(k == 5, "plain words only")
        .otherwise("%PDF-1.4 x")
    )
    return table(spark, sf, "events").select("event_id", path.alias("path"), F.encode(body, "UTF-8").alias("content"))


_BY_EXT = "CASE regexp_extract(lower(path), '\\.([^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.EXTENSIONS.items()) + " ELSE 'unknown' END"
_MIME = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.MIME.items()) + " ELSE 'application/octet-stream' END"


@query(f"WITH {_FILES} SELECT event_id, {_BY_EXT} AS format, {_MIME.format(_BY_EXT)} AS mime FROM f")
def format_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    e = detect.by_extension(F.col("path"))
    return named(spark, sf).select("event_id", e.alias("format"), detect.mime_of(e).alias("mime"))


@query(
    f"""WITH {_FILES}, c AS (SELECT event_id, CASE kind WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'html' WHEN 6 THEN 'pdf'
    ELSE CASE WHEN regexp_matches(lower(path), '\\.ya?ml$') THEN 'yaml' WHEN kind = 3 OR regexp_matches(lower(path), '\\.(md|markdown)$') THEN 'md' WHEN kind = 4 THEN 'csv' ELSE 'txt' END END AS format FROM f)
SELECT event_id, format, {_MIME.format("format")} AS mime FROM c"""
)
def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect(named(spark, sf)).select("event_id", "format", "mime")


@query(f"WITH {_FILES} SELECT event_id, CASE WHEN user_id * 1000000 > 104857600 THEN 'too large' WHEN regexp_extract(lower(path), '\\.([^./]+)$', 1) NOT IN ('txt','md','pdf','docx','xlsx','pptx','html','csv','json','xml','zip','tar') THEN 'unsupported type' END AS reason FROM f")
def upload_guard(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select("event_id", "user_id")
    return named(spark, sf).join(users, "event_id").select("event_id", detect.upload_reason(F.col("path"), F.col("user_id") * 1_000_000).alias("reason"))


@query(r"""SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '') AS title, CAST(len(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)) AS INTEGER) AS n_headings FROM pages""")
def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", html.title(h).alias("title"), F.size(html.headings(h)).alias("n_headings"))


@query(
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g') AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM s),
p AS (SELECT page_id, list_filter(list_transform(flatten(list_transform(string_split(t, chr(10)), lambda x: string_split(regexp_replace(x, '^\s+|\s+$', '', 'g'), '  '))), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM e)
SELECT page_id, array_to_string(ps, chr(10)) AS text FROM p"""
)
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.text(F.col("html")).alias("text"))


@query()
def html_parsed_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.parsed_text(F.col("html")).alias("text"))


@query("SELECT CAST(r_regionkey AS VARCHAR) || ' | ' || coalesce(r_name, '') AS line FROM region")
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return readers.csv_rows(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("SELECT doc_id, '[' || CASE doc_id % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' ELSE 'Unknown' END || ' CODE]' || chr(10) || chr(10) || text AS out FROM documents")
def code_text(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit("py"), F.lit("rs"), F.lit("zz")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", readers.code_text(F.col("text"), ext).alias("out"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(json_extract_string(j, '$.status') AS VARCHAR) AS status, CAST(json_extract(j, '$.price') AS DOUBLE) AS price FROM (SELECT o_orderkey, json_object('status', o_orderstatus, 'price', o_totalprice) AS j FROM orders)")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))).alias("j"))
    v = F.parse_json("j")
    return o.select(F.col("o_orderkey").cast("string").alias("k"), F.variant_get(v, "$.status", "string").alias("status"), F.variant_get(v, "$.price", "double").alias("price"))


@query()
def read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Detection and readers over the named files; broken ones give an error."""
    return readers.read(detect.detect(named(spark, sf))).groupBy("format").agg(F.count("*").alias("files"), F.count("error").alias("errors"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_documents(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return stores.without(table(spark, sf, "documents").select("doc_id", "lang"), bad)


@query("SELECT vec_id AS doc_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return stores.upserted(old, old.where("doc_id % 10 = 0").withColumn("label", F.lit(-1)), ["doc_id"])


@query("SELECT count(*) AS points, CAST(max(len(embedding)) AS INTEGER) AS dimensions, 'cosine' AS metric FROM embeddings")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stores.vector_stats(table(spark, sf, "embeddings"), "embedding")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'failed' ELSE 'pending' END AS status, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' END AS error_message FROM documents")
def update_status(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return stores.with_status(d, table(spark, sf, "labels").where("toxic = 1"), "failed", "toxic")


@query("SELECT doc_id, status FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'completed' ELSE 'failed' END AS status FROM documents) WHERE status = 'completed' ORDER BY doc_id LIMIT 50 OFFSET 20")
def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return stores.listed(d, "completed", 50, 20)
