"""Format detection by extension and content, as column expressions over (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extension -> format.
EXTENSIONS = {
    "txt": "txt", "md": "md", "markdown": "md", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "html": "html", "htm": "html", "xml": "xml",
    "csv": "csv", "json": "json", "yaml": "yaml", "yml": "yaml", "zip": "zip", "tar": "tar", "gz": "gz", "py": "py", "js": "js", "ts": "ts", "java": "java",
    "cpp": "cpp", "c": "c", "go": "go", "rs": "rs", "rb": "rb", "php": "php", "ipynb": "ipynb",
}
# Format -> MIME type.
MIME = {
    "txt": "text/plain", "md": "text/x-markdown", "pdf": "application/pdf", "docx": "application/msword", "xlsx": "application/vnd.ms-excel", "pptx": "application/vnd.ms-powerpoint",
    "html": "application/xhtml+xml", "xml": "text/xml", "csv": "text/csv", "json": "application/json", "yaml": "text/yaml", "zip": "application/zip", "tar": "application/x-tar",
    "gz": "application/x-gzip", "ipynb": "application/x-ipynb+json",
}
#: Leading bytes (hex) -> format.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "1F8B": "gz"}
OFFICE = ["docx", "xlsx", "pptx"]
#: What an upload may be.
UPLOAD_LIMIT = 100 * 1024 * 1024
UPLOADS = ["txt", "md", "pdf", "docx", "xlsx", "pptx", "html", "csv", "json", "xml", "zip", "tar"]
CODE_NAMES = {"py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "cpp": "C++", "c": "C", "go": "Go", "rs": "Rust", "rb": "Ruby", "php": "PHP"}


def _lookup(value: Column, table: dict[str, str], default: str | None) -> Column:
    """A literal map; null keys give the default."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, value), F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def by_extension(path: Column) -> Column:
    return _lookup(extension(path), EXTENSIONS, "unknown")


def is_text(content: Column) -> Column:
    """No NUL byte (any bytes decode as Latin-1)."""
    return ~F.rlike(F.hex(content), F.lit("^(?:..)*?00"))


def text_format(path: Column, head: Column) -> Column:
    """The first that fits of JSON, XML, HTML, YAML, Markdown, CSV; else plain text. head: the first 4,096 characters."""
    ext, top = extension(path), F.lower(F.substring(head, 1, 100))
    lines = F.filter(F.slice(F.split(head, "\n"), 1, 3), lambda x: F.trim(x) != "")
    csv = F.contains(head, F.lit(",")) & F.contains(head, F.lit("\n")) & F.forall(lines, lambda x: F.contains(x, F.lit(",")))
    return (
        F.when(F.try_parse_json(F.trim(head)).isNotNull() & F.rlike(head, F.lit(r"^\s*[\[{\"0-9tfn-]")), "json")
        .when(F.contains(top, F.lit("<?xml")), "xml")
        .when(F.contains(top, F.lit("<html")), "html")
        .when(ext.isin("yaml", "yml") | (F.contains(head, F.lit(": ")) & F.contains(head, F.lit("\n"))), "yaml")
        .when(ext.isin("md", "markdown") | F.contains(head, F.lit("# ")) | F.contains(head, F.lit("```")), "md")
        .when(csv, "csv")
        .otherwise("txt")
    )


def by_content(path: Column, content: Column) -> Column:
    out = F.when(is_text(F.substring(content, 1, 4096)), text_format(path, decoded(F.substring(content, 1, 4096))))
    for magic, fmt in MAGIC.items():
        out = F.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(magic)), fmt).otherwise(out)
    return out


def decoded(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def detect(files: DataFrame, prefer_extension: bool = False) -> DataFrame:
    """Adds format and mime to (path, content, ...): content wins where it is known, but ZIP content keeps an office extension."""
    e, c = by_extension(F.col("path")), by_content(F.col("path"), F.col("content"))
    content_wins = F.when(c.isNull() | ((c == "zip") & e.isin(OFFICE)), e).otherwise(c)
    fmt = F.when(e != "unknown", e).otherwise(content_wins) if prefer_extension else content_wins
    return files.withColumn("format", fmt).withColumn("mime", _lookup(F.col("format"), MIME, "application/octet-stream"))


def mime_of(fmt: Column) -> Column:
    return _lookup(fmt, MIME, "application/octet-stream")


def upload_reason(path: Column, size: Column) -> Column:
    """Null if the file may be uploaded, else why not."""
    return F.when(size > UPLOAD_LIMIT, "too large").when(~extension(path).isin(UPLOADS), "unsupported type")
