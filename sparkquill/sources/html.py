"""HTML to text: natively for well-behaved pages, and by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import strip

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _unescape(text: Column) -> Column:
    for e, c in ENTITIES.items():
        text = F.replace(text, F.lit(e), F.lit(c))
    return text


def title(html: Column) -> Column:
    return F.nullif(strip(_unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(_unescape(F.regexp_extract(html, rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"', 1)), F.lit(""))


def headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return F.filter(F.transform(found, lambda h: strip(_unescape(F.regexp_replace(h, "<[^>]*>", "")))), lambda h: h != "")


def text(html: Column) -> Column:
    """Scripts, styles, comments and tags go; lines are trimmed and cut at double spaces; empty ones go."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    out = _unescape(F.regexp_replace(out, "(?s)<[^>]*>", "\n"))
    parts = F.flatten(F.transform(F.split(out, "\n"), lambda x: F.split(strip(x), "  ")))
    return F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), "\n")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.off = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.off += tag in ("script", "style")
        self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.off -= tag in ("script", "style") and self.off > 0
        self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.out.append(data)


def _read(html: str | None) -> str | None:
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    parts = (p.strip() for line in "".join(reader.out).split("\n") for p in line.strip().split("  "))
    return "\n".join(p for p in parts if p)


def parsed_text(html: Column) -> Column:
    """As `text`, by a real parser (Arrow batches)."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(_read)

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(html)
