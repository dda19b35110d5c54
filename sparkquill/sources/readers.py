"""Readers: (path, content) -> (path, text, error), by format. A file that can't be read gives an error, not a failed job."""

from __future__ import annotations

import csv
import io
import json
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_front_matter
from . import detect, html

#: Members of archives with these suffixes hold no text.
BINARY_MEMBERS = (".png", ".jpg", ".jpeg", ".gif", ".exe", ".dll", ".so")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, modificationTime of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


# ----------------------------------------------------------------------------- native (column) readers


def csv_rows(df: DataFrame) -> DataFrame:
    """One text line a row, cells joined by ` | `; of a DataFrame that spark.read.csv gives. Null cells are empty."""
    return df.select(F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def code_text(text: Column, ext: Column) -> Column:
    names = F.create_map(*[x for k, v in detect.CODE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.lit("["), F.coalesce(F.try_element_at(names, ext), F.lit("Unknown")), F.lit(" CODE]\n\n"), text)


# ---------------------------------------------------------------------------------- per-file readers


def json_text(data: bytes) -> str:
    def lines(value, depth: int) -> Iterator[str]:
        pad = "  " * depth
        items = value.items() if isinstance(value, dict) else ((f"[{i}]", v) for i, v in enumerate(value)) if isinstance(value, list) else None
        if items is None:
            yield f"{pad}{value}"
            return
        for k, v in items:
            if isinstance(v, (dict, list)):
                yield f"{pad}{k}:"
                yield from lines(v, depth + 1)
            else:
                yield f"{pad}{k}: {v}"

    return "\n".join(lines(json.loads(data), 0))


def xml_text(data: bytes) -> str:
    def lines(e: ET.Element, depth: int) -> Iterator[str]:
        attrs = f" ({', '.join(f'{k}={v}' for k, v in e.attrib.items())})" if e.attrib else ""
        said = (e.text or "").strip()
        yield f"{'  ' * depth}{e.tag}{attrs}" + (f": {said}" if said else "")
        for child in e:
            yield from lines(child, depth + 1)

    return "\n".join(lines(ET.fromstring(data), 0))


def csv_text(data: bytes) -> str:
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "replace"))))
    return "Headers: " + " | ".join(rows[0]) + "\n\n" + "\n".join(" | ".join(r) for r in rows[1:]) if rows else ""


def _xml_in(archive: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(archive.read(name))


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(e: ET.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then tables: [TABLE] and rows joined by ` | `."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _xml_in(z, "word/document.xml") if _local(e) == "body")
    out = [t for e in body if _local(e) == "p" and (t := _said(e)).strip()]
    for e in body:
        if _local(e) == "tbl":
            out.append("[TABLE]\n" + "\n".join(" | ".join(_said(c).strip() for c in row if _local(c) == "tc") for row in e if _local(row) == "tr"))
    return "\n\n".join(out)


def xlsx_text(data: bytes) -> str:
    """[SHEET: name] and rows of cells that have a value, joined by ` | `."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_said(e) for e in _xml_in(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [e.get("name") for e in _xml_in(z, "xl/workbook.xml").iter() if _local(e) == "sheet"]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for name, path in zip(names, sheets, strict=False):
            rows = []
            for row in (e for e in _xml_in(z, path).iter() if _local(e) == "row"):
                cells = []
                for c in row:
                    v = next((x.text for x in c if _local(x) == "v"), None)
                    v = shared[int(v)] if v is not None and c.get("t") == "s" else _said(c) if c.get("t") == "inlineStr" else v
                    if v not in (None, ""):
                        cells.append(v)
                if cells:
                    rows.append(" | ".join(cells))
            if rows:
                out.append(f"[SHEET: {name}]\n" + "\n".join(rows))
    return "\n\n".join(out)


def pptx_slides(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return [f"[SLIDE {i}]\n" + "\n".join(t for p in _xml_in(z, n).iter() if _local(p) == "p" and (t := _said(p)).strip()) for i, n in enumerate(slides, 1)]


def archive_members(data: bytes, fmt: str) -> Iterator[tuple[str, str]]:
    """(name, text) of the members that are UTF-8 text."""
    if fmt == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.lower().endswith(BINARY_MEMBERS)]
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and not m.name.lower().endswith(BINARY_MEMBERS)]
    for name, raw in found:
        try:
            yield name, raw.decode("utf-8")
        except UnicodeDecodeError:
            continue


def archive_text(data: bytes, fmt: str) -> str:
    return "[ARCHIVE CONTENTS]\n\n" + "\n\n".join(f"--- {n} ---\n{t}" for n, t in archive_members(data, fmt))


READERS: dict[str, Callable[[bytes], str]] = {
    "json": json_text,
    "ipynb": json_text,
    "xml": xml_text,
    "csv": csv_text,
    "docx": docx_text,
    "xlsx": xlsx_text,
    "pptx": lambda d: "\n\n".join(pptx_slides(d)),
    "zip": lambda d: archive_text(d, "zip"),
    "tar": lambda d: archive_text(d, "tar"),
    "gz": lambda d: archive_text(d, "gz"),
}


class Registry:
    """Readers by format, highest priority first; a preferred name overrides."""

    def __init__(self) -> None:
        self._by_format: dict[str, list[tuple[int, str, Callable[[bytes], str]]]] = {}

    def register(self, name: str, formats: list[str], reader: Callable[[bytes], str], priority: int = 100) -> None:
        for f in formats:
            self._by_format.setdefault(f, []).append((priority, name, reader))
            self._by_format[f].sort(key=lambda x: -x[0])

    def unregister(self, name: str) -> None:
        self._by_format = {f: [x for x in xs if x[1] != name] for f, xs in self._by_format.items()}

    def get(self, fmt: str, preferred: str | None = None) -> Callable[[bytes], str] | None:
        found = self._by_format.get(fmt, [])
        return next((r for _, n, r in found if n == preferred), found[0][2] if found else None)

    def names(self) -> list[str]:
        return sorted({n for xs in self._by_format.values() for _, n, _ in xs})

    def supports(self, fmt: str) -> bool:
        return bool(self._by_format.get(fmt))


def default_registry() -> Registry:
    out = Registry()
    for fmt, reader in READERS.items():
        out.register(fmt, [fmt], reader)
    return out


def read(detected: DataFrame, registry: Registry | None = None, preferred: dict[str, str] | None = None) -> DataFrame:
    """(path, format, text, error) of detected files. Text, Markdown (without its front matter), HTML, YAML and code are read by column functions."""
    registry, preferred = registry or default_registry(), preferred or {}
    code = list(detect.CODE_NAMES)
    plain = ["txt", "md", "yaml", "html", *code]
    t = detect.decoded(F.col("content"))
    text = F.when(F.col("format") == "html", html.text(t)).when(F.col("format").isin(code), code_text(t, F.col("format"))).otherwise(t)
    native = detected.where(F.col("format").isin(plain)).select("path", "format", text.alias("text"), F.lit(None).cast("string").alias("error"))
    readers = {f: registry.get(f, preferred.get(f)) for f in {*EXT_FORMATS, "unknown"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for fmt, data in zip(batch.column("format").to_pylist(), batch.column("content"), strict=True):
                reader = readers.get(fmt)
                try:
                    texts.append(reader(data.as_py()) if reader else None)
                    errors.append(None if reader else f"no reader for {fmt}")
                except Exception as e:  # one broken file is that file's error
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("format"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "format", "text", "error"])

    rest = detected.where(~F.col("format").isin(plain)).select("path", "format", "content").mapInArrow(run, "path string, format string, text string, error string")
    return native.unionByName(rest)


EXT_FORMATS = set(detect.EXTENSIONS.values())
