"""Readers and detection on small files."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from sparkquill.sources import detect, html, readers, stores


def _zip(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c/></row></sheetData></worksheet>'})
PPTX = _zip({"ppt/slides/slide1.xml": '<sld xmlns:a="u"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></sld>', "ppt/slides/slide2.xml": '<sld xmlns:a="u"><a:p><a:r><a:t>Yo</a:t></a:r></a:p></sld>'})


def _tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in (("a.txt", b"A"), ("b.png", b"\x89PNG"), ("c.bin", b"\xff\xfe")):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    return out.getvalue()


def test_read_every_format(spark, tmp_path):
    files = {
        "a.txt": "héllo".encode(),
        "latin.txt": "caf\xe9".encode("latin-1"),
        "b.json": json.dumps({"k": 1, "l": [1, {"m": "x"}]}).encode(),
        "c.xml": b'<?xml version="1.0"?><r a="1"><s>t</s></r>',
        "d.csv": b"h1,h2\n1,2\n",
        "e.docx": DOCX,
        "f.xlsx": XLSX,
        "g.pptx": PPTX,
        "h.zip": _zip({"x.txt": "in", "y.exe": b"\0"}),
        "i.tar": _tar(),
        "j.html": b"<html><title>T &amp; U</title><body><script>var a='</p>'</script><p>x  y</p></body></html>",
        "k.py": b"print(1)",
        "bad.json": b"%PDF-1.4",
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    found = detect.detect(readers.files(spark, str(tmp_path)), prefer_extension=True)
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.read(found).collect()}
    text = {k: v["text"] for k, v in got.items()}
    assert text["a.txt"] == "héllo" and text["latin.txt"] == "café"
    assert text["b.json"] == "k: 1\nl:\n  [0]: 1\n  [1]:\n    m: x"
    assert text["c.xml"] == "r (a=1)\n  s: t"
    assert text["d.csv"] == "Headers: h1 | h2\n\n1 | 2"
    assert text["e.docx"] == "One\n\n[TABLE]\na | b"
    assert text["f.xlsx"] == "[SHEET: S]\nx | 2"
    assert text["g.pptx"] == "[SLIDE 1]\nHi\n\n[SLIDE 2]\nYo"
    assert text["h.zip"] == "[ARCHIVE CONTENTS]\n\n--- x.txt ---\nin"
    assert "--- a.txt ---\nA" in text["i.tar"] and "c.bin" not in text["i.tar"]
    assert text["j.html"] == "T & U\nx\ny"
    assert text["k.py"] == "[Python CODE]\n\nprint(1)"
    assert text["bad.json"] is None and got["bad.json"]["error"]


def test_content_beats_extension(spark):
    d = spark.createDataFrame([("x.txt", b"%PDF-1"), ("y.docx", b"PK\x03\x04"), ("z.dat", b"a: 1\nb: 2"), ("n", b"\0\1"), ("q.csv", b"")], "path string, content binary")
    assert [r["format"] for r in detect.detect(d).collect()][:4] == ["pdf", "docx", "yaml", "unknown"]


def test_html_functions(spark):
    page = '<html><head><title> A </title><meta name="author" content="Me &amp; You"></head><h1>H <b>x</b></h1><h4>no</h4></html>'
    r = spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h")), html.meta(F.col("h"), "author"), html.headings(F.col("h"))).first()
    assert list(r) == ["A", "Me & You", ["H x"]]


def test_registry_priorities():
    r = readers.default_registry()
    r.register("better", ["csv"], lambda b: "B", priority=200)
    assert r.get("csv")(b"") == "B" and r.get("csv", "csv") is readers.csv_text
    r.unregister("better")
    assert r.get("csv") is readers.csv_text and not r.supports("pdf") and "docx" in r.names()


def test_store_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string")
    stores.save(d, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in stores.upserted(back, spark.createDataFrame([(2, "c")], "doc_id long, v string"), ["doc_id"]).collect()} == {(1, "a"), (2, "c")}
    assert stores.without(back, d.where("doc_id = 1")).count() == 1
