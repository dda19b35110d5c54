"""The default embedding against its definition, and the number of trigrams that it hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from sparkquill.plans import models


def _defined(t, dimensions, limit=8000):
    v = np.zeros(dimensions)
    t = f" {' '.join((t or '')[:limit].lower().split())} "
    for i in range(len(t) - 2):
        h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
        v[h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def _run(monkeypatch, texts, dimensions):
    """The function behind the column, on a batch."""
    held = []
    monkeypatch.setattr(models.F, "pandas_udf", lambda run, kind: lambda column: held.append(run))
    models.embed(None, dimensions)
    return held[0](pd.Series(texts, dtype=object))


def test_equals_its_definition(monkeypatch):
    texts = [None, "", " ", "a", "Ab  c\nd", "\U0001f600\U0010ffff\u4e2d x", "\u0130stanbul \u00df", "long words " * 2_000, "\x00\x00\x00"] + [f"text number {i} " * (i % 700) for i in range(300)]
    for dimensions in (32, 7):
        got = _run(monkeypatch, texts, dimensions)
        assert len(got) == len(texts)
        for t, v in zip(texts, got, strict=True):
            np.testing.assert_allclose(v, _defined(t, dimensions), atol=1e-12)
    assert len(_run(monkeypatch, [], 32)) == 0


def test_a_trigram_is_hashed_once_for_many_texts(monkeypatch):
    calls = []
    real = hashlib.blake2b
    monkeypatch.setattr(models.hashlib, "blake2b", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    _run(monkeypatch, ["the same words again"] * 1_000, 32)
    assert len(calls) < 30


def test_as_a_column(spark):
    rows = spark.createDataFrame([(1, "some words"), (2, None)], "id int, text string").select("id", models.embed(models.F.col("text"), 8).alias("e")).orderBy("id").collect()
    np.testing.assert_allclose(rows[0]["e"], _defined("some words", 8), atol=1e-12)
    assert rows[1]["e"] == [0.0] * 8
