"""Ranked search and periodic runs against brute force; their SQL runs in test_registered."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, LONG, edge_docs, no_docs

from sparkquill.llm import lexical, tandem

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(t):
    return TERM.findall((t or "").translate(LOWER))


def _ranked(docs, items, k, repeats=False):
    bags = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 50 + (50 * bag.total() * n) // total
            want = Counter(_terms(text))
            s = sum((x if repeats else 1) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t, x in want.items() if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _rows(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=repr)


ITEMS = [(1, "the quick BROWN fox, fox!"), (2, None), (3, "..."), (4, "é one w1 w2 w3999 Über"), (4, "é one w1 w2 w3999 Über"), (5, "nowhere to be found"), (None, "dog"), (6, "ключ 全角 0x1")]


def test_search_like_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    some = random.Random(5)
    docs = [(i, " ".join(some.choices("the quick brown fox é one w1 ключ 全角 dog Dog DOG x-y_z".split(), k=some.randint(0, 9)))) for i in range(300)]
    docs += [(300 + i, "dog fox") for i in range(80)] + [(d, t) for d, t, *_ in DOCS] + [(999, LONG * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k, repeats in ((50, False), (3, True)):
        want = _ranked(docs, ITEMS, k, repeats)
        assert _rows(lexical.search(frame, items, k, repeats)) == want
    monkeypatch.setattr(lexical, "ITEM_TERMS", 3)  # many blocks of items
    assert _rows(lexical.search(frame, items.repartition(4), 50)) == _ranked(docs, ITEMS, 50)


def test_search_edge_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = _rows(lexical.search(edge_docs(spark), items.selectExpr("item_id", "text", "'x' as score", "1 as rank")))
    assert got == _ranked([(d, t) for d, t, *_ in DOCS], ITEMS, 50)
    assert lexical.search(no_docs(spark), items).count() == 0
    assert lexical.search(edge_docs(spark), items.where("false")).count() == 0


def test_impacts_beyond_64_bits():
    n, total = 10**10, 10**13
    assert lexical.impacts(np.array([7]), np.array([10**9]), n, total).tolist() == [7 * 10**9 // (7000 + 20 * (50 + 50 * 10**9 * n // total))]


# ----------------------------------------------------------------------------------------------- runs


def _runs(w, least):
    """By definition: for each period the stretches, then the smallest period of each."""
    found, number = {}, np.unique(np.array([*w, ""]), return_inverse=True)[1][:-1]
    for q in range(1, len(w) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], number[:-q] == number[q:], [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _whole(text, least):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    runs = _runs(w, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(runs), *best, runs, " ".join(x for i, x in enumerate(w) if i not in gone))


def _got(r):
    return (r["n_runs"], r["start"], r["length"], r["period"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_like_brute_force(spark, least):
    some = random.Random(least)
    rows = [(None, None), (0, ""), (1, " \n ")]
    for i in range(2, 700):
        kind = i % 4
        words = some.choices("ab" if kind == 0 else "abcd", k=some.randint(0, 60))
        if kind == 2:
            p = some.randint(1, 9)
            words = words[:20] + some.choices("abcdefgh", k=p) * some.randint(2, 8) + words[20:]
        if kind == 3:  # a Fibonacci word holds very many runs
            a, b = "a", "ab"
            while len(b) < 20 * (i % 9):
                a, b = b, b + a
            words = list(b)
        rows.append((i, some.choice([" ", "\n", " \t "]).join(words)))
    out = tandem.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least)
    got = {r["doc_id"]: _got(r) for r in out.collect()}
    assert got == {i: _whole(t, least) for i, t in rows}


def test_runs_edge_cases(spark):
    got = [_got(r) for r in tandem.periodic_runs(edge_docs(spark)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(_whole(t, 12)) for _, t, *_ in DOCS)
    assert tandem.periodic_runs(no_docs(spark)).count() == 0


def test_long_repetition_ends(spark):
    rows = [(1, "ha " * 400_000), (2, "x " + "ha ho " * 200_000 + "y"), (3, ("a " * 500 + "b ") * 300)]
    began = time.time()
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) for r in tandem.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, 0, 400_000, 1, "ha") and got[2] == (1, 1, 400_000, 2, "x ha ho y")
    assert got[3][:4] == (301, 0, 150_300, 501) and time.time() - began < 60
