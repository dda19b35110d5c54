"""Packing: every id in exactly one piece, gapless sequences, little padding, checksums of the true ids."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, edge_docs, no_docs, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkquill.llm import packing
from sparkquill.llm.queries import op11

WORDS = public_tokenizers.path("word_bpe_49k.json")


@cache
def _ids(path, end=2):
    t = Tokenizer.from_file(path)
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")


def _holds(rows, ids, window=4096):
    """rows cut each of the id lists fully, and fill sequences from 0 on; tokens of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert sorted(map(len, ids.values())) and set(by_doc) == set(ids)
    for i, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[i][r["start"] : at].tobytes())
        assert at == len(ids[i])
    padding = 0
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_every_id_in_one_piece(spark, sf):
    ids = {i: _ids(WORDS)(t) for i, t in texts(spark, sf).items()}
    rows = op11(spark, sf).collect()
    assert _holds(rows, ids) < 0.03 * sum(map(len, ids.values()))


def test_edge_cases_and_other_windows_and_tokenizers(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(DOCS)] + [(100, "word " * 30_000), (101, "a" * 40_000), (102, None), (103, "don't STOP\x1cnow Ünï　全角 <|endoftext|>x 12345"), (104, "<|ENDOFTEXT|> <|endoftext|>. a.b, e.g.: no!!!! (so). \"x\". '? 3.14. don't! é. ... , a\u0301. I'LL. <x. 7's, ß; İ! Σας.")]
    rows += [(105 + i, "".join(np.random.default_rng(i).choice(list("aB'1é.,!?<|> \n\u0301Σ”-"), 300))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("part", F.lit(1))
    for path in (WORDS, public_tokenizers.path("byte_bpe_50k.json")):
        ids = {i: _ids(path)(t) for i, t in rows}
        for window in (4096, 100, 1):
            _holds(packing.pack_documents(docs.where("doc_id <> 100") if window == 1 else docs, path, window).collect(), {i: x for i, x in ids.items() if window > 1 or i != 100}, window)
    out = packing.pack_documents(edge_docs(spark), WORDS)
    assert sum(r["length"] for r in out.collect()) == sum(len(_ids(WORDS)(t)) for _, t, *_ in DOCS)
    assert out.where("doc_id = 1").count() == 2 and out.where("doc_id is null").count() == 1
    assert packing.pack_documents(no_docs(spark), WORDS).count() == 0
    with pytest.raises(ValueError, match="window"):
        packing.pack_documents(docs, WORDS, 8192)


def test_special_names_are_never_taken_from_the_cache():
    encode, ids = packing.Encoder(WORDS, 2), _ids(WORDS)
    for text in ("<|endoftext|> a", "<|ENDOFTEXT|> a", "<b> a", "A <|EndOfText|> <|endoftext|>", "<|endoftext|>. <|endoftext|>"):
        flat, first = encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert flat.tolist() == ids(text).tolist() and first.tolist() == [0, len(flat)]


def test_one_length_of_most_pieces_is_cut_not_padded(spark):
    rows = [(i, "word " * 2999) for i in range(60)] + [(1000 + i, "other " * (i % 7)) for i in range(50)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, ids=True).collect()
    ids = {i: _ids(WORDS)(t) for i, t in rows}
    assert _holds(out, ids) < 4096 + 64 * 60
    assert any(r["length"] < r["doc_tokens"] <= 4096 for r in out)
    assert all(bytes(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() for r in out)


def test_least_squares_solves_and_never_goes_negative():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, x = rng.random((12, 30)), np.where(rng.random(30) < 0.2, rng.random(30), 0)
        b = a @ x + rng.normal(0, 0.01, 12)
        got = packing.nnls(a, b)
        assert got.min() >= 0
        gain = a.T @ (b - a @ got)
        assert gain.max() < 1e-6 and np.abs(gain[got > 0]).max(initial=0) < 1e-6  # the conditions of the optimum


def test_combinations_fill_the_grid():
    got = packing.combinations(12, 3)
    brute = {tuple(sorted(c, reverse=True)) for n in (1, 2, 3) for c in __import__("itertools").combinations_with_replacement(range(1, 13), n) if sum(c) == 12}
    assert all(sum(c) == 12 and list(c) == sorted(c, reverse=True) for c in got)
    assert brute <= set(got) and all(len(c) <= 3 or len(set(c)) <= 2 for c in got)


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6 + seed / 4, 1.1, 30_000), 1, 4096).astype(int)
    plan = packing.Plan(dict(Counter(lengths.tolist())), 4096)
    rows = plan.table()[:, 1:]
    assert (rows[:, 2] * rows[:, 4]).sum() == lengths.sum()
    assert plan.sequences * 4096 < 1.01 * lengths.sum()
    filled = np.zeros(plan.sequences, np.int64)
    for _, _, n, _, taken, seq, _ in rows.tolist():
        filled[seq : seq + n] += taken
    assert filled.max() <= 4096
    solved = packing.Plan.__new__(packing.Plan)
    solved._greedy = lambda: None
    solved.__init__(dict(Counter(lengths.tolist())), 4096)
    assert solved.sequences > 0.5 * plan.sequences  # most come from the solution, not from what it leaves


def test_joined_checksums():
    data = bytes(range(256)) * 9
    blocks = [zlib.crc32(data[i : i + 256]) for i in range(0, 2300, 256)]
    assert packing.joined_crc(blocks[2:5], 256, {}) == zlib.crc32(data[512:1280])
    assert packing.joined_crc([*blocks[:3], zlib.crc32(data[768:800])], 32, {}) == zlib.crc32(data[:800])
