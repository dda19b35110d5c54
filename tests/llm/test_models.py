"""Toxicity, language model, mixing, chat formatting, pipeline."""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from helpers import DOCS, edge_docs, labels, no_docs, texts
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquill.llm import chatformat, mixing, pitman_yor, toxicity
from sparkquill.llm.queries import op1, op2

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


# ------------------------------------------------------------------------------------------- toxicity


def test_scores_tell_held_out_labels_apart(spark):
    out = {r["doc_id"]: r for r in op1(spark, "/root/testdata/sf0.1").collect()}
    lab = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (_crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    held = [(out[i]["predicted"], t) for i, t in lab.items() if i in out and _crc(i, 5) == 0]
    hit = [p for p, t in held if t]
    miss = [p for p, t in held if not t]
    assert sum(hit) / len(hit) > 0.9 and sum(miss) / len(miss) < 0.02


def test_cross_validation_looks_at_training_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    turned = lab.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, other = (toxicity.cross_validate(docs, x, train, powers=(1.0,), folds=2).collect() for x in (lab, turned))
    known = lab.where(train).join(docs, "doc_id", "left_semi")
    assert one == other and len(one) == 1
    assert one[0]["toxic"] == known.where("toxic = 1").count() and one[0]["others"] == known.where("toxic = 0").count()
    assert 0 < one[0]["found"] <= one[0]["toxic"] and one[0]["flagged"] < one[0]["others"] / 10


def test_rows_without_evidence_are_kept(spark):
    """One toxic and one good example: what shares no term with either is not rejected; an empty table stays empty."""
    schema = "doc_id long, text string, score double"
    docs = spark.createDataFrame([(1, "vile insult", 0.1), (2, "fine weather", None), (3, None, 0.2), (4, "", 0.3), (5, "unrelated words", 0.4), (5, "unrelated words", 0.4), (None, "nothing known", 0.5)], schema)
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    kept = toxicity.reject(docs, known, F.lit(True))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i or 0 for i in ids if i not in (1, 2)) == [0, 3, 4, 5, 5]
    assert toxicity.reject(docs.limit(0), known, F.lit(True)).count() == 0


def test_nearest_examples_are_exact():
    r = np.random.default_rng(4)
    n_terms, n = 30, 700
    vectors = []
    for _ in range(n):
        t = np.sort(r.choice(n_terms, r.integers(0, 6), replace=False)).astype(np.int64)
        vectors.append((t, r.integers(1, 4, len(t))))
    idf = r.random(n_terms) + 0.5
    row, term, tf = np.repeat(np.arange(n), [len(t) for t, _ in vectors]), *(np.concatenate(x) for x in zip(*vectors, strict=True))
    index = toxicity.Index(np.arange(n_terms, dtype=np.uint64), idf, list(range(n)), r.integers(0, 2, n).astype(float), row, term, tf)
    dense = np.zeros((n, n_terms))
    for i, (t, f) in enumerate(vectors):
        if len(t):
            w = (1 + np.log(f)) * idf[t]
            dense[i, t] = w / np.sqrt(np.sum(w * w))
    for i in range(0, n, 7):
        t, f = vectors[i]
        if len(t):
            cos = dense @ dense[i]
            rows, got = index.nearest(t, f, 10)
            want = np.sort(cos[cos > 0])[::-1][:10]
            assert np.allclose(got, want[: len(got)], atol=1e-6) and len(got) == len(want)
            assert np.allclose([cos[index.ids[x]] for x in rows], got, atol=1e-6)


def test_blocks_that_are_skipped_hold_no_neighbour():
    """Clustered vectors over many terms, so that bounds do skip blocks: the same as every cosine by itself."""
    r = np.random.default_rng(9)
    n, n_terms = 3000, 400
    part = r.integers(0, 4, n)
    row = np.repeat(np.arange(n), 12)
    term = part[row] * 100 + np.minimum(r.geometric(0.05, len(row)) - 1, 99)
    key, tf = np.unique(row * n_terms + term, return_counts=True)
    row, term = key // n_terms, key % n_terms
    idf = r.random(n_terms) + 0.1
    index = toxicity.Index(np.arange(n_terms, dtype=np.uint64), idf, list(range(n)), part / 3, row, term, tf)
    assert (index.column >= 0).any() and (index.column < 0).any()
    w = (1 + np.log(tf)) * idf[term]
    dense = np.zeros((n, n_terms))
    dense[row, term] = w
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    some = row < 200
    for i, (rows, got) in enumerate(index.nearest_of(row[some], term[some], tf[some], 200, 25)):
        cos = dense @ dense[i]
        assert np.allclose(got, np.sort(cos)[::-1][:25], atol=2e-6)
        assert np.allclose([cos[index.ids[x]] for x in rows], got, atol=2e-6)


def test_equal_texts_have_equal_scores(spark):
    rows = [(i, f"alpha beta {'vile' if i % 3 == 0 else 'calm'} w{i % 40}") for i in range(300)]
    lab = labels(spark, [(i, 1, int(i % 3 == 0), "", "") for i in range(0, 300, 2)])
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lab, F.lit(True)).collect()
    by: dict = {}
    for r in got:
        by.setdefault(dict(rows)[r["doc_id"]], set()).add(r["score"])
    assert all(len(x) == 1 for x in by.values())


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.9, 0.9]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] < 0.2 and y[-1] > 0.9


def test_toxicity_edge_cases(spark):
    lab = labels(spark, [(1, 1, 1, "", ""), (2, 1, 0, "", ""), (None, 1, 1, "", ""), (3, None, None, "", ""), (1, 0, 0, "", "")])
    out = toxicity.score(edge_docs(spark), lab, F.lit(True))
    assert out.count() == len(DOCS) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in toxicity.score(edge_docs(spark), labels(spark), F.lit(True)).collect()} == {0.0}
    assert toxicity.score(no_docs(spark), lab, F.lit(True)).count() == 0
    kept = toxicity.reject(edge_docs(spark), labels(spark), F.lit(True))
    assert kept.columns == edge_docs(spark).columns and kept.count() == len(DOCS)


def test_one_text_of_a_labelled_id_is_an_example(spark):
    rows = [(1, "good words here"), *[(2, f"vile words {i % 9}") for i in range(500)], (3, "good text here"), *[(i, "plain words") for i in range(10, 20)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = labels(spark, [(i, 1, int(i == 2), "", "") for i in (1, 2, 3, *range(10, 20))])
    index = toxicity.fit(docs, lab, F.lit(True)).shared.value
    assert len(index.ids) <= 13 and len(set(index.ids)) == len(index.ids)
    assert toxicity.score(docs, lab, F.lit(True)).count() == len(rows)


def test_every_word_of_the_examples_is_a_term(spark):
    """A copy of a toxic example whose words no other has finds it; a word seen once is evidence, toxic or not."""
    rows = [(i, f"plain{i} words{i} number{i}" if i % 10 else f"rare{i} odd{i} ones{i}") for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, "rare10 odd10 ones10"), (1001, "plain11 words11 number11")], "doc_id long, text string")
    lab = labels(spark, [(i, 1, int(i % 10 == 0), "", "") for i in range(600)])
    index = toxicity.fit(docs, lab, F.lit(True)).shared.value
    assert len(index.ids) == 600 and len(index.terms) == 3 * 600
    got = {r["doc_id"]: r for r in toxicity.score(docs, lab, F.lit(True)).where("doc_id >= 1000").collect()}
    assert got[1000]["evidence"].startswith("10:1:1.000") and got[1001]["evidence"].startswith("11:0:1.000")


# ------------------------------------------------------------------------------------- language model


def _tokens(t):
    return [w.translate(LOWER) for w in (t or "").encode().split()] + [b"\0end"]


def test_base_scores_and_better_model_scores(spark, sf):
    docs = texts(spark, sf)
    tok = {i: _tokens(t) for i, t in docs.items()}
    c = Counter(w for i, ws in tok.items() if _crc(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in op2(spark, sf).collect()}
    for i, ws in tok.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(w in c for w in ws), n, _crc(i, 7) == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 60, 40)
    base = np.full(50, 1 / 50)
    full = np.zeros(50)
    full[:40] = c
    last, samples = pitman_yor.sample_tables(c, base[:40], 0.6, 1.0, 6, 2, rng)
    for t in samples:
        assert (t >= 1).all() and (t <= c).all()
        tables = np.zeros(50)
        tables[:40] = t
        assert math.isclose(pitman_yor.predictive(full, tables, 0.6, 1.0, base, c.sum(), t.sum()).sum(), 1, rel_tol=1e-9)


def expected_tables(d, theta, base, c):
    """Tables of two dishes with c customers each, by enumeration of the Pitman-Yor prior."""

    def stirling(n, k):
        s = [[0.0] * (n + 2) for _ in range(n + 1)]
        s[0][0] = 1.0
        for i in range(1, n + 1):
            for j in range(1, i + 1):
                s[i][j] = s[i - 1][j - 1] + (i - 1 - d * j) * s[i - 1][j]
        return s[n][k]

    def joint(k1, k2):
        p = 1.0
        for i in range(k1 + k2):
            p *= theta + d * i
        return p * stirling(c, k1) * stirling(c, k2) * base ** (k1 + k2)

    weights = {(i, j): joint(i, j) for i in range(1, c + 1) for j in range(1, c + 1)}
    return sum((i + j) * w for (i, j), w in weights.items()) / sum(weights.values())


def test_gibbs_finds_the_seating_of_a_small_restaurant():
    """Two dishes, four customers each."""
    d, theta, base, c = 0.5, 1.0, 0.5, 4
    want = expected_tables(d, theta, base, c)
    rng = np.random.default_rng(0)
    _, samples = pitman_yor.sample_tables(np.array([c, c]), np.array([base, base]), d, theta, 3000, 100, rng)
    assert abs(samples.sum(axis=1).mean() - want) < 0.35


def test_gibbs_over_many_restaurants():
    """10,000 restaurants of two dishes with four customers each, whose mean is the enumerated one."""
    n, key = 10_000, np.random.default_rng(4).integers(0, 1 << 62, 20_000).astype(np.uint64)
    _, tables, d, _ = pitman_yor.seat_restaurants(np.repeat(np.arange(n), 2), np.full(2 * n, 4), np.full(2 * n, 0.5), 1.0, 12, 4, key)
    assert (d == 0.5).all() and abs(tables.mean() - expected_tables(0.5, 1.0, 0.5, 4)) < 0.05


def test_poisson_by_key():
    key = np.arange(1, 200_001, dtype=np.uint64)
    for mean in (0.3, 5.0, 63.0, 200.0):
        x = pitman_yor._poisson(np.full(len(key), mean), key, 7)
        assert abs(x.mean() - mean) < 5 * math.sqrt(mean / len(key)) and abs(x.var() / mean - 1) < 0.03


@pytest.mark.parametrize(("words", "hot"), [(1 << 16, 500_000), (40, 300)])
def test_scores_do_not_depend_on_partitions(spark, sf, words, hot):
    """The whole table, cut into other numbers of buckets and partitions; hot contexts in parts too."""
    docs, before, got = spark.read.parquet(f"{sf}/documents.parquet"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, in_bucket in ((3, 2_000_000), (8, 2_000_000), (4, 5_000)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            rows = pitman_yor.score(docs, F.col("doc_id") % 7 != 2, words=words, in_bucket=in_bucket, hot=hot).collect()
            got.append({r["doc_id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[0]) > 50 and all(g.keys() == got[0].keys() for g in got)
    assert max(abs(g[i] - got[0][i]) for g in got for i in g) < 1e-9


def test_language_model_edge_cases(spark):
    out = pitman_yor.score(edge_docs(spark), F.coalesce(F.col("doc_id") != 8, F.lit(True)), words=3, in_bucket=100)
    rows = out.collect()
    assert len(rows) == len(DOCS) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(_tokens(t)) for _, t, *_ in DOCS)
    assert pitman_yor.score(no_docs(spark), F.lit(True)).count() == 0
    untrained = pitman_yor.score(edge_docs(spark), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_every_preceding_word_is_a_context(spark):
    """More than 64 contexts, none of them frequent: each word is sure of its follower, and known pairs beat new ones."""
    n = 150
    rows = [(i, f"left{i % n} right{i % n}") for i in range(8 * n)] + [(100_000 + i, f"left{i} right{i}") for i in range(n)] + [(200_000 + i, f"left{i} right{(i + 1) % n}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, in_bucket, hot in ((1 << 16, 1 << 20, 1 << 20), (5, 300, 100), (200, 500, 300)):  # how pairs travel makes no difference
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id") < 100_000, words=words, in_bucket=in_bucket, hot=hot).collect()}
        # log10 P of the first word is about -log10(n); the follower and the end after it are nearly sure.
        assert all(got[100_000 + i] > -math.log10(n) - 0.5 for i in range(n))
        assert all(got[200_000 + i] < got[100_000 + i] - 1 for i in range(n))


def test_every_probability_behind_a_context_adds_up_to_one():
    """A bucket's restaurants and their parent by hand, through the code that scores: sums to 1 within 1e-6."""
    rng = np.random.default_rng(8)
    hashes = np.sort(rng.integers(1, 1 << 62, 9).astype(np.uint64))
    lexicon = pitman_yor.Lexicon(hashes[:5], np.array([50, 40, 30, 20, 10]), 1, 1 << 30)
    rare = hashes[5:]
    customers = np.array([6, 5, 4, 3, 2, 2, 1, 1, 1])
    c, n = np.unique(customers, return_counts=True)
    root = pitman_yor.Root(c, n, 6, 2)
    assert math.isclose(root.of(customers).sum() + root.unknown, 1, rel_tol=1e-6)
    lexicon.total, lexicon.base = 150, root.of(customers[:5])
    refs = np.array([0, 1, 2, 3, 0, 1, pitman_yor.ESC, pitman_yor.ESC], np.uint16)
    cells = pitman_yor.Cells([[np.array([1, 2], np.uint16), np.array([5, 3]), np.empty(0, np.uint64), refs, rare[:2], np.array([9, 4, 1, 2, 7, 3, 2, 1])]])
    p = root.of(customers[5:7])
    base = np.concatenate([lexicon.base, np.zeros(pitman_yor.ESC - 5), p])[cells.dish]
    mean, d, _ = pitman_yor._seat_all(cells, base, lexicon, 6, 2)
    left = np.maximum(cells.n - d * mean, 0).astype(np.float32)
    given = np.bincount(cells.rest, cells.n - left.astype(float))
    model = pitman_yor.Model(lexicon, root, [], [], 9)
    blob = cells.packed(left, given, p, np.array([3, 2]))
    everything = np.concatenate([np.arange(5), [pitman_yor.ESC] * 2]).astype(np.uint16)
    for context in (1, 2, 3):  # the last one has no restaurant
        asked = pitman_yor.pack(np.array([context], np.uint16), np.array([7]), np.empty(0, np.uint64), everything, rare[:2], np.arange(7), np.ones(7, np.int64))
        got = [r for r in pitman_yor._scored(model, [blob], [(0, asked)], 0)]
        scores = pitman_yor.unpack(got[0].column("blob")[0].as_py())[1] / -pitman_yor.SCALE
        share = (1 + given[context - 1]) / (1 + np.bincount(cells.rest, cells.n)[context - 1]) if context < 3 else 1.0
        rest = share * (root.of(customers[7:]).sum() + root.unknown)  # words that this bucket doesn't have
        assert math.isclose((10.0 ** scores.astype(float)).sum() + rest, 1, rel_tol=1e-6)


def test_restaurants_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    rest, c = np.repeat(np.arange(4), [1, 5, 40, 300]), rng.integers(1, 400, 346)
    base = np.full(346, 1 / 1000)
    key = rng.integers(0, 1 << 62, 346).astype(np.uint64)
    t, tables, d, _ = pitman_yor.seat_restaurants(rest, c, base, 1.0, 6, 2, key)
    assert (t >= 1).all() and (t <= c).all()
    customers = np.bincount(rest, c)
    p = np.bincount(rest, pitman_yor.predictive(c, t, d[rest], 1.0, base, customers[rest], tables[rest]))
    left = (1.0 + d * tables) / (1.0 + customers) * (1 - np.bincount(rest, base))
    assert np.allclose(p + left, 1)


# --------------------------------------------------------------------------------------------- mixing


def test_mix_meets_targets(spark):
    docs = [(i, "w " * (1 + i % 40), f"s{(i * i) % 5}" if i % 17 else None) for i in range(4000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 40
        assert all(r["taken"] <= 3 * r["size"] for r in rs) and rs[0]["target"] <= 3 * sum(r["size"] for r in rs) + 1e-6
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_thresholds_are_nested(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i % 3 else "y") for i in range(900)], "doc_id long, text string, source string")
    small = {r["doc_id"] for r in mixing.mix(docs, share=0.2).where("taken > 0").collect()}
    large = {r["doc_id"] for r in mixing.mix(docs, share=0.5).where("taken > 0").collect()}
    assert small < large


def test_mixing_edge_cases(spark):
    rows = mixing.mix(edge_docs(spark)).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode().split()) for _, t, *_ in DOCS)
    assert mixing.mix(no_docs(spark)).count() == 0
    blank = mixing.mix(edge_docs(spark).where("doc_id in (3, 4, 5)")).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0)] * 3


# -------------------------------------------------------------------------------------- chat formatting

ODD = ["</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>", "a\\<\\\\|b <\\|im_end|>", "<<SYS>> x <</SYS>>", "[|<|/loss|>", "plain\n\ntext", "", "<s>\\</s>", "[\\INST]"]


@pytest.mark.parametrize("text", ODD)
def test_escape_round_trip(spark, text):
    d = spark.createDataFrame([(text,)], "t string")
    e, back = d.select(chatformat.escape(F.col("t")).alias("e")).select("e", chatformat.unescape(F.col("e"))).first()
    assert back == text and not any(m in e for m in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_layouts_give_canonical_turns(spark):
    records = [
        {"role": "user", "content": "q"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"prompt": "q", "completion": "a"},
        {"system": "s", "prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"instruction": "q", "context": "c", "response": "a"},
        {"unknown": 1},
        [1, 2],
    ]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, "not json"), (100, None)], "i long, record string")
    got = {r["i"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chatformat.canonical_turns(d).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got[0] == ("message", [("user", "q")])
    assert got[1][1] == [("user", "q"), ("assistant", "")]
    assert all(got[i][1] == qa for i in (2, 3, 4, 6, 7, 8))
    assert got[5][1] == [("system", "s"), *qa] and got[9][1] == [("user", "q\n\nc"), ("assistant", "a")]
    assert all(got[i] == (None, None) for i in (10, 11, 99, 100))


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", t) for t in ODD] + [(1, 0, "user", None), (2, 0, None, "x"), (3, None, "assistant", "<|loss|>"), (3, 200, "as<|im_sep|>sistant", "y"), (None, 0, "assistant", "no id")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, t string")
    out = {r["conv_id"]: r for r in chatformat.digests(chatformat.format_chats(chatformat.of_table(d), "conv_id", "turn")).collect()}
    assert set(out) == {1, 2, 3, None, -1}
    by: dict = {-1: [("user", ODD[0]), ("assistant", ODD[0])]}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (out[c]["n_turns"], out[c]["loss_chars"]) == (len(turns), len(loss))
        assert out[c]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert out[c]["loss_sha256"] == sha256(loss.encode()).hexdigest()


def test_very_long_messages_stay(spark):
    d = spark.range(1).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", r"""repeat('a"\\\\: b', 3500000) AS text""")
    d = d.unionByName(d.selectExpr("conv_id", "1L AS turn", "'assistant' AS role", "'short' AS text"))
    want = {r["turn"]: r["n"] for r in d.select("turn", F.length("text").alias("n")).collect()}
    assert want[0] > 20_000_000
    out = {r["conv_id"]: r for r in chatformat.digests(chatformat.format_chats(chatformat.of_table(d), "conv_id", "turn")).collect()}
    assert (out[1]["n_turns"], out[1]["loss_chars"]) == (2, 5) and out[1]["formatted_chars"] > want[0]
    said = d.orderBy("turn").selectExpr("sha2(concat_ws('', array(concat('user\n', text, '\n', 'assistant\nshort\n'))), 256) AS h").first()["h"]
    assert out[1]["turns_sha256"] == said


def test_records_of_unknown_layout_are_counted_and_their_conversations_stay(spark):
    listed = json.dumps({"messages": [{"role": "user", "content": "q", "id": 1}]})
    d = spark.createDataFrame([(1, 0, listed), (2, 0, json.dumps({"role": "user", "content": "q"})), (2, 1, "no json"), (3, 0, None)], "conv_id long, turn long, record string")
    whole = chatformat.format_chats(d, "conv_id", "turn")
    assert {r["conv_id"]: r["unmapped"] for r in whole.collect()} == {1: 1, 2: 1, 3: 1}
    assert {r["conv_id"]: r["n_turns"] for r in chatformat.digests(whole).collect()} == {1: 0, 2: 1, 3: 0}


# ------------------------------------------------------------------------------------------- pipeline


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= n
        n = docs.count()
    rows = docs.collect()
    assert not any(b in (r["text"] or "") for r in rows for b in bench)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if "[EMAIL]" in r["text"])
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == n and {"doc_id", "taken"} <= set(final.columns)
