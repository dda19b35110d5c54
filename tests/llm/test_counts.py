"""Token counts, quality measures, personal data: against plain Python over whole texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, edge_docs, labels, no_docs, texts
from pyspark.sql import functions as F

from sparkquill.llm import pii, quality, tokencount
from sparkquill.llm.queries import op6, op8, op9

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _tokens(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def test_token_counts(spark, sf):
    count = _tokens(BPE)
    got = {r["doc_id"]: r for r in op9(spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), count(t), count(t) > 1024)


def test_token_counts_of_edge_cases_and_other_tokenizers(spark):
    extra = [(i, t, None, None) for i, t in enumerate(["  a  b\n\n c", "a  b", "x<|endoftext|> y <|endoftext|>", " \t\r\n", "don't  stop\r\n\r\n now\x1c b", "　 全角　スペース", "a" * 5000], 100)]
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    want = [t for _, t, *_ in DOCS + extra]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        count = _tokens(public_tokenizers.path(name))
        got = [r["n_tokens"] for r in tokencount.token_counts(docs, public_tokenizers.path(name)).collect()]
        assert sorted(got) == sorted(map(count, want))
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = [r["n_tokens"] for r in tokencount.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()]
    assert sorted(got) == sorted(len(pieces.encode(t or "")) for t in want)
    assert tokencount.token_counts(no_docs(spark), BPE).count() == 0


def test_token_counts_around_white_space_of_every_kind(spark):
    odd = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200C)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff", "\u180e"]
    some = random.Random(7)
    signs = [*odd, " ", " ", "  ", "\n", "\t", "\r\n", "a", "word", "don't", "12", "é", "全角", "!?", "<|endoftext|>"]
    rows = [(i, "".join(some.choices(signs, k=some.randint(1, 30)))) for i in range(1500)]
    rows += [(len(rows) + i, "one\xa0two three\u3000 four\n" * n) for i, n in enumerate((1, 2, 60_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = _tokens(BPE)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, BPE).collect()}
    assert got == {i: count(t) for i, t in rows}
    assert max(len(t.encode()) for _, t in rows) > tokencount.PIECE


# ------------------------------------------------------------------------------------------- quality


def _measures(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, sf):
    got = {r["doc_id"]: r for r in op6(spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        r, m = got[i], _measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r["base_failed"] and r["kept"])


def test_binomial_bound_is_exact(spark):
    cases = [(0, 10, 0.05), (3, 50, 0.1), (40, 1000, 0.05)]
    d = spark.createDataFrame(cases, "k long, n long, p double")
    for k, n, p in cases:
        got = d.where((F.col("k") == k) & (F.col("n") == n)).select(quality.log_binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
        assert math.isclose(got, math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel_tol=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    rows = [(i, " ".join(f"w{j}x{i}" for j in range(30)) + (" " + "#" * 300 if i % 2 else ""), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = labels(spark, [(i, int(i % 2 == 0), 0, "", "") for i in range(3000)])
    out = quality.quality_rules(docs, good)
    kept = {r["doc_id"]: r["kept"] for r in out.where("not base_failed").collect()}
    assert all(v for i, v in kept.items() if i % 2 == 0)
    assert kept and not any(v for i, v in kept.items() if i % 2)
    none = quality.quality_rules(docs, labels(spark))
    assert none.where("not kept and not base_failed").count() == 0


def test_copies_are_no_evidence_of_a_cutoff(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + (" " + "#" * 300 if i % 2 else ""), "en") for i in range(3000)]
    good = labels(spark, [(i, int(i % 2 == 0), 0, "", "") for i in range(3000)])
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), good)
    assert out.where("not kept and not base_failed").count() == 0


def test_quality_edge_cases(spark):
    out = quality.quality_rules(edge_docs(spark), labels(spark, [(1, 1, 0, "", ""), (None, 0, 0, "", ""), (2, None, 0, "", "")])).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == sorted(_measures(t) for _, t, *_ in DOCS)
    assert quality.quality_rules(no_docs(spark), labels(spark)).count() == 0


# ------------------------------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ \-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9\-]+[0-9]")


def _base(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m).encode())]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_patterns_are_those_of_the_whole_text(spark, sf):
    from hashlib import sha256

    got = {r["doc_id"]: r for r in op8(spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        assert got[i]["base_sha256"] == sha256(_base(t).encode()).hexdigest()
        assert set(filter(None, _base(t).split(","))) <= set(got[i]["spans"].split(","))


HARD = [
    "é a@b.c.d, b@c 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 ü@x.de",
    "4111-1111-1111-1111 4111--1111 0004111111111111111 +1 (337) 555-9217 +4 (",
    "mail me@x.org: again me@x.org; 001.002.003.255 1.2.3.0004 +12345678901.",
    "9" * 40 + " 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1+12345678901+2 3\n4111 1111\n1111 1111",
]


def test_patterns_on_hard_texts(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    assert [r["base"] for r in pii.find(d).orderBy("doc_id").collect()] == [_base(t) for t in HARD]


def test_repeated_number_takes_its_earlier_label(spark):
    """The field's skip potential: an unmarked repeat of a number that is known becomes a span too."""
    many = [(i, f"please call +1 (337) 555-9{i:03d} now or the same number 555-9{i:03d} later, not room 12") for i in range(300)]
    out = pii.find(spark.createDataFrame(many, "doc_id long, text string"), least=0.5).collect()
    added = [r for r in out if r["spans"] != r["base"]]
    assert len(added) > 150
    for r in added:
        assert set(r["base"].split(",")) < set(r["spans"].split(","))


def test_field_is_the_same_in_any_order_of_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, two = (pii.learn(d, sample_nodes=50) for d in (docs, docs.repartition(7)))
    assert (one.unary == two.unary).all() and (one.transition == two.transition).all() and one.skip == two.skip


@pytest.mark.parametrize("seed", range(4))
def test_propagation_against_enumeration(seed):
    """A chain of six words, two entities: marginals by adding up every labelling; exact on trees, near on loops."""
    from itertools import product

    rng = np.random.default_rng(seed)
    field = pii.Field()
    field.bias = rng.normal(0, 1, pii.LABELS)
    field.unary[: 8 * pii.N_FEATURES] = rng.normal(0, 0.5, (8 * pii.N_FEATURES, pii.LABELS))
    field.transition, field.skip = rng.normal(0, 0.6, (pii.LABELS, pii.LABELS)), 0.8
    features = rng.integers(0, 8 * pii.N_FEATURES, (6, pii.N_FEATURES))
    label = np.array([-1, 3, -1, -1, -1, -1])
    for chain, entity, close in ((np.array([0, 1, 3, 4]), np.array([-1, 0, -1, 0, -1, -1]), 1e-3), (np.arange(5), np.array([0, 1, -1, 0, -1, 1]), 0.06)):
        ids = np.unique(entity[entity >= 0])
        unary = field.scores(features)
        total, want = 0.0, np.zeros((6, pii.LABELS))
        for y in product(range(pii.LABELS), repeat=6):
            if y[1] != 3:
                continue
            w = sum(unary[i, y[i]] for i in range(6) if i != 1) + sum(field.transition[y[i], y[i + 1]] for i in chain)
            hubs = 1.0
            for h in ids:
                hubs *= sum(np.exp(sum(field.skip * (y[i] == z) for i in np.flatnonzero(entity == h))) for z in range(pii.LABELS))
            w = np.exp(w) * hubs
            total += w
            for i in range(6):
                want[i, y[i]] += w
        assert np.abs(field.propagate(features, chain, entity, label)[0] - want / total).max() < close


def test_learning_is_the_likelihoods_gradient(spark):
    """Learnt potentials tell two kinds of words apart and carry a label over a tie."""
    rng = np.random.default_rng(2)
    n = 600
    label = np.repeat(rng.integers(0, 2, n // 2) * 4, 2)
    features = np.stack([j * pii.HASHED + np.where(rng.random(n) < 0.8, label, rng.integers(5, 9, n)) for j in range(pii.N_FEATURES)], axis=1)
    entity = np.repeat(np.arange(n // 2), 2)
    field = pii.Field().learn(features, label, np.empty(0, np.int64), entity)
    p = field.propagate(features, np.empty(0, np.int64), entity, np.full(n, -1))[0]
    assert (p.argmax(axis=1) == label).mean() > 0.98 and field.skip > 0.5


def test_spellings_that_the_patterns_miss(spark):
    """Planted values in other spellings, on documents that have none: whole spans, at least nine in ten; clean documents stay clean."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii.learn(docs.select("doc_id", "text"))
    words = [w for w in (docs.where("doc_id = 12").first()["text"] or "").split() if not any(c.isdigit() or c == "@" for c in w)][:60]
    rng = np.random.default_rng(6)
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    planted, hit, extra = 0, 0, 0
    for i in range(200):
        p = number(10)
        value = [f"({p[:3]}) 555-{p[6:]}", f"{p[:3]}-555-{p[6:]}", f"{p[:3]} 555 {p[6:]}", f"{p[:3]}.555.{p[6:]}", f"{words[i % 40].strip('.,').lower()}.{10 + i % 80} @ mail{i % 10}.example.com", f"{words[i % 40].strip('.,').lower()}.{10 + i % 80}(@)mail{i % 10}.example.com", f"{i % 150 + 100}-{i % 89 + 10}-{i % 67 + 10}-{i % 45 + 10}"][i % 7]
        at = int(rng.integers(1, len(words) - 1))
        text = " ".join([*words[:at], value, *words[at:]]).encode()
        d = np.frombuffer(text, np.uint8)
        offs = np.array([0, len(d)])
        got = pii._added(field, d, offs, pii.patterns(d, offs), 0.9)
        s = text.index(value.encode())
        planted += 1
        hit += any(a <= s and b >= s + len(value) for a, b, _ in got)
        extra += len(got) > 1
    assert hit / planted >= 0.9 and extra / planted < 0.02, (hit, extra, planted)
    clean = "in 2019 the 3 of 12 cost 45 at 10:30, version 2.0, §12.4, 1,000,000 or 99.5 % (page 17)"
    d = np.frombuffer(" ".join([*words, clean, *words]).encode(), np.uint8)
    assert pii._added(field, d, np.array([0, len(d)]), [], 0.9) == []


def test_personal_data_edge_cases(spark):
    out = pii.find(edge_docs(spark)).collect()
    assert sorted(r["base"] for r in out) == sorted(_base(t) for _, t, *_ in DOCS)
    assert pii.find(no_docs(spark)).count() == 0
    clean = pii.redact(edge_docs(spark))
    assert clean.columns == edge_docs(spark).columns and clean.count() == len(DOCS)
    assert any("[EMAIL]" in (r["text"] or "") and "[PHONE]" in r["text"] for r in clean.collect())
