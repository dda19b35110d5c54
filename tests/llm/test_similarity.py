"""Near duplicates, repeated passages, contamination: against brute force."""

from __future__ import annotations

import random

import pytest
from helpers import DOCS, edge_docs, no_docs

from sparkquill.llm import common, decontaminate, jaccard, sketch, substring
from sparkquill.llm.common import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _words(t):
    return (t or "").encode().split()


def _sets(docs, k):
    out = []
    for _, t in docs:
        w = [x.translate(LOWER) for x in _words(t)]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def _components(docs, k, num, den):
    sets, up = _sets(docs, k), list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return sorted(((d, len(sets[i]), best.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def _near_copies(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = list(r.choice(docs)[1].split())
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w += r.choices(vocabulary, k=r.randint(1, 9))
        else:
            w = ["common", "first", "line", "of", "all", "texts"] * (i % 3 == 0) + r.choices(vocabulary, k=r.randint(3, 150))
        docs.append((r.randrange(10_000), " ".join(w)))
    return docs


@pytest.mark.parametrize("seed,k,num,cell", [(1, 4, 85, 2048), (2, 5, 80, 2048), (3, 3, 70, 4)])
def test_components_lose_no_link(spark, monkeypatch, seed, k, num, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)  # small cells: large groups are cut
    docs = _near_copies(seed)
    got = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), k, num, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _components(docs, k, num, 100)


def test_components_of_long_sets_use_finer_points(spark):
    r = random.Random(5)
    base = [f"a{r.randrange(10**6)}" for _ in range(8000)]
    docs = [(0, " ".join(base)), (1, " ".join(base[:7600])), (2, " ".join(base[4000:])), (3, " ".join(base[:900])), (4, " ".join(base[:1000]))]
    got = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _components(docs, 4, 85, 100)


def test_bound_never_rules_out_a_similar_pair():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        both = r.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.append(both, r.integers(0, 2**63, 20, dtype=np.uint64)), np.append(both, r.integers(0, 2**63, 25, dtype=np.uint64))
        va, vb = (np.bincount((x >> np.uint64(57)).astype(int), minlength=64).astype(np.uint16) for x in (a, b))
        if 100 * len(both) >= 85 * (len(a) + len(b) - len(both)):
            assert jaccard._pairs_bounded([va.tobytes()], [vb.tobytes()], np.array([len(a)]), np.array([len(b)]), 85, 100)[0]


def test_tree_finds_what_a_scan_finds():
    import numpy as np

    r = np.random.default_rng(3)
    for size in (1, 31, 33, 700, 2048):
        n = np.sort(r.integers(20, 90, size))
        points = np.stack([r.multinomial(k, np.ones(64) / 64) for k in n]).astype(np.uint16)
        points[: size // 2] = points[size // 2 : size // 2 * 2]  # copies
        n = points.sum(axis=1).astype(np.int64)
        tree = jaccard.RTree(points, n)
        assert size <= 256 or len(tree.levels) > 1
        for i in range(0, size, 1 + size // 40):
            since = int(r.integers(0, size))
            want = [j for j in range(since, size) if jaccard._bounded(points[j], points[i], n[j], n[i], 80, 100)]
            assert tree.search(points[i], int(n[i]), since, 80, 100).tolist() == want


def test_one_document_of_each_group_stays(spark):
    """Repeated rows with a null id or no words stay; an id with two texts loses only the text that has a smaller twin."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(0, a), (1, a), (1, b), (2, b), (3, ""), (3, ""), (None, a), (None, a), (5, None), (5, None), (7, "x y z"), (7, "x y z")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(0, a), (1, b), (3, ""), (3, ""), (None, a), (None, a), (5, None), (5, None), (7, "x y z")], key=str)


def test_near_duplicate_edge_cases(spark):
    docs = [(d, t) for d, t, *_ in DOCS]
    got = jaccard.similar_components(edge_docs(spark), 5, 80, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _components(docs, 5, 80, 100)
    assert jaccard.similar_components(no_docs(spark)).count() == 0
    kept = jaccard.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, 8, 9, None]


@pytest.mark.parametrize("local", [1, 3, 10**6])
def test_component_names(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_LINKS", local)
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, **dict.fromkeys(range(30, 36), 30)}


# ----------------------------------------------------------------------------------- repeated passages


def _removed(docs, n):
    windows = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in (_words(t) for _, t in docs)]
    least: dict = {}
    for (d, _), ws in zip(docs, windows, strict=True):
        for x in ws:
            if d is not None:
                least[x] = min(d, least.get(x, d))
    out = []
    for (d, t), ws in zip(docs, windows, strict=True):
        w = _words(t)
        gone = {j for i, x in enumerate(ws) if d is not None and least[x] < d for j in range(i, i + n)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def _passages(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)]
    shared = [r.choices(vocabulary, k=r.randint(10, 60)) for _ in range(6)]
    docs = []
    for i in range(80):
        w: list = []
        for _ in range(r.randint(0, 4)):
            w += r.choices(vocabulary, k=r.randint(0, 25)) + r.choice(shared)[: r.randint(1, 60)]
        docs.append((r.randrange(60), r.choice([" ", "\n", "  "]).join(w)))
    return docs


@pytest.mark.parametrize("seed,n", [(1, 13), (2, 13), (3, 26), (4, 7), (5, 5)])
def test_substrings_against_brute_force(spark, seed, n):
    docs = _passages(seed)
    got = substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), n).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == _removed(docs, n)


def test_substrings_without_filters(spark, monkeypatch):
    monkeypatch.setattr(sketch, "MOST_BITS", 0)  # too many survivors for a filter: they are joined
    docs = _passages(9)
    got = substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 26).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == _removed(docs, 26)


def test_substring_edge_cases(spark):
    docs = [(d, t) for d, t, *_ in DOCS]
    got = substring.substring_dedup(edge_docs(spark), 13).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == _removed(docs, 13)
    assert substring.substring_dedup(no_docs(spark)).count() == 0


# ---------------------------------------------------------------------------------------- contamination

ITEM = "The capital of France is Paris, and the river Seine runs through it from east to west every day of the year."


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, n string")


def test_passages_and_edited_passages_are_found(spark):
    pad = "some other words stand here before and after what matters " * 4
    edited = ITEM.replace("river", "rivers").replace("east", "eaxt")
    docs = [(1, pad + ITEM + pad), (2, pad + edited.upper() + pad), (3, pad * 3), (4, ITEM[:50] + pad), (5, pad + ITEM.replace(" ", "\n ")), (6, pad + "The capital of Spain is Madrid, and another river runs by it all the days of this year." + pad)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find(d, _bench(spark, [(7, ITEM, ""), (8, None, ""), (9, "short", "")]))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 7), (2, 7), (5, 7)}
    assert {r["doc_id"] for r in decontaminate.clean(d, _bench(spark, [(7, ITEM, "")])).collect()} == {3, 4, 6}
    blocks = decontaminate.find(d, _bench(spark, [(7, ITEM, ""), (8, ITEM.lower() + " more", "")]), block_bytes=10)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == {(i, j) for i in (1, 2, 5) for j in (7, 8)}


def test_every_edit_within_budget_is_found(spark):
    r = random.Random(3)
    docs = []
    for i in range(60):
        t = list(ITEM.lower())
        for _ in range(i % 6):
            t[r.randrange(len(t))] = r.choice("abcdefgh")
        docs.append((i, "x" * (i % 7) + " " + "".join(t)))
    index = decontaminate.Index([(0, ITEM)])
    import numpy as np

    for i, t in docs:
        b = np.frombuffer(t.encode(), np.uint8)
        y, p = decontaminate.normalise(b, np.array([0, len(b)]))[0], index.texts[0]
        k = min(int(100 * decontaminate.EDIT_RATE), (101 - decontaminate.LEAST_HITS) // decontaminate.Q - 1)
        near = min(decontaminate.banded(p[s : s + 100], y, s + i % 7, 40)[0] for s in range(0, len(p) - 99))
        found = bool(index.matches(b, np.array([0, len(b)])))
        assert found or near > k


def _substituted(r, text, n):
    t = list(text)
    for j in r.sample(range(len(t)), n):
        t[j] = r.choice([c for c in "abcdefgh" if c != t[j]])
    return "".join(t)


def test_every_window_within_budget_is_found():
    """Excerpts of exactly one window, with as many substitutions as are allowed and the hits that the lemma promises."""
    import numpy as np

    r = random.Random(8)
    item = "".join(r.choice("abcdefghijklmnopqrst ") for _ in range(400)).replace("  ", " q")
    index = decontaminate.Index([(0, item)])
    for n in (0, 5, 6, 7):
        for _ in range(60):
            begin = r.randrange(len(item) - 99)
            part = _substituted(r, item[begin : begin + 100], n)
            b = np.frombuffer(f"zzz {part} zzz".encode(), np.uint8)
            got = index.matches(b, np.array([0, len(b)]))
            assert got and got[0][2] <= n
    for m, k in ((60, 3), (40, 2)):
        short = decontaminate.Index([(0, item[:m])])
        for _ in range(30):
            b = np.frombuffer(f"zzz {_substituted(r, item[:m], k)} zzz".encode(), np.uint8)
            assert short.matches(b, np.array([0, len(b)]))


def test_short_items_match_whole_words_exactly(spark):
    d = spark.createDataFrame([(1, "So the ANSWER, is Forty two!"), (2, "the answer is forty twos"), (3, "breathe answer is forty two"), (4, "yes"), (5, "eyes yesterday"), (6, None)], "doc_id long, text string")
    got = decontaminate.find(d, _bench(spark, [(1, "The answer is forty-two.", ""), (2, "Yes!", ""), (3, " ?!", "")])).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(1, 1, 0), (4, 2, 0)}


def test_contamination_edge_cases(spark):
    empty = _bench(spark, [])
    assert decontaminate.find(edge_docs(spark), empty).count() == 0
    assert decontaminate.clean(edge_docs(spark), empty).count() == len(DOCS)
    some = _bench(spark, [(1, "The quick brown fox jumps over the lazy dog again and again today", "")])
    assert sorted(r["doc_id"] for r in decontaminate.find(edge_docs(spark), some).collect()) == [1, 1, 2]
    out = decontaminate.clean(edge_docs(spark), some)
    assert out.columns == edge_docs(spark).columns and out.count() == len(DOCS) - 3
    assert decontaminate.find(no_docs(spark), some).count() == 0
