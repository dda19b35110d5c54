"""Staged reranking, inline citations, forks: small cases by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquill.operators import search, selection, sessions


def _results(spark):
    rows = [(1, "red apple", f"d{i}", t, i) for i, t in enumerate(["red", "red apple", "apple pie red", "nothing", None], 1)]
    return spark.createDataFrame(rows, "qid int, query string, doc_id string, content string, rank int")


def test_stages_cut_for_the_next_and_fall_back(spark):
    def broken(query, content):
        raise OSError("gone")

    unsure = lambda q, c: F.when(F.length(c) > 5, F.lit(5.0))  # noqa: E731 -- null for short texts
    stages = [search.Stage("a", lambda q, c: F.coalesce(F.length(c), F.lit(0)).cast("double"), 3), search.Stage("b", broken, 3), search.Stage("c", unsure, 2)]
    got = search.rerank_in_stages(_results(spark), stages).orderBy("rerank").collect()
    assert [r["doc_id"] for r in got] == ["d3", "d2"] and [r["rerank"] for r in got] == [1, 2]
    assert [(r["b"], r["c"]) for r in got] == [(1.0, 5.0), (1.0, 5.0)]
    assert search.rerank_in_stages(_results(spark).limit(0), stages).count() == 0


def test_citations_follow_the_sentences_they_cover(spark):
    answers = spark.createDataFrame([(1, "Apples are red.  Nobody knows! Pears are green?"), (2, ""), (3, None)], "qid int, answer string")
    cited = spark.createDataFrame([(1, 7, "apples are red. and round"), (1, 9, "pears are green? often"), (2, 1, "x")], "qid int, citation_number int, content string")
    got = {r["qid"]: r["answer"] for r in selection.with_citations(answers, cited).collect()}
    assert got == {1: "Apples are red. [7] Nobody knows! Pears are green? [9]", 2: "", 3: ""}


def test_citations_by_document(spark):
    cited = spark.createDataFrame([(1, 2, "b", 0.5, "two"), (1, 1, "b", 0.25, "x" * 101), (1, 3, "a", 1.0, "three")], "qid int, citation_number int, doc_id string, score double, content string")
    got = selection.grouped_by_document(cited).first()["citations"]
    assert got == "Sources by Document:\n\nDocument: a\n  [3] Score: 1.000: three\n\nDocument: b\n  [1] Score: 0.250: " + "x" * 100 + "...\n  [2] Score: 0.500: two"


def test_forks_keep_their_own_parents(spark):
    s = spark.createDataFrame([("s", None, "archived", 5, None), ("t", "T", "active", 1, {"k": "v", "forked_from": "old"})], "session_id string, title string, status string, tokens long, metadata map<string,string>")
    m = spark.createDataFrame([("s", 1, None, None), ("s", 2, 1, {"forked": "no"}), ("t", 1, 99, None)], "session_id string, id long, parent_id long, metadata map<string,string>")
    fs, fm = sessions.fork_graph(s, m, F.concat(F.lit("new-"), F.col("session_id")), F.timestamp_seconds(F.lit(0)))
    got = {r["session_id"]: r for r in fs.collect()}
    assert got["new-s"]["title"] == "Fork of " and got["new-s"]["parent_session_id"] == "s" and got["new-s"]["tokens"] == 5
    assert got["new-t"]["metadata"]["forked_from"] == "t" and got["new-t"]["metadata"]["k"] == "v"
    rows = sorted((r["session_id"], r["id"], r["parent_id"], r["metadata"]["forked"]) for r in fm.fillna("-", ["parent_id"]).collect())
    assert rows == [("new-s", "1-fork", "-", "true"), ("new-s", "2-fork", "1-fork", "true"), ("new-t", "1-fork", "-", "true")]
