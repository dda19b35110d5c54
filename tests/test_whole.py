"""Queries take the whole of their tables."""

from __future__ import annotations

import shutil

import numpy as np
from pyspark.sql import functions as F

from sparkquill.operators.clusters import k_means
from sparkquill.queries.chunks import rechunk_metadata
from sparkquill.queries.plans import answer_questions, asked
from sparkquill.queries.search import bm25_topk, hybrid_search, retrieved, vector_topk
from sparkquill.queries.selection import select_by_clusters
from sparkquill.registry import table


def test_clusters_of_every_question(spark, sf):
    want = {(r["qid"], r["doc_id"]): r["score"] for r in retrieved(spark, sf).select("qid", "doc_id", "score").collect()}
    got = select_by_clusters(spark, sf).collect()
    assert {r["qid"] for r in got} == {q for q, _ in want} and len({r["qid"] for r in got}) > 1
    assert all(abs(want[r["qid"], r["doc_id"]] - r["score"]) < 1e-5 for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r["qid"], []).append(r)
    for q, rows in by.items():
        assert len(rows) <= 5 and len({r["cluster"] for r in rows}) == len(rows)
        assert abs(max(r["score"] for r in rows) - max(s for (p, _), s in want.items() if p == q)) < 1e-5


def test_clusters_are_separate():
    x = np.repeat(np.eye(4) * 9, 3, axis=0)
    at = k_means(x, 4, 42)
    assert len(set(at)) == 4 and all(len(set(at[i : i + 3])) == 1 for i in range(0, 12, 3))


def test_answers_are_over_all_documents(spark, sf):
    rows = asked(spark, sf).collect()
    found = {d for r in rows for d in r["doc_ids"] or []}
    assert len(rows) == table(spark, sf, "benchmark").count()
    assert max(found) > max(r["qid"] for r in rows) + 7
    assert answer_questions(spark, sf).count() > 0


def test_long_documents_have_old_chunks_to_their_end(spark, tmp_path):
    docs = spark.createDataFrame([(1, ("word " * 60 + "\n") * 400), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = rechunk_metadata(spark, str(tmp_path)).collect()
    assert all(r["overlapping"] > 0 and r["first_page"] is not None for r in rows)
    assert max(r["last_page"] for r in rows if r["doc_id"] == 1) == -(-400 * 301 // 400) and {r["doc_id"] for r in rows} == {1, 4}


def test_questions_without_a_vector_stay_in_the_keyword_queries(spark, sf, tmp_path):
    for t in ("documents", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    first = table(spark, sf, "benchmark").agg(F.min("item_id")).first()[0]
    table(spark, sf, "embeddings").where(F.col("vec_id") != first).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(r["doc_id"], r["rank"]) for r in bm25_topk(spark, sf).where(F.col("qid") == first).collect()}
    got = {(r["doc_id"], r["rank"]) for r in bm25_topk(spark, str(tmp_path)).where(F.col("qid") == first).collect()}
    assert got == want and want
    assert hybrid_search(spark, str(tmp_path)).where(F.col("qid") == first).count() > 0
    assert vector_topk(spark, str(tmp_path)).where(F.col("qid") == first).count() == 0
