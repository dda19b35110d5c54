"""Answering questions: the four strategies as plans, chosen by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import chunking, text
from ..operators import routing, search, selection
from .models import Model, ask, echo

SEPARATOR = "\n\n---\n\n"


def decisions(questions: DataFrame) -> DataFrame:
    """questions: qid, query, context_size -> with complexity, strategy, confidence, estimated chunks and cost."""
    a = routing.analysis(F.col("query"))
    name, sure = routing.strategy(a["complexity"], F.col("context_size"))
    out = questions.withColumns({"complexity": a["complexity"], "strategy": name, "confidence": sure, "chunks": routing.estimated_chunks(name, a["chunk_access"])})
    costs = routing.strategy_costs(F.col("query"), F.col("context_size"), F.lit(SETTINGS.model))
    chosen = F.filter(costs, lambda c: c["strategy"] == F.col("strategy"))
    return out.withColumn("usd", routing.with_buffer(F.get(chosen, F.lit(0))["usd"]))


def prompts(question: str = "query", context: str = "context"):
    return F.concat(F.lit("Answer from the context.\n\nContext:\n"), F.col(context), F.lit("\n\nQuestion: "), F.col(question))


def direct(questions: DataFrame, docs: DataFrame, limit: int = 10_000) -> DataFrame:
    """(qid, query, context): the beginning of every document of the question. questions carry their doc_ids."""
    picked = questions.select("qid", "query", F.explode("doc_ids").alias("doc_id")).join(docs.select("doc_id", F.left("text", F.lit(limit)).alias("t")), "doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"])
    return picked.groupBy("qid", "query").agg(F.array_join(ordered, SEPARATOR).alias("context"))


def retrieved(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(qid, query, context) by hybrid search. chunks: doc_id (the chunk's key), text; vectors: doc_id, vector; questions: qid, query, vector."""
    hits = search.hybrid(chunks, vectors, questions, k).join(chunks.select("doc_id", F.col("text").alias("content")), "doc_id").withColumnsRenamed({"rrf_rank": "rank", "fused_score": "score"})
    return selection.context(hits).join(questions.select("qid", "query"), "qid")


def mapped(questions: DataFrame, docs: DataFrame, model: Model = echo, chunk_size: int = SETTINGS.chunking.size, most_chars: int = 50_000, only: DataFrame | None = None, **how) -> DataFrame:
    """(qid, query, answer): the model reads every chunk of the question's documents, then its own notes.

    only: (qid, doc_id) restricts the documents (the hybrid strategy's filter).
    """
    picked = questions.select("qid", "query", F.explode("doc_ids").alias("doc_id"))
    picked = picked.join(only, ["qid", "doc_id"], "left_semi") if only is not None else picked
    parts = chunking.exploded(docs.select("doc_id", "text"), chunking.chunk(F.col("text"), chunk_size, 0), "doc_id").select("doc_id", "chunk_index", F.left("content", F.lit(most_chars)).alias("context"))
    notes = ask(picked.join(parts, "doc_id"), prompts(), model, **how)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "chunk_index", F.coalesce("reply", F.lit("")).alias("r")))), lambda x: x["r"])
    together = notes.groupBy("qid", "query").agg(F.array_join(joined, "\n").alias("context"), F.count_if(~F.col("ok")).alias("failed_calls"))
    out = ask(together, prompts(), model, **how)
    return out.select("qid", "query", text.final_answer(F.coalesce("reply", F.lit(""))).alias("answer"), "failed_calls")


def filtered(hits: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The best share of each question's hits, at least one. hits: qid, doc_id, rank."""
    n = F.count("*").over(Window.partitionBy("qid"))
    return hits.withColumn("n", n).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).drop("n")


def answers(questions: DataFrame, docs: DataFrame, vectors: DataFrame, model: Model = echo, k: int = 5, **how) -> DataFrame:
    """(qid, strategy, answer): each question by the strategy its rules choose.

    questions: qid, query, vector, doc_ids, context_size. Four plans over disjoint questions, then their union.
    """
    routed = decisions(questions)
    of = lambda s: routed.where(F.col("strategy") == s)
    reply = lambda df, s: ask(df, prompts(), model, **how).select("qid", F.lit(s).alias("strategy"), text.final_answer(F.coalesce("reply", F.lit(""))).alias("answer"))
    hits = filtered(search.cosine_top_k(vectors, of("hybrid").select("qid", "vector"), 2 * k))
    parts = [
        reply(direct(of("direct_llm"), docs), "direct_llm"),
        reply(retrieved(of("rag"), docs, vectors, k), "rag"),
        mapped(of("rlm"), docs, model, **how).select("qid", F.lit("rlm").alias("strategy"), "answer"),
        mapped(of("hybrid"), docs, model, only=hits.select("qid", "doc_id"), **how).select("qid", F.lit("hybrid").alias("strategy"), "answer"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def advanced(questions: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, context, citations): hybrid retrieval of 20, reranked to 10, chosen adaptively, numbered, assembled."""
    q = questions.select("qid", "query", "vector")
    hits = search.hybrid(docs, vectors, q, 20).withColumnsRenamed({"rrf_rank": "rank", "fused_score": "score"})
    hits = search.with_texts(hits, docs, q, 20)
    best = search.rerank(hits).withColumn("score", F.col("model_score"))
    chosen = selection.adaptively(best).select("qid", "doc_id", (F.col("selected") + 1).alias("rank"), "score")
    cited = chosen.join(best.select("qid", "doc_id", "content"), ["qid", "doc_id"])
    lines = selection.formatted(cited.withColumn("citation_number", F.col("rank")))
    return selection.context(cited).join(lines, "qid")
