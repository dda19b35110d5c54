"""Choosing among ranked chunks, and citing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.expr import let
from ..functions.text import jaccard, preview, sentences, words
from .routing import complexity_score

S = SETTINGS.selection


def by_threshold(df: DataFrame, threshold: float, k: int, relative: bool = False, key: str = "doc_id") -> DataFrame:
    """The first k, in the given order (rank), whose score reaches the threshold (or that share of the best score)."""
    best = F.max("score").over(Window.partitionBy("qid"))
    kept = df.withColumn("least", F.lit(threshold) * best if relative else F.lit(threshold)).where("score >= least").drop("least")
    return kept.withColumn("selected", F.row_number().over(Window.partitionBy("qid").orderBy("rank", key))).where(F.col("selected") <= k)


def progressively(df: DataFrame, k: int, least_gain: float = 0.01, key: str = "doc_id") -> DataFrame:
    """Best first, while each adds at least `least_gain` of what is selected so far; stops at the first that doesn't."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
    before = F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fails = F.when(before.isNotNull() & (before > 0) & (F.col("score") / before < least_gain), 1).otherwise(0)
    marked = df.withColumn("fails", fails).withColumn("failed", F.max("fails").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("selected", F.row_number().over(w))
    return marked.where((F.col("failed") == 0) & (F.col("selected") <= k)).drop("fails", "failed")


def target_count(score: Column, n: Column, least: int = S.min_chunks, most: int = S.max_chunks) -> Column:
    return F.greatest(F.lit(least), F.least(F.floor(n * (0.3 + 0.4 * score)).cast("int"), F.lit(most), n))


def adaptively(df: DataFrame, least: int = S.min_chunks, most: int = S.max_chunks, key: str = "doc_id") -> DataFrame:
    """df: qid, query, key, content, score. Per question: near-duplicates of better chunks go, then a greedy choice of
    chunks unlike all chosen ones up to a target that grows with the question's complexity, topped up to `least`.

    The arrays hold a question's retrieved chunks, which retrieval bounds.
    """
    item = F.struct((-F.round("score", 9)).alias("neg"), F.col(key).alias("key"), "content")
    grouped = df.groupBy("qid").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(item)).alias("items"))
    kind = grouped.schema["items"].dataType.simpleString()
    like = lambda a, b: jaccard(a["content"], b["content"])
    none = F.array().cast(kind)

    def without_twins(items: Column) -> Column:
        return F.aggregate(items, none, lambda a, x: F.when(F.exists(a, lambda y: like(x, y) > S.duplicate_above), a).otherwise(F.array_append(a, x)))

    def diverse(items: Column, target: Column) -> Column:
        return F.aggregate(items, none, lambda a, x: F.when((F.size(a) >= target) | F.exists(a, lambda y: like(x, y) > S.diversity_at_most), a).otherwise(F.array_append(a, x)))

    def topped(chosen: Column, items: Column) -> Column:
        missing = F.filter(items, lambda x: ~F.exists(chosen, lambda y: y["key"] == x["key"]))
        return F.concat(chosen, F.slice(missing, F.lit(1), F.greatest(F.lit(0), F.lit(least) - F.size(chosen))))

    out = grouped.withColumn("target", target_count(complexity_score(F.col("query")), F.size("items"), least, most)).withColumn("items", let(F.col("items"), without_twins))
    out = out.withColumn("chosen", let(diverse(F.col("items"), F.col("target")), lambda c: topped(c, F.col("items"))))
    return out.select("qid", "target", F.posexplode("chosen").alias("pos", "c")).select("qid", "target", F.col("pos").alias("selected"), F.col("c.key").alias(key), (-F.col("c.neg")).alias("score"))


def selection_stats(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """By question: the share of chunks selected, average scores of all and of the selected, the share of score kept; zeros if none is selected."""
    a = chunks.groupBy("qid").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score_original"), F.sum("score").alias("total"))
    b = selected.groupBy("qid").agg(F.count("*").alias("m"), F.avg("score").alias("avg_score_selected"), F.sum("score").alias("kept"))
    zero = F.lit(0.0)
    return a.join(b, "qid", "left").select(
        "qid",
        F.coalesce(F.col("m") / F.col("n"), zero).alias("compression_ratio"),
        F.when(F.col("m").isNotNull(), F.col("avg_score_original")).otherwise(0.0).alias("avg_score_original"),
        F.coalesce("avg_score_selected", zero).alias("avg_score_selected"),
        F.when(F.col("total") > 0, F.coalesce(F.col("kept") / F.col("total"), zero)).otherwise(0.0).alias("score_retention"),
    )


# ---------------------------------------------------------------------------------------- citations


def citations(results: DataFrame, order: str = "rank", chunk: str = "doc_id") -> DataFrame:
    """Numbers chunks by first appearance, each chunk once."""
    first = results.groupBy("qid", chunk).agg(F.min(order).alias("first"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("first", chunk))
    return first.select("qid", chunk, n.alias("citation_number"), F.concat(F.lit("cite_"), n).alias("citation_id"))


def citation_stats(cited: DataFrame, document: str = "doc_id") -> DataFrame:
    return cited.groupBy("qid").agg(F.count("*").alias("total"), F.countDistinct(document).alias("documents"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


def top_documents(cited: DataFrame, k: int = 5, document: str = "doc_id") -> DataFrame:
    """The k most cited documents of each question (ties by id)."""
    n = cited.groupBy("qid", document).agg(F.count("*").alias("citations"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("citations"), document))
    return n.withColumn("place", place).where(F.col("place") <= k)


def citations_where(cited: DataFrame, least: float | None = None, **equal) -> DataFrame:
    """Citations of a score of at least `least`, whose columns named in `equal` have those values."""
    out = cited if least is None else cited.where(F.col("score") >= least)
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def invalid_citations(text: Column, valid: Column) -> Column:
    from ..functions.text import cited_numbers

    return F.array_sort(F.array_except(cited_numbers(text), valid))


def context(results: DataFrame, number: str = "rank", document: str = "doc_id") -> DataFrame:
    """(qid, context): the chunks with their numbers, documents and scores, in order."""
    block = F.format_string("[C%d] [Document: %s, Score: %.3f]\n%s", F.col(number), F.col(document).cast("string"), F.col("score"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("b"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def formatted(cited: DataFrame) -> DataFrame:
    """(qid, citations): one numbered line a citation. cited: qid, citation_number, doc_id, score, content."""
    line = F.format_string("[%d] %s (%.2f): %s", F.col("citation_number"), F.col("doc_id").cast("string"), F.col("score"), preview(F.col("content"), 100))
    ordered = F.array_sort(F.collect_list(F.struct("citation_number", line.alias("line"))))
    return cited.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("citations"))


def cite_sentences(answers: DataFrame, cited: DataFrame, least: float = 0.3) -> DataFrame:
    """Each sentence of an answer with the citation whose words cover most of it, if more than `least`.

    answers: qid, answer; cited: qid, citation_number, content.
    """
    s = answers.select("qid", F.posexplode(sentences(F.col("answer"))).alias("pos", "sentence"))
    s = s.withColumn("sw", F.array_distinct(words(F.lower("sentence"))))
    pairs = s.join(cited.select("qid", "citation_number", F.array_distinct(words(F.lower("content"))).alias("cw")), "qid", "left")
    overlap = F.size(F.array_intersect("sw", "cw")) / F.size("sw")
    scored = pairs.withColumn("overlap", F.when(overlap > least, overlap))
    best = F.row_number().over(Window.partitionBy("qid", "pos").orderBy(F.desc_nulls_last("overlap"), "citation_number"))
    return scored.withColumn("r", best).where("r = 1").select("qid", "pos", "sentence", F.when(F.col("overlap").isNotNull(), F.col("citation_number")).alias("citation_number"))


def with_citations(answers: DataFrame, cited: DataFrame, least: float = 0.6, mark: str = "[%d]") -> DataFrame:
    """(qid, answer): the answer's sentences, one space between, each followed by the mark of the citation that covers most
    of its words, if more than `least`. A question's sentences meet in one row, as long as its answer."""
    s = cite_sentences(answers, cited, least)
    said = F.when(F.col("citation_number").isNotNull(), F.concat("sentence", F.lit(" "), F.format_string(mark, "citation_number"))).otherwise(F.col("sentence"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", said.alias("said"))))
    whole = s.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), " ").alias("answer"))
    return answers.select("qid").join(whole, "qid", "left").select("qid", F.coalesce("answer", F.lit("")).alias("answer"))


def grouped_by_document(cited: DataFrame, scores: bool = True, most: int = 100) -> DataFrame:
    """(qid, citations): a heading a document, in order of their ids as text, and its citations below, by number."""
    cut = preview(F.col("content"), most)
    line = F.format_string("  [%d] Score: %.3f: %s", "citation_number", "score", cut) if scores else F.format_string("  [%d]: %s", "citation_number", cut)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("citation_number", line.alias("line")))), lambda x: x["line"])
    block = F.concat(F.lit("\nDocument: "), F.col("document"), F.lit("\n"), F.array_join(lines, "\n"))
    by = cited.groupBy("qid", F.col("doc_id").cast("string").alias("document")).agg(block.alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("document", "block"))), lambda x: x["block"])
    return by.groupBy("qid").agg(F.concat(F.lit("Sources by Document:\n"), F.array_join(blocks, "\n")).alias("citations"))
