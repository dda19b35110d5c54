"""Rule engines over questions: complexity, strategy, cost, suggestions, batching topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import contains_any, count_contained, matches_any
from ..functions.text import word_count

# Keyword lists and patterns that decide a question's class.
MULTI_HOP = ["compare", "comparison", "versus", "vs", "difference between", "similarities", "contrast", "relationship between", "correlation", "how does X affect Y", "impact on", "influence on", "effect of", "connection between", "link between", "associated with"]
QUADRATIC = ["summarize all", "aggregate", "total", "sum of", "average of", "count all", "statistics", "metrics", "analyze everything", "comprehensive", "overall", "in total", "complete picture", "summary of entire", "key findings across", "main themes in"]
SIMPLE = ["what is", "who is", "when did", "where is", "how many", "define", "explain", "describe", "list", "name"]
EXTENSIVE = ["entire", "whole", "complete", "full", "all parts", "comprehensive", "thorough", "detailed", "extensive"]
COMPARISON = [r"\bcompare\w*\b", r"\bversus\b", r"\bvs\b", r"\bdifference\w*\b", r"\bsimilarit\w*\b", r"\bcontrast\w*\b", r"\bbetter than\b", r"\bworse than\b", r"\bsuperior\w*\b"]
AGGREGATION = [r"\bsummar\w*\b", r"\baggregat\w*\b", r"\btotal\w*\b", r"\bsum of\b", r"\baverage\w*\b", r"\bcount\w*\b", r"\ball\s+\w+", r"\bevery\w*\b", r"\boverall\b"]
STOP_WORDS = ["what", "when", "where", "which", "who", "whom", "whose", "why", "how", "that", "this", "these", "those", "with", "from", "they", "have", "were", "been", "said", "each", "will", "about", "could", "would", "should", "there"]
# USD per 1,000 tokens (input, output) for cost estimates; the order decides partial matches.
PRICES = {
    "gpt-5-nano": (0.0001, 0.0004),
    "gpt-5-mini": (0.0003, 0.0012),
    "gpt-5": (0.0010, 0.0040),
    "gpt-4o": (0.0050, 0.0150),
    "gpt-4o-mini": (0.00015, 0.0006),
    "claude-sonnet-4.5": (0.0030, 0.0150),
    "claude-opus-4.5": (0.0150, 0.0750),
    "claude-haiku": (0.00025, 0.00125),
}
DEFAULT_PRICE = (0.0010, 0.0030)
# Expected output tokens by the first family of keywords that occurs.
OUTPUT_TOKENS = [(["list", "enumerate", "what are"], 800), (["summarize", "summary", "brief"], 600), (["explain", "describe", "how does"], 1200), (["compare", "contrast", "difference"], 1500), (["analyze", "evaluation", "assessment"], 2000)]
# Topics of batched calls, in order.
TOPICS = {
    "definition": ["what is", "define", "meaning of", "explain"],
    "analysis": ["analyze", "compare", "contrast", "difference between"],
    "factual": ["when", "where", "who", "how many", "how much"],
    "causal": ["why", "how does", "what causes", "reason for"],
    "summary": ["summarize", "main points", "key findings", "overview"],
}
# What raises a question's complexity for adaptive selection.
COMPLEX_WORDS = ["compare", "contrast", "difference", "similarities", "analyze", "evaluate", "assess", "relationship", "cause", "effect", "impact", "influence", "trend", "pattern", "correlation", "summary"]
COMPLEX_STARTS = ["how", "why", "explain", "what are the", "describe"]
# What users are told of each strategy.
DESCRIPTIONS = {
    "direct_llm": "Direct LLM - Simple Q&A with full context",
    "rag": "RAG - Vector retrieval with semantic search",
    "rlm": "RLM - Recursive analysis with sub-LLM calls",
    "hybrid": "Hybrid - RAG pre-filter + RLM deep analysis",
}
DIRECT_MOST, RAG_MOST = 10_000, 500_000


def keywords(question: Column) -> Column:
    """Up to ten distinct words of four letters or more that are no stop words, sorted."""
    found = F.regexp_extract_all(question, F.lit(r"\b[a-zA-Z]{4,}\b"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(STOP_WORDS)))), 1, 10)


def analysis(question: Column) -> dict[str, Column]:
    """Columns: complexity, confidence, context_needs, reasoning_depth, chunk_access, multi_hop, comparison, aggregation."""
    q = F.lower(question)
    multi, comparison = contains_any(q, MULTI_HOP), matches_any(q, COMPARISON)
    aggregation = matches_any(q, AGGREGATION)
    quadratic = contains_any(q, QUADRATIC) | aggregation
    hop = multi | comparison
    simple = (count_contained(q, SIMPLE) >= 1) & (word_count(q) < 15)
    complexity = F.when(quadratic, "quadratic").when(hop, "multi_hop").when(simple, "simple").otherwise("single_hop")
    confidence = F.when(quadratic & multi, 0.85).when(quadratic, 0.75).when(hop, 0.80).when(simple, 0.70).otherwise(0.60)
    needs = F.when(contains_any(q, EXTENSIVE) | quadratic, "extensive").when(~quadratic & ~hop & simple, "minimal").otherwise("moderate")
    depth = F.when(complexity == "simple", 1).when(complexity == "single_hop", 2).when(complexity == "multi_hop", 3).otherwise(4)
    chunks = F.when(complexity == "simple", 1).when(complexity == "single_hop", 3).when(complexity == "multi_hop", 10).otherwise(50)
    factor = F.when(needs == "minimal", 0.5).when(needs == "moderate", 1.0).otherwise(3.0)
    return {
        "complexity": complexity,
        "confidence": confidence,
        "context_needs": needs,
        "reasoning_depth": F.least(F.lit(6), depth + comparison.cast("int") + aggregation.cast("int")),
        "chunk_access": F.floor(chunks * factor).cast("int"),
        "multi_hop": multi,
        "comparison": comparison,
        "aggregation": aggregation,
    }


def strategy(complexity: Column, context_size: Column) -> tuple[Column, Column]:
    """(strategy, confidence)."""
    complex_ = complexity.isin("multi_hop", "quadratic")
    direct = (context_size < DIRECT_MOST) & (complexity == "simple")
    rag = (complexity == "single_hop") & (context_size < RAG_MOST)
    name = F.when(direct, "direct_llm").when(rag, "rag").when(complex_ & (context_size > RAG_MOST), "hybrid").when(complex_, "rlm").otherwise("hybrid")
    sure = F.when(direct, 0.90).when(rag, 0.85).when(complex_ & (context_size > RAG_MOST), 0.88).when(complex_, 0.82).otherwise(0.75)
    return name, sure


def estimated_chunks(name: Column, chunk_access: Column) -> Column:
    return F.when(name == "direct_llm", 1).when(name.isin("rag", "hybrid"), 5).otherwise(chunk_access)


def output_tokens(question: Column) -> Column:
    q, out = F.lower(question), F.lit(1000)
    for words, n in reversed(OUTPUT_TOKENS):
        out = F.when(contains_any(q, words), n).otherwise(out)
    return out.cast("long")


def price(model: Column) -> tuple[Column, Column]:
    """USD per 1,000 tokens in and out: an exact name, else the first name contained, else the default."""
    m = F.lower(F.coalesce(model, F.lit("gpt-5-mini")))
    a, b = F.lit(DEFAULT_PRICE[0]), F.lit(DEFAULT_PRICE[1])
    for exact in (False, True):
        for name, (i, o) in reversed(PRICES.items()):
            hit = m == name if exact else F.contains(m, F.lit(name))
            a, b = F.when(hit, i).otherwise(a), F.when(hit, o).otherwise(b)
    return a, b


def cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    i, o = price(model)
    return tokens_in / 1000 * i + tokens_out / 1000 * o


def with_buffer(usd: Column, percent: int = 10) -> Column:
    return usd * (1 + percent / 100)


def strategy_costs(question: Column, context_size: Column, model: Column) -> Column:
    """array<struct<strategy, tokens_in, tokens_out, usd>> of the four strategies, by length // 4 token estimates."""
    asked = F.length(question) + 2
    out = output_tokens(question)
    whole = F.floor((asked + context_size) / 4).cast("long")
    calls = F.least(F.floor(context_size / 5000), F.lit(20)).cast("long")
    sub_in, sub_out = (len("sub-query") + 2 + 2000) // 4, 1000

    def recursive(size: Column, n: Column) -> tuple[Column, Column]:
        root = F.floor((asked + F.least(size, F.lit(10_000))) / 4)
        return (root + n * sub_in).cast("long"), (out + n * sub_out + 1000).cast("long")

    both = {
        "direct_llm": (whole, out),
        "rag": (F.floor((asked + 5 * 5000) / 4).cast("long"), F.lit(500).cast("long")),
        "rlm": recursive(context_size, calls),
        "hybrid": recursive(F.floor(context_size / 5), F.floor(calls / 2)),
    }
    return F.array(*[F.struct(F.lit(s).alias("strategy"), a.alias("tokens_in"), b.alias("tokens_out"), cost(a, b, model).alias("usd")) for s, (a, b) in both.items()])


def suggestions(question: Column, complexity: Column, context_size: Column) -> Column:
    """array<struct<kind, confidence>> by rule; a question is rewritten if one is above 0.7."""
    vague = contains_any(F.lower(question), ["everything", "all", "entire"])
    rules = [(context_size > 500_000, "chunking", 0.9), (complexity == "quadratic", "decomposition", 0.85), (vague, "keywords", 0.6)]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("confidence"))) for c, k, s in rules]), lambda x: x.isNotNull())


def topic(question: Column, context: Column) -> Column:
    """The first topic with a keyword in the question, else (suffix _ctx) in the context's first 200 characters, else mixed."""
    q, c, out = F.lower(question), F.lower(F.substring(F.coalesce(context, F.lit("")), 1, 200)), F.lit("mixed")
    for name, words in reversed(TOPICS.items()):
        out = F.when(contains_any(c, words), f"{name}_ctx").otherwise(out)
    for name, words in reversed(TOPICS.items()):
        out = F.when(contains_any(q, words), name).otherwise(out)
    return out


def complexity_score(question: Column) -> Column:
    """0 to 1, from length, complex words and the way the question starts."""
    q, n = F.lower(question), word_count(question)
    out = 0.5 + F.when(n > 20, 0.2).when(n > 10, 0.1).when(n < 5, -0.1).otherwise(0.0) + 0.05 * count_contained(q, COMPLEX_WORDS)
    for s in COMPLEX_STARTS:
        out = out + F.when(F.startswith(q, F.lit(s)), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def encoding(model: Column) -> Column:
    m = F.lower(model)
    return F.when(F.contains(m, F.lit("gpt-5")) | F.contains(m, F.lit("gpt-4o")), "o200k_base").otherwise("cl100k_base")
