"""Quality rules with risk-controlled thresholds (DataFrame functions only).

A rule rejects a document whose feature exceeds a cutoff. For each stratum and feature, every cutoff of a fixed grid
is tested on the labelled good documents, once for each distinct text, as copies are no independent trials: with k of
n texts above it, the exact binomial probability of at most k at a false-rejection rate of `risk / features` must be under `delta / tests` (Bonferroni over all strata, features and
cutoffs). The lowest cutoff that passes is used, so that with probability 1 - delta no stratum loses more than `risk`
of its good documents. Where no cutoff passes -- few labels -- the rule stays off and documents are kept.

Null text has no words (base_failed). Null strata form one of their own. Texts of any length are taken whole, as one value.
Repeated rows give repeated rows; extra columns are left out; an empty table gives no rows; without labels no rule is on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, own, save, text_of

WINDOW = 8
#: feature -> grid of cutoffs, loosest last.
GRID = {
    "symbol_ratio": [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "upper_ratio": [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "shout_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_ratio": [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3],
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, p: F.struct(x.alias("h"), p.alias("p"))))

        def positions(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["p"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(let(pairs, positions), start, step, lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The base counts and the rules' features of every whole text."""
    text = F.col("text")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    rows = own(docs, doc_id=id_col, text=text_col, stratum=stratum_col).withColumn("text", text_of("text"))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.xxhash64(text).alias("text_key"),
        counts.alias("c"),
        (F.length(text) - without(" \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
        without("!").alias("n_shout"),
    )
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("c.n_words", F.lit(1))
    return rows.select(
        "doc_id",
        "stratum",
        "text_key",
        "c.n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "c.n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("n_upper") / chars).alias("upper_ratio"),
        (F.col("n_shout") / chars).alias("shout_ratio"),
        (F.col("c.n_repeat_words") / n).alias("repeat_ratio"),
    )


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), exactly, by the recurrence of its terms in log space."""
    import math

    first = n * math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("sum"))
    odds = math.log(p) - math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(a["sum"], term) + F.log1p(F.exp(-F.abs(a["sum"] - term)))).alias("sum"))

    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda a: a["sum"])).otherwise(first)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, grid: dict[str, list[float]] = GRID) -> DataFrame:
    """stratum, feature, cutoff for every rule that passes. labels: doc_id, quality (1: good)."""
    import math

    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1").select("doc_id")
    held = measured.join(good, "doc_id").withColumn("stratum", F.coalesce(F.concat(F.lit("s"), F.col("stratum").cast("string")), F.lit("")))
    held = held.groupBy("stratum", "text_key").agg(*[F.first(f).alias(f) for f in grid])  # equal texts have equal features
    above = [F.sum(F.when(F.col(f) > c, 1).otherwise(0)).alias(f"{f}_{i}") for f, cs in grid.items() for i, c in enumerate(cs)]
    per = held.groupBy("stratum").agg(F.count("*").alias("n"), *above)
    tests = [F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cutoff"), F.col(f"{f}_{i}").alias("k")) for f, cs in grid.items() for i, c in enumerate(cs)]
    rate, n_tests = risk / len(grid), sum(map(len, grid.values()))
    strata = per.agg(F.count("*").alias("strata"))
    rows = per.select("stratum", "n", F.explode(F.array(*tests)).alias("t")).select("stratum", "n", "t.*").crossJoin(F.broadcast(strata))  # one row
    # A share of rejections at or above the rate can't pass; its long sum isn't computed.
    p_value = F.when(F.col("k") < rate * F.col("n"), log_binomial_cdf(F.col("k"), F.col("n"), rate)).otherwise(0.0)
    passed = rows.where(p_value <= F.log(F.lit(delta) / (F.col("strata") * n_tests)))
    return passed.groupBy("stratum", "feature").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, grid: dict[str, list[float]] = GRID, **cols: str) -> DataFrame:
    """Every row with its base counts, base_failed, kept and the rules that rejected it."""
    measured = save(measures(docs, **cols), "quality-measures")
    rules = cutoffs(measured, labels, risk, delta, grid).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("rules"))
    rules = save(rules.withColumnRenamed("stratum", "s"), "quality-rules")
    few = rules.limit(100_001).count() <= 100_000  # one small row for each stratum: under 50 MB
    s = F.coalesce(F.concat(F.lit("s"), F.col("stratum").cast("string")), F.lit(""))
    out = measured.join(F.broadcast(rules) if few else rules, s == F.col("s"), "left")
    hit = [F.when(F.col(f) > F.element_at(F.col("rules"), f), F.lit(f)) for f in grid]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    by = F.filter(F.array(*hit), lambda x: x.isNotNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size(by) == 0)).alias("kept"), F.concat_ws(",", by).alias("rejected_by"))


_GRID = ", ".join(f"('{f}', {i}, {c}::DOUBLE)" for i, (f, cs) in enumerate(GRID.items()) for c in cs)
_LONG = " UNION ALL ".join(f"SELECT doc_id, k, '{f}' AS feature, {f} AS v FROM x" for f in GRID)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce('s' || lang, '') AS k, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
m AS (SELECT doc_id, s FROM g GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g JOIN m USING (doc_id, s), range(0, 8) r(o) GROUP BY 1),
b AS (SELECT doc_id, k, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, t, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(t, '[^!]', '', 'g')) AS sh FROM d LEFT JOIN c USING (doc_id)),
x AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, up / greatest(word_chars, 1) AS upper_ratio, sh / greatest(word_chars, 1) AS shout_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio FROM b),
u AS ({_LONG}),
grid(feature, place, cutoff) AS (VALUES {_GRID}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING max(quality) = 1),
one AS (SELECT DISTINCT k, t, {", ".join(GRID)} FROM x JOIN good USING (doc_id)),
gu AS ({_LONG.replace("doc_id, k", "k").replace("FROM x", "FROM one")}),
tests AS (SELECT k, feature, cutoff, count(*) AS n, count(*) FILTER (WHERE v > cutoff) AS kk FROM gu JOIN grid USING (feature) GROUP BY 1, 2, 3),
terms AS (SELECT k, feature, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(0.9875))) AS p FROM (SELECT *, unnest(range(0, kk + 1)) AS i FROM tests WHERE kk < 0.0125 * n) GROUP BY 1, 2, 3),
rules AS (SELECT k, feature, min(cutoff) AS cutoff FROM terms WHERE p <= 0.05 / ((SELECT count(DISTINCT k) FROM tests) * (SELECT count(*) FROM grid)) GROUP BY 1, 2),
hits AS (SELECT doc_id, string_agg(feature, ',' ORDER BY place) AS why FROM u JOIN rules USING (k, feature) JOIN (SELECT DISTINCT feature, place FROM grid) USING (feature) WHERE v > cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND why IS NULL AS kept, coalesce(why, '') AS rejected_by FROM x LEFT JOIN hits USING (doc_id)
"""
