"""Text cleaning, metadata and scalar text functions, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let, strip

#: Lines that match one of these, in any case, are boilerplate.
BOILERPLATE_LINES = [
    r"Page \d+ of \d+",
    r"^\d+$",
    r"Copyright ©? \d{4}",
    r"All rights reserved",
    r"Confidential",
    r"\[Date\]",
    r"\[Page \d+\]",
]
#: Distinct lines after which line de-duplication forgets what it has seen.
SEEN_LINES = 1000


def strip_controls(text: Column) -> Column:
    """CR becomes LF; other control characters below U+0020, but tab and LF, go."""
    return F.regexp_replace(F.translate(text, "\r", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def strip_artifacts(text: Column) -> Column:
    """Form feeds and byte-order marks go; runs of blank lines become one; runs of spaces and tabs one space."""
    out = F.translate(text, "\x0c﻿", "")
    out = F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, " +", " "), r"\t *", " ")


def normalize_whitespace(text: Column) -> Column:
    """Unix line ends, single spaces, no trailing blanks, single blank lines, none at either end."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    out = F.regexp_replace(out, r"[ \t\x0B\f]+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"\A\n+|\n+\z", "")


def drop_boilerplate(text: Column) -> Column:
    pattern = "(?i)" + "|".join(BOILERPLATE_LINES)
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(pattern))), "\n")


def dedupe_lines(text: Column) -> Column:
    """Lines equal to an earlier one (trimmed, lower case) go; blank lines stay. After SEEN_LINES distinct lines the memory starts anew."""

    def key(line: Column) -> Column:
        return F.lower(strip(line))

    def of_lines(lines: Column) -> Column:
        def simple(keys: Column) -> Column:
            return F.filter(lines, lambda x, i: (key(x) == "") | (F.array_position(keys, key(x)) == i + 1))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))

        def step(a: Column, x: Column) -> Column:
            k = key(x)
            new = (k != "") & ~F.array_contains(a["seen"], k)
            grown = F.when(new, F.array_append(a["seen"], k)).otherwise(a["seen"])
            kept = F.when((k == "") | new, F.array_append(a["out"], x)).otherwise(a["out"])
            return F.struct(kept.alias("out"), F.when(F.size(grown) > SEEN_LINES, F.array().cast("array<string>")).otherwise(grown).alias("seen"))

        folded = F.aggregate(lines, start, step, lambda a: a["out"])
        keys = F.transform(lines, key)
        return let(keys, lambda ks: F.when(F.size(F.array_distinct(ks)) <= SEEN_LINES, simple(ks)).otherwise(folded))

    return F.array_join(let(F.split(text, "\n"), of_lines), "\n")


def final_cleanup(text: Column) -> Column:
    return F.concat(strip(text), F.lit("\n"))


def _repaired(t: str | None) -> str | None:
    if t is None:
        return None
    if any("\xc2" <= c <= "\xf4" for c in t):
        try:
            t = t.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", t)


def repair_encoding(text: Column) -> Column:
    """NFC, after undoing UTF-8 that was read as Latin-1 where that round-trips."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_repaired)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def clean(text: Column, boilerplate: bool = False, encoding: bool = False) -> Column:
    """The whole cleaning sequence; empty text stays empty."""
    out = repair_encoding(text) if encoding else text
    out = normalize_whitespace(strip_artifacts(strip_controls(out)))
    if boilerplate:
        out = drop_boilerplate(out)
    return F.when(text == "", "").otherwise(final_cleanup(dedupe_lines(out)))


# ----------------------------------------------------------------------------------------- metadata


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def title(text: Column) -> Column:
    """Of the first 20 lines, the first that is a `# ` heading, is underlined with =, or is short and all capitals."""

    def of_lines(lines: Column) -> Column:
        def candidate(raw: Column, i: Column) -> Column:
            line = strip(raw)
            under = strip(F.coalesce(F.get(lines, i + 1), F.lit("")))
            caps = (F.length(line) < 100) & (F.upper(line) == line) & F.rlike(line, F.lit(r"\p{Lu}")) & ~F.rlike(line, F.lit(r"\p{Ll}")) & (word_count(line) <= 10)
            return F.when(F.startswith(line, F.lit("# ")), strip(F.substr(line, F.lit(3)))).when((line != "") & (F.rlike(under, F.lit("^=+$")) | caps), line)

        return F.get(F.filter(F.transform(lines, candidate), lambda t: t.isNotNull()), F.lit(0))

    return let(F.slice(F.split(text, "\n"), 1, 20), of_lines)


def first_short_line(text: Column) -> Column:
    """The first non-empty of the first ten lines, if shorter than 200 characters."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), strip)
    return F.get(F.filter(lines, lambda x: (x != "") & (F.length(x) < 200)), F.lit(0))


def front_matter(text: Column, field: str) -> Column:
    block = F.regexp_extract(text, r"\A---\s*\n(?s:(.*?))\n---\s*\n", 1)
    return F.nullif(strip(F.regexp_extract(block, rf"(?m)^{field}:\s*(.*)$", 1)), F.lit(""))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---\s*\n(?s:.*?)\n---\s*\n", "")


def headings(text: Column) -> Column:
    """Markdown headings with their marks."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.rlike(x, F.lit(r"^#{1,6}\s+.+$")))


#: Function words by language, for detection by counting.
LANGUAGE_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "was", "for", "with", "on", "as", "this", "by", "are"],
    "fr": ["le", "la", "les", "des", "de", "et", "un", "une", "dans", "que", "qui", "pour", "sur", "au", "en"],
    "de": ["der", "die", "das", "und", "ist", "von", "mit", "den", "ein", "eine", "zu", "im", "nicht", "für", "in"],
    "es": ["el", "la", "los", "las", "de", "y", "un", "una", "que", "en", "por", "con", "del", "para", "se"],
}


def language(text: Column, limit: int = 1000) -> Column:
    """The language with most function words among the first `limit` characters; null without any."""
    tokens = F.split(F.lower(F.substring(text, 1, limit)), r"[^\p{L}]+")

    def best(ts: Column) -> Column:
        def count(known: list[str]) -> Column:
            return F.size(F.filter(ts, lambda t: t.isin(known)))

        top = F.greatest(*[F.struct(count(known).alias("n"), F.lit(lang).alias("lang")) for lang, known in LANGUAGE_WORDS.items()])
        return F.when(top["n"] > 0, top["lang"])

    return let(tokens, best)


# ------------------------------------------------------------------------------------ scalar functions


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def session_tokens(text: Column) -> Column:
    """Estimate for a message: length // 4 + 1, and 0 for empty text."""
    return F.when(F.length(text) > 0, F.floor(F.length(text) / 4) + 1).otherwise(0).cast("long")


def search_tokens(text: Column) -> Column:
    """Lower case, split at white space, only letters and digits kept inside each word, words of one or two dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda w: F.length(w) > 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; 0 if either is empty."""

    def of_sets(x: Column, y: Column) -> Column:
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)

    return let(words(F.lower(a)), lambda x: let(words(F.lower(b)), lambda y: of_sets(x, y)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def cited_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))))


def numeric_score(reply: Column) -> Column:
    """The first number of a model's reply, clamped to 0..10; 5 without one."""
    found = F.nullif(F.regexp_extract(reply, r"\d+\.?\d*", 0), F.lit("")).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(10.0), found)), F.lit(5.0))


def categorical_score(reply: Column) -> Column:
    up = F.upper(reply)
    return F.when(F.contains(up, F.lit("HIGH")), 8.0).when(F.contains(up, F.lit("MEDIUM")), 5.0).when(F.contains(up, F.lit("LOW")), 2.0).otherwise(5.0)


def final_answer(output: Column) -> Column:
    """What follows `=` in the first line that sets final_answer, without quotes; else the last line that isn't blank."""

    def of_lines(lines: Column) -> Column:
        said = F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("final_answer")) & F.contains(x, F.lit("=")))
        value = F.regexp_replace(strip(F.regexp_replace(F.get(said, F.lit(0)), r"\A[^=]*=", "")), "^[\"']+|[\"']+$", "")
        rest = F.filter(F.transform(lines, strip), lambda x: x != "")
        return F.when(F.size(said) > 0, value).otherwise(F.coalesce(F.try_element_at(rest, F.lit(-1)), F.lit("")))

    return let(F.split(output, "\n"), of_lines)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def session_cache_key(question: Column, context: Column) -> Column:
    return F.sha2(F.concat(F.lower(strip(question)), F.lit("|"), F.lower(strip(F.substring(F.coalesce(context, F.lit("")), 1, 1000)))), 256)


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def file_name(name: Column) -> Column:
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit(255))


def memory_bytes(size: Column) -> Column:
    """512m, 2g, 100k, 7b or plain bytes."""
    low = F.lower(strip(size))
    number = F.regexp_extract(low, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(low, r"([kmgb])b?$", 1)
    return F.round(number * F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).otherwise(1)).cast("long")


#: Substrings that make code unsafe.
DANGEROUS_IMPORTS = ["os.system", "os.popen", "os.spawn", "subprocess.call", "subprocess.run", "subprocess.Popen", "pty.spawn", "socket.socket", "urllib.request", "http.client"]
DANGEROUS_BUILTINS = ["__import__", "eval", "exec", "compile", "open", "exit", "quit"]


def code_warnings(code: Column, allowed: list[str] | None = None) -> Column:
    """What makes a piece of code unsafe, sorted."""
    imports = [p for p in DANGEROUS_IMPORTS if allowed is None or p.split(".")[0] not in allowed]
    found = [F.when(F.contains(code, F.lit(p)), F.lit(f"import {p}")) for p in imports]
    found += [F.when(F.contains(code, F.lit(b)), F.lit(f"builtin {b}")) for b in DANGEROUS_BUILTINS]
    found.append(F.when(F.rlike(code, F.lit(r"from\s+\S+\s+import\s+\*")), F.lit("wildcard import")))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%.0fms", ms)).when(ms < 60000, F.format_string("%.1fs", ms / 1000)).otherwise(F.format_string("%.1fm", ms / 60000))
