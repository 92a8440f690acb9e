"""URLs against a table of block patterns, without trying every pattern on every URL.

A pattern that matches must find its longest required literal (a run of
characters that no choice, option or repetition can leave out). Up to ``GRAM``
first characters of it are the pattern's key; a URL has all its substrings of
the lengths that the table's keys have. Both meet in an equi-join, and only
those candidates are tried. Patterns without a required literal have the empty
key, which every URL has: these, and only these, are tried on all URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions.html import bind

GRAM = 6
_GAP = "\u0001"


_TOKEN_RE = r"(?s)\\[pP]\{[^}]*\}|\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|."
_CODED_RE = r"^\\[xuUQEkcN0-9]"  # a character by its code, a quotation, a reference


def required_literal(pattern: Column) -> Column:
    """The longest run of characters that every match holds, lower-case; '' if none
    is certain (groups, alternatives, references and coded characters are not looked into)."""
    def said(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            after = F.coalesce(F.get(tokens, i + 1), F.lit(""))
            may_miss = after.isin("?", "*") | after.rlike(r"^\{")
            return (F.when(may_miss | t.rlike(r"^\\[a-zA-Z0-9]|^\[.|^\{") | t.isin(".", "^", "$", "+", "?", "*"), F.lit(_GAP))
                     .when(F.length(t) == 2, F.substring(t, 2, 1)).otherwise(t))
        unsure = F.exists(tokens, lambda t: t.isin("|", "(", ")", "[") | t.rlike(_CODED_RE))
        return F.when(unsure, F.lit("")).otherwise(F.array_join(F.transform(tokens, one), ""))
    runs = F.split(bind(F.regexp_extract_all(pattern, F.lit(_TOKEN_RE), F.lit(0)), said), _GAP, -1)
    return F.lower(F.aggregate(runs, F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a)))


def pattern_keys(patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """``pattern, key`` of the trimmed, non-empty, different patterns."""
    rows = patterns.select(F.trim(F.col(pattern_col)).alias("pattern")).where("pattern <> ''").distinct()
    return rows.select("pattern", F.substring(required_literal(F.col("pattern")), 1, GRAM).alias("key"))


def pattern_hits(urls: DataFrame, patterns: DataFrame, url_col: str = "url", pattern_col: str = "pattern") -> DataFrame:
    """``(url, pattern)`` for every different URL and pattern that matches somewhere
    in it, case ignored. Nulls match nothing."""
    keys = pattern_keys(patterns, pattern_col)
    lengths = [r["n"] for r in keys.select(F.length("key").alias("n")).distinct().orderBy("n").collect()]  # at most GRAM + 1
    seen = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().withColumn("low", F.lower("url"))

    def grams(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        starts = F.sequence(F.lit(1), F.greatest(F.length("low") - (n - 1), F.lit(1)))
        return F.when(F.length("low") >= n, F.transform(starts, lambda i: F.substring(F.col("low"), i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))
    own = F.array_distinct(F.concat(*map(grams, lengths))) if lengths else F.array().cast("array<string>")
    met = seen.select("url", F.explode(own).alias("key")).join(keys, "key")
    return met.where(F.rlike("url", F.concat(F.lit("(?i)"), F.col("pattern")))).select("url", "pattern")
