"""Readability record: Flesch, Flesch-Kincaid, Coleman-Liau, ARI, vocabulary,
reading time — all as column expressions over a per-row ``words`` array.

The word array and the syllable array are materialised in their own
projections so the regex runs once per row and feeds every metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions.text import (
    VOWEL_GROUP_RE,
    round_half_even as rnd,
    sentence_count,
)

# Reading speed and the formula constants.
WORDS_PER_MINUTE = 238
SHORT_TEXT_WORDS = 10
TOO_SHORT_LABEL = "Too short to analyze"

# Flesch reading-ease bands (lower bound, label), highest first.
READING_LEVELS = [
    (90, "Very Easy (5th grade)"),
    (80, "Easy (6th grade)"),
    (70, "Fairly Easy (7th grade)"),
    (60, "Standard (8th-9th grade)"),
    (50, "Fairly Difficult (10th-12th grade)"),
    (30, "Difficult (College)"),
]
HARDEST_LEVEL = "Very Difficult (Graduate)"

READABILITY_FIELDS = [
    "flesch_reading_ease", "flesch_kincaid_grade", "coleman_liau_index",
    "automated_readability_index", "avg_grade_level", "reading_level",
    "sentence_count", "word_count", "syllable_count", "char_count",
    "avg_sentence_length", "avg_word_length", "avg_syllables_per_word",
    "unique_words", "vocabulary_density", "complex_word_count", "complex_word_pct",
    "reading_time_seconds", "reading_time_minutes",
]


def reading_level(score: Column) -> Column:
    expr = None
    for bound, label in READING_LEVELS:
        expr = (F.when(score >= bound, F.lit(label)) if expr is None
                else expr.when(score >= bound, F.lit(label)))
    return expr.otherwise(F.lit(HARDEST_LEVEL))


# Whole-text syllable arithmetic. Over the lower-cased words joined by single
# spaces: a word of <= 3 letters is 1 syllable; a longer word drops one
# trailing "e" and counts its vowel groups, at least 1. So the total is
#   (#short words) + (#vowel groups in long words) + (#long words left
#   without a vowel),
# and a complex word (>= 3 syllables) is a long word with >= 3 vowel groups.
# All four are compiled regex counts per row — no per-word lambda.
SHORT_WORD_RE = r"\b[a-z]{1,3}\b"
TRAILING_E_RE = r"e\b"
NO_VOWEL_WORD_RE = r"\b[b-df-hj-np-tv-xz]+\b"
COMPLEX_WORD_RE = r"\b[b-df-hj-np-tv-xz]*[aeiouy]+(?:[b-df-hj-np-tv-xz]+[aeiouy]+){2}"
LONG_WORD_RE = r"[a-z]{4,}"
NON_LETTER_RUN_RE = r"[^a-zA-Z]+"


def with_text_stats(df: DataFrame, text_col: str, p: str = "_r_") -> DataFrame:
    """Stages 1-3 (internal columns): the letter words as one lower-cased,
    single-space-separated string (non-letter runs collapsed — no word array
    is materialised); the long words with the trailing e dropped; then the
    base counts. Each stage is its own projection and every regex result is
    referenced by attribute, so each regex runs once per row."""
    staged = df.withColumns({
        f"{p}lw": F.lower(F.trim(F.regexp_replace(F.col(text_col), F.lit(NON_LETTER_RUN_RE), F.lit(" ")))),
        f"{p}sent_raw": sentence_count(F.col(text_col)),
    })
    staged = staged.withColumns({
        f"{p}stripped": F.regexp_replace(
            F.regexp_replace(F.col(f"{p}lw"), F.lit(SHORT_WORD_RE), F.lit("")),
            F.lit(TRAILING_E_RE), F.lit("")),
    })
    lw, stripped = F.col(f"{p}lw"), F.col(f"{p}stripped")
    n_spaces = F.length(lw) - F.length(F.replace(lw, F.lit(" "), F.lit("")))
    wc = F.when(F.coalesce(lw, F.lit("")) == "", F.lit(0)).otherwise(n_spaces + 1).cast("long")
    n_long = F.regexp_count(lw, F.lit(LONG_WORD_RE)).cast("long")
    return staged.withColumns({
        f"{p}wc": wc,
        f"{p}sc": F.greatest(F.col(f"{p}sent_raw"), F.lit(1)).cast("long"),
        f"{p}chars": F.coalesce(F.length(F.replace(lw, F.lit(" "), F.lit(""))), F.lit(0)).cast("long"),
        f"{p}syl_n": ((wc - n_long) + F.regexp_count(stripped, F.lit(VOWEL_GROUP_RE))
                      + F.regexp_count(stripped, F.lit(NO_VOWEL_WORD_RE))).cast("long"),
        f"{p}uniq": F.when(wc == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.split(lw, " ")))).cast("long"),
        f"{p}cx": F.regexp_count(stripped, F.lit(COMPLEX_WORD_RE)).cast("long"),
    }).drop(f"{p}lw", f"{p}stripped", f"{p}sent_raw")


def readability_metrics(p: str = "_r_") -> dict[str, Column]:
    """Stage 4: the 19 readability fields from the staged counts."""
    wc = F.col(f"{p}wc")
    sc = F.col(f"{p}sc")
    chars = F.col(f"{p}chars")
    syllables = F.col(f"{p}syl_n")
    unique = F.col(f"{p}uniq")
    complex_n = F.col(f"{p}cx")

    # Denominators are kept >= 1 so no branch can divide by zero (the short
    # branch, wc < 10, never uses these values).
    wcd = F.greatest(wc, F.lit(1).cast("long"))
    asl = wc / sc
    asw = syllables / wcd
    awl = chars / wcd
    fre = F.greatest(F.lit(0.0), F.least(F.lit(100.0),
                     rnd(F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * asw, 1)))
    fkgl = F.greatest(F.lit(0.0), rnd(F.lit(0.39) * asl + F.lit(11.8) * asw - F.lit(15.59), 1))
    big_l = (chars / wcd) * F.lit(100.0)
    big_s = (sc / wcd) * F.lit(100.0)
    cli = F.greatest(F.lit(0.0), rnd(F.lit(0.0588) * big_l - F.lit(0.296) * big_s - F.lit(15.8), 1))
    ari = F.greatest(F.lit(0.0), rnd(F.lit(4.71) * awl + F.lit(0.5) * asl - F.lit(21.43), 1))
    avg_grade = rnd((fkgl + cli + ari) / F.lit(3.0), 1)

    short = wc < SHORT_TEXT_WORDS
    zero_d = F.lit(0.0)

    def long_only(c: Column, zero: Column = zero_d) -> Column:
        return F.when(short, zero).otherwise(c)

    return {
        "flesch_reading_ease": long_only(fre),
        "flesch_kincaid_grade": long_only(fkgl),
        "coleman_liau_index": long_only(cli),
        "automated_readability_index": long_only(ari),
        "avg_grade_level": long_only(avg_grade),
        "reading_level": F.when(short, F.lit(TOO_SHORT_LABEL)).otherwise(reading_level(fre)),
        "sentence_count": sc,
        "word_count": wc,
        "syllable_count": syllables,
        "char_count": chars,
        "avg_sentence_length": long_only(rnd(asl, 1)),
        "avg_word_length": long_only(rnd(awl, 1)),
        "avg_syllables_per_word": long_only(rnd(asw, 2)),
        "unique_words": unique,
        "vocabulary_density": long_only(rnd(unique / wcd, 3)),
        "complex_word_count": long_only(complex_n, F.lit(0).cast("long")),
        "complex_word_pct": long_only(rnd((complex_n / wcd) * F.lit(100.0), 1)),
        "reading_time_seconds": long_only(rnd((wc / F.lit(float(WORDS_PER_MINUTE))) * F.lit(60.0), 0).cast("long"),
                                          F.lit(0).cast("long")),
        "reading_time_minutes": long_only(rnd(wc / F.lit(float(WORDS_PER_MINUTE)), 1)),
    }


def with_readability(df: DataFrame, text_col: str, keep: list[str] | None = None,
                     p: str = "_r_") -> DataFrame:
    """Add the 19 readability columns (flat) for ``text_col``.

    ``keep``: other columns to carry; defaults to all input columns.
    """
    keep = list(df.columns) if keep is None else keep
    staged = with_text_stats(df, text_col, p)
    m = readability_metrics(p)
    return staged.select(*[F.col(c) for c in keep], *[m[k].alias(k) for k in READABILITY_FIELDS])


def readability_struct(p: str = "_r_") -> Column:
    m = readability_metrics(p)
    return F.struct(*[m[k].alias(k) for k in READABILITY_FIELDS])
