"""Text scalar expressions: whitespace, words, sentences, syllables, rounding.

All of these are native Catalyst expressions (regex + higher-order array
functions); nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's str.split()/str.strip(),
# spelled as one regex class that Java regex and RE2 both accept.
WS_CLASS = (r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CLASS}]"
NON_WS = f"[^{WS_CLASS}]"
# The same for Java's regex only: visible ASCII is let through before the long class is tried.
NON_WS_JAVA = f"[!-~{NON_WS}]"
# The same set as characters, for trimming.
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
            + "\u2028\u2029\u202f\u205f\u3000")

# A word is a maximal run of ASCII letters; sentences end at
# runs of . ! ?; syllables are runs of these vowels.
WORD_RE = r"[a-zA-Z]+"
SENTENCE_SPLIT_RE = r"[.!?]+"
VOWEL_GROUP_RE = r"[aeiouy]+"


def lit_re(pattern: str) -> Column:
    return F.lit(pattern)


def ws_trim(c: Column) -> Column:
    """Python ``str.strip()``: trims the full Unicode whitespace set."""
    return F.btrim(c, F.lit(WS_CHARS))


def ws_tokens(c: Column) -> Column:
    """Python ``str.split()`` tokens."""
    return F.regexp_extract_all(c, lit_re(f"{NON_WS_JAVA}+"), F.lit(0))


def ws_word_count(c: Column) -> Column:
    """Whitespace token count (``len(text.split())``); 0 for NULL."""
    return F.coalesce(F.size(ws_tokens(c)), F.lit(0)).cast("long")


def is_blank(c: Column) -> Column:
    """``not text.strip()`` — NULL counts as blank."""
    return F.coalesce(~c.rlike(NON_WS), F.lit(True))


def words(c: Column) -> Column:
    """Letter-run words."""
    return F.regexp_extract_all(c, lit_re(WORD_RE), F.lit(0))


def syllables_of(w: Column) -> Column:
    """Heuristic syllable count of one word (lower-cased inside)."""
    lw = F.lower(w)
    vowel_groups = F.size(F.regexp_extract_all(
        F.regexp_replace(lw, lit_re("e$"), F.lit("")), lit_re(VOWEL_GROUP_RE), F.lit(0)))
    return (F.when(F.length(lw) == 0, F.lit(0))
             .when(F.length(lw) <= 3, F.lit(1))
             .otherwise(F.greatest(F.lit(1), vowel_groups)))


def sentence_pieces(c: Column) -> Column:
    return F.filter(F.split(c, SENTENCE_SPLIT_RE, -1), lambda s: s.rlike(NON_WS))


# A sentence piece runs from its first non-blank character to the next [.!?]
# delimiter: one match per non-blank piece, linear in the text.
SENTENCE_PIECE_RE = f"[^.!?{WS_CLASS}][^.!?]*"


def sentence_count(c: Column) -> Column:
    """Non-blank pieces between runs of . ! ? (compiled regex count)."""
    return F.coalesce(F.regexp_count(c, F.lit(SENTENCE_PIECE_RE)), F.lit(0)).cast("long")


def round_half_even(c: Column, digits: int) -> Column:
    """Python ``round(x, digits)`` on doubles: half-to-even on x*10^d.

    The SQL oracle uses ``round_even(x*10^d, 0)/10^d`` — the same IEEE steps.
    """
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def truncate_text(c: Column, limit: int) -> Column:
    """Over ``limit`` chars -> first ``limit`` chars + '...'."""
    return F.when(F.length(c) > limit,
                  F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def excerpt(c: Column, limit: int = 300) -> Column:
    return F.when(F.length(c) > limit,
                  F.concat(ws_trim(F.substring(c, 1, limit)), F.lit("..."))
                  ).otherwise(ws_trim(c))
