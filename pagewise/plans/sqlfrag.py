"""Reusable DuckDB SQL fragments for the oracles.

The oracle SQL is written independently of the Spark code, but the regex
patterns are the same fixed values (RE2 and Java regex agree on them).
"""

from __future__ import annotations

from pagewise.functions.text import NON_WS, VOWEL_GROUP_RE, WORD_RE, WS


def r(x: str, digits: int) -> str:
    """Half-even rounding at ``digits`` decimals, same IEEE steps as Spark."""
    if digits == 0:
        return f"round_even({x}, 0)"
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def sq(s: str) -> str:
    """SQL single-quoted literal."""
    return "'" + s.replace("'", "''") + "'"


WORD = sq(WORD_RE)
NONWS = sq(NON_WS)
WSR = sq(WS)
NONWS_RUN = sq(NON_WS + "+")
VOWELS = sq(VOWEL_GROUP_RE)


def ws_trim(x: str) -> str:
    return f"regexp_replace({x}, {sq(f'^{WS}+|{WS}+$')}, '', 'g')"


def ws_count(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, {NONWS_RUN})), 0)::BIGINT"


def syllable_lambda(var: str = "x") -> str:
    return (f"lambda {var}: CASE WHEN length({var}) = 0 THEN 0 WHEN length({var}) <= 3 THEN 1 "
            f"ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower({var}), 'e$', ''), {VOWELS}))) END")


def readability_sql(src: str, key: str, text: str, extra: str = "") -> str:
    """SELECT producing ``key`` (+extra cols) and the 19 readability fields."""
    ex = (extra + ", ") if extra else ""
    short = "wc < 10"
    asl = "(wc / sc)"
    asw = "(syl_n / greatest(wc, 1))"
    awl = "(chars / greatest(wc, 1))"
    fre = f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {r(f'206.835::DOUBLE - 1.015::DOUBLE * {asl} - 84.6::DOUBLE * {asw}', 1)}))"
    fk = f"greatest(0.0::DOUBLE, {r(f'0.39::DOUBLE * {asl} + 11.8::DOUBLE * {asw} - 15.59::DOUBLE', 1)})"
    big_l = "((chars / greatest(wc, 1)) * 100.0::DOUBLE)"
    big_s = "((sc / greatest(wc, 1)) * 100.0::DOUBLE)"
    cli = f"greatest(0.0::DOUBLE, {r(f'0.0588::DOUBLE * {big_l} - 0.296::DOUBLE * {big_s} - 15.8::DOUBLE', 1)})"
    ari = f"greatest(0.0::DOUBLE, {r(f'4.71::DOUBLE * {awl} + 0.5::DOUBLE * {asl} - 21.43::DOUBLE', 1)})"
    level = (f"CASE WHEN f >= 90 THEN 'Very Easy (5th grade)' WHEN f >= 80 THEN 'Easy (6th grade)' "
             f"WHEN f >= 70 THEN 'Fairly Easy (7th grade)' WHEN f >= 60 THEN 'Standard (8th-9th grade)' "
             f"WHEN f >= 50 THEN 'Fairly Difficult (10th-12th grade)' WHEN f >= 30 THEN 'Difficult (College)' "
             f"ELSE 'Very Difficult (Graduate)' END")
    return f"""
    (WITH r_s AS (
        SELECT {ex}{key}, regexp_extract_all({text}, {WORD}) AS w,
               len(list_filter(regexp_split_to_array({text}, '[.!?]+'), lambda p: regexp_matches(p, {NONWS}))) AS sent_raw
        FROM {src}
    ), r_t AS (
        SELECT *, list_transform(w, {syllable_lambda()}) AS syl FROM r_s
    ), r_m AS (
        SELECT * EXCLUDE (w, syl, sent_raw),
               len(w)::BIGINT AS wc, greatest(sent_raw, 1)::BIGINT AS sc,
               length(array_to_string(w, ''))::BIGINT AS chars,
               coalesce(list_sum(syl), 0)::BIGINT AS syl_n,
               len(list_distinct(list_transform(w, lambda x: lower(x))))::BIGINT AS uniq,
               len(list_filter(syl, lambda s: s >= 3))::BIGINT AS cx
        FROM r_t
    ), r_f AS (
        SELECT *, {fre} AS f, {fk} AS fk, {cli} AS cli, {ari} AS ari FROM r_m
    )
    SELECT {ex}{key},
        CASE WHEN {short} THEN 0.0 ELSE f END AS flesch_reading_ease,
        CASE WHEN {short} THEN 0.0 ELSE fk END AS flesch_kincaid_grade,
        CASE WHEN {short} THEN 0.0 ELSE cli END AS coleman_liau_index,
        CASE WHEN {short} THEN 0.0 ELSE ari END AS automated_readability_index,
        CASE WHEN {short} THEN 0.0 ELSE {r('(fk + cli + ari) / 3.0::DOUBLE', 1)} END AS avg_grade_level,
        CASE WHEN {short} THEN 'Too short to analyze' ELSE {level} END AS reading_level,
        sc AS sentence_count, wc AS word_count, syl_n AS syllable_count, chars AS char_count,
        CASE WHEN {short} THEN 0.0 ELSE {r(asl, 1)} END AS avg_sentence_length,
        CASE WHEN {short} THEN 0.0 ELSE {r(awl, 1)} END AS avg_word_length,
        CASE WHEN {short} THEN 0.0 ELSE {r(asw, 2)} END AS avg_syllables_per_word,
        uniq AS unique_words,
        CASE WHEN {short} THEN 0.0 ELSE {r('uniq / greatest(wc, 1)', 3)} END AS vocabulary_density,
        CASE WHEN {short} THEN 0 ELSE cx END::BIGINT AS complex_word_count,
        CASE WHEN {short} THEN 0.0 ELSE {r('(cx / greatest(wc, 1)) * 100.0::DOUBLE', 1)} END AS complex_word_pct,
        CASE WHEN {short} THEN 0 ELSE {r('(wc / 238.0::DOUBLE) * 60.0::DOUBLE', 0)} END::BIGINT AS reading_time_seconds,
        CASE WHEN {short} THEN 0.0 ELSE {r('wc / 238.0::DOUBLE', 1)} END AS reading_time_minutes
    FROM r_f)"""


def stopword_list() -> str:
    from pagewise.operators.terms import STOPWORDS
    return ", ".join(sq(w) for w in sorted(STOPWORDS))


def tf_ctes(texts: str, id_col: str = "text_id", text_col: str = "text") -> str:
    """CTEs ``tf_w`` (exploded words) and ``tf`` (id, term, tf, first_pos)."""
    return f"""tf_w AS (
        SELECT {id_col} AS text_id, unnest(w) AS term, unnest(range(len(w))) AS pos
        FROM (SELECT {id_col}, regexp_extract_all({text_col}, {WORD}) AS w FROM {texts})),
    tf AS (SELECT text_id, term, count(*)::BIGINT AS tf, min(pos)::INTEGER AS first_pos
           FROM tf_w GROUP BY text_id, term)"""


def kw_ctes() -> str:
    """CTEs ``kw`` (text_id, term, tf, kw_rank) and ``kwset`` (text_id, keywords) over ``tf``."""
    return f"""kw_cand AS (
        SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY tf DESC, first_pos) AS freq_rank
        FROM tf QUALIFY freq_rank <= 60),
    kw AS (
        SELECT text_id, term, tf, row_number() OVER (PARTITION BY text_id ORDER BY freq_rank) AS kw_rank
        FROM kw_cand WHERE term NOT IN ({stopword_list()}) AND length(term) >= 3
        QUALIFY kw_rank <= 20),
    kwset AS (SELECT text_id, list_sort(list(term)) AS keywords FROM kw GROUP BY text_id)"""


def norms_cte() -> str:
    return """norms AS (SELECT text_id, sum(tf)::BIGINT AS n_words, count(*)::BIGINT AS n_terms,
                               sum(tf * tf)::BIGINT AS sum_sq FROM tf GROUP BY text_id)"""


def dot_cte(pairs: str = "pairs") -> str:
    return f"""dots AS (
        SELECT p.pair_id, sum(l.tf * r.tf)::BIGINT AS dot
        FROM {pairs} p JOIN tf l ON l.text_id = p.left_id
                       JOIN tf r ON r.text_id = p.right_id AND r.term = l.term
        GROUP BY p.pair_id)"""


def cosine_sql(dot: str, l: str, r_: str) -> str:
    return (f"CASE WHEN coalesce({l}, 0) = 0 OR coalesce({r_}, 0) = 0 THEN 0.0 "
            f"ELSE {r(f'coalesce({dot}, 0)::DOUBLE / (sqrt({l}::DOUBLE) * sqrt({r_}::DOUBLE))', 4)} END")


def list_minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
