"""Text-level queries over ``documents`` (and ``conversations``):
words, sentences, syllables, the readability record and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.functions import text as tx
from pagewise.functions.readability import with_readability
from pagewise.plans.registry import query
from pagewise.plans.sqlfrag import NONWS, WORD, r, readability_sql, syllable_lambda, ws_count, ws_trim
from pagewise.session import spread
from pagewise.sources import tables as src


def _readability(spark, sf):
    docs = spread(src.documents(spark, sf)).select("doc_id", "text")
    return with_readability(docs, "text", keep=["doc_id"])


@query("readability", group="text", oracle=f"SELECT * FROM {readability_sql('documents', 'doc_id', 'text')}")
def q_readability(spark, sf):
    return _readability(spark, sf)


@query("text_words", group="text", oracle=f"""
SELECT doc_id, len(w)::BIGINT AS word_count, array_to_string(w, ' ') AS words_text
FROM (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents)""")
def q_text_words(spark, sf):
    d = spread(src.documents(spark, sf)).select("doc_id", tx.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("word_count"),
                    F.array_join("w", " ").alias("words_text"))


@query("sentence_count", group="text", oracle=f"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: regexp_matches(p, {NONWS})))::BIGINT AS sentence_count
FROM documents""")
def q_sentence_count(spark, sf):
    return spread(src.documents(spark, sf)).select("doc_id", tx.sentence_count(F.col("text")).alias("sentence_count"))


@query("syllables", group="text", oracle=f"""
SELECT lang, syllables, count(*)::BIGINT AS n_words, count(DISTINCT lower(word))::BIGINT AS n_distinct
FROM (SELECT lang, unnest(w) AS word, unnest(list_transform(w, {syllable_lambda()})) AS syllables
      FROM (SELECT lang, regexp_extract_all(text, {WORD}) AS w FROM documents))
GROUP BY lang, syllables""")
def q_syllables(spark, sf):
    """Syllable histogram per language: explode (word, syllables) pairs and
    aggregate (partial aggregation happens map-side before the shuffle)."""
    d = spread(src.documents(spark, sf)).select("lang", tx.words(F.col("text")).alias("w"))
    d = d.select("lang", F.explode("w").alias("word"))
    d = d.select("lang", "word", tx.syllables_of(F.col("word")).cast("long").alias("syllables"))
    return d.groupBy("lang", "syllables").agg(
        F.count("*").alias("n_words"), F.countDistinct(F.lower("word")).alias("n_distinct"))


@query("text_counts", group="text", oracle=f"""
SELECT doc_id, word_count, char_count, syllable_count, sentence_count
FROM {readability_sql('documents', 'doc_id', 'text')}""")
def q_text_counts(spark, sf):
    return _readability(spark, sf).select("doc_id", "word_count", "char_count", "syllable_count", "sentence_count")


@query("reading_level", group="text", oracle=f"""
SELECT lang, reading_level, count(*)::BIGINT AS n_docs,
       {r('avg(flesch_reading_ease)', 4)} AS avg_flesch,
       max(flesch_reading_ease) AS max_flesch
FROM {readability_sql('documents', 'doc_id', 'text', extra='lang')}
GROUP BY lang, reading_level""")
def q_reading_level(spark, sf):
    docs = spread(src.documents(spark, sf)).select("doc_id", "lang", "text")
    rd = with_readability(docs, "text", keep=["doc_id", "lang"])
    return rd.groupBy("lang", "reading_level").agg(
        F.count("*").alias("n_docs"),
        tx.round_half_even(F.avg("flesch_reading_ease"), 4).alias("avg_flesch"),
        F.max("flesch_reading_ease").alias("max_flesch"))


@query("vocabulary", group="text", oracle=f"""
SELECT doc_id, unique_words, vocabulary_density, complex_word_count, complex_word_pct
FROM {readability_sql('documents', 'doc_id', 'text')}""")
def q_vocabulary(spark, sf):
    return _readability(spark, sf).select("doc_id", "unique_words", "vocabulary_density",
                                          "complex_word_count", "complex_word_pct")


@query("reading_time", group="text", oracle=f"""
SELECT doc_id, reading_time_seconds, reading_time_minutes
FROM {readability_sql('documents', 'doc_id', 'text')}""")
def q_reading_time(spark, sf):
    return _readability(spark, sf).select("doc_id", "reading_time_seconds", "reading_time_minutes")


@query("ws_word_count", group="text", oracle=f"""
SELECT doc_id, {ws_count('text')} AS ws_word_count,
       len(regexp_extract_all(text, {WORD}))::BIGINT AS letter_word_count
FROM documents""")
def q_ws_word_count(spark, sf):
    d = spread(src.documents(spark, sf))
    return d.select("doc_id", tx.ws_word_count(F.col("text")).alias("ws_word_count"),
                    F.size(tx.words(F.col("text"))).cast("long").alias("letter_word_count"))


@query("text_truncate", group="text", oracle="""
SELECT doc_id, length(t)::BIGINT AS out_chars, right(t, 3) = '...' AND length(text) > 50000 AS truncated,
       md5(t) AS text_md5
FROM (SELECT doc_id, text, CASE WHEN length(text) > 50000 THEN substr(text, 1, 50000) || '...' ELSE text END AS t
      FROM documents)""")
def q_text_truncate(spark, sf):
    d = spread(src.documents(spark, sf)).select("doc_id", "text", tx.truncate_text(F.col("text"), 50000).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("out_chars"),
                    ((F.substring("t", -3, 3) == "...") & (F.length("text") > 50000)).alias("truncated"),
                    F.md5("t").alias("text_md5"))


@query("text_excerpt", group="text", oracle=f"""
SELECT doc_id, CASE WHEN length(text) > 300 THEN {ws_trim('substr(text, 1, 300)')} || '...'
                    ELSE {ws_trim('text')} END AS excerpt
FROM documents""")
def q_text_excerpt(spark, sf):
    d = spread(src.documents(spark, sf))
    return d.select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query("readability_by_role", group="text", oracle=f"""
SELECT role, count(*)::BIGINT AS n_turns, sum(word_count)::BIGINT AS words,
       {r('avg(flesch_reading_ease)', 4)} AS avg_flesch,
       sum(CASE WHEN reading_level = 'Too short to analyze' THEN 1 ELSE 0 END)::BIGINT AS n_short
FROM {readability_sql('conversations', 'conv_id', 'text', extra='turn, role')}
GROUP BY role""")
def q_readability_by_role(spark, sf):
    conv = spread(src.conversations(spark, sf)).select("conv_id", "turn", "role", "text")
    rd = with_readability(conv, "text", keep=["role"])
    return rd.groupBy("role").agg(
        F.count("*").alias("n_turns"), F.sum("word_count").cast("long").alias("words"),
        tx.round_half_even(F.avg("flesch_reading_ease"), 4).alias("avg_flesch"),
        F.sum(F.when(F.col("reading_level") == "Too short to analyze", 1).otherwise(0)).cast("long").alias("n_short"))

