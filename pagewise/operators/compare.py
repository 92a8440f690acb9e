"""Pair comparison records and content-gap analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.functions.readability import with_readability
from pagewise.functions.text import is_blank, round_half_even, ws_word_count
from pagewise.operators import terms as tm
from pagewise.session import cut_lineage, spread

READABILITY_GATE = 20  # whitespace words needed before readability is reported


def text_profile(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """Per text: whitespace word count, blank flag and the readability fields
    used by comparisons (computed once per text, not once per pair). The texts
    are dealt out by their bytes: a scan may have fewer splits than there are cores."""
    base = spread(texts, tm.text_partitions(texts, text_col)).select(id_col, text_col,
                        ws_word_count(F.col(text_col)).alias("ws_words"),
                        is_blank(F.col(text_col)).alias("blank"))
    rd = with_readability(base, text_col, keep=[id_col, "ws_words", "blank"])
    return rd.select(id_col, "ws_words", "blank", "flesch_reading_ease", "avg_grade_level", "reading_level")


def compare_records(pairs: DataFrame, texts: DataFrame, id_col: str = "text_id",
                    text_col: str = "text") -> DataFrame:
    """One compare record per pair: similarity, keyword lists, whitespace word
    count difference and — when both sides have >= 20 words — readability
    differences. Pairs with a blank side get error_code NO_CONTENT."""
    # one row per text (norm, keywords, profile), joined to both sides of every pair
    j = tm.pair_similarity(pairs, texts, id_col, text_col, profile=text_profile(texts, id_col, text_col))
    both = (F.col("ws_words_1") >= READABILITY_GATE) & (F.col("ws_words_2") >= READABILITY_GATE)
    no_content = F.coalesce(F.col("blank_1"), F.lit(True)) | F.coalesce(F.col("blank_2"), F.lit(True))
    return j.select(
        "pair_id", "left_id", "right_id",
        F.when(no_content, F.lit("NO_CONTENT")).alias("error_code"),
        "similarity_score", "shared_keywords", "unique_to_text1", "unique_to_text2",
        (F.col("ws_words_1") - F.col("ws_words_2")).alias("word_count_diff"),
        F.when(both, round_half_even(F.col("flesch_reading_ease_1") - F.col("flesch_reading_ease_2"), 2))
         .alias("flesch_reading_ease_diff"),
        F.when(both, round_half_even(F.col("avg_grade_level_1") - F.col("avg_grade_level_2"), 2))
         .alias("grade_level_diff"),
        F.when(both, F.col("reading_level_1")).alias("text1_reading_level"),
        F.when(both, F.col("reading_level_2")).alias("text2_reading_level"),
    )


def content_gap(pairs: DataFrame, texts: DataFrame, id_col: str = "text_id",
                text_col: str = "text") -> DataFrame:
    """For each left text ("ours"): keywords that its paired right texts
    ("competitors") hold and it does not, with the number of competitors."""
    kw = cut_lineage(tm.top_keywords(tm.term_freq(texts, id_col, text_col), id_col).select(id_col, "term"),
                     "keywords")
    theirs = (pairs.filter(F.col("left_id") != F.col("right_id"))
              .select("left_id", "right_id")
              .join(kw.withColumnRenamed(id_col, "right_id"), "right_id"))
    ours = kw.withColumnRenamed(id_col, "left_id")
    gap = theirs.join(ours, ["left_id", "term"], "left_anti")
    return gap.groupBy("left_id", "term").agg(F.countDistinct("right_id").alias("n_competitors"))
