"""Per-page analysis: content + SEO inputs -> quality score, and the corpus
roll-up of grades per host.

The content and SEO halves come from ONE tag stage in ONE projection (the
per-request service parses each page twice and computes readability twice;
here both happen once per row, with no join between the halves)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import html as H
from pagewise.functions import quality as Q
from pagewise.functions import urls as U
from pagewise.functions.readability import readability_metrics, with_text_stats
from pagewise.functions.text import round_half_even, ws_word_count
from pagewise.operators import pages as P

DEFAULT_SENTENCES = 1       # used when readability is not computed (< 20 words)
DEFAULT_FLESCH = 50.0
NO_LANGUAGE = "und"         # pages that name no language


def quality_inputs(pages: DataFrame, text_fields: Sequence[Column] = ()) -> DataFrame:
    """Inputs of the quality score per page; ``text_fields`` are further columns
    over the main text (``text``), computed in the same pass."""
    ts = P.with_main_text(P.tag_stage(pages))
    s2 = ts.select("page_id", "url", "toks", "names", "text",
                   H.meta_structs(*P.parsed()).alias("metas"),
                   H.ld_json_scripts(F.col("nc")).alias("ld"),
                   P.img_tags(*P.parsed()).alias("imgs"))
    metas = F.col("metas")
    desc = H.meta_content(H.meta_lookup(metas, lambda m: m["name"].rlike("(?i)description")))
    canon = H.canonical(*P.parsed())
    og_title = P.open_graph(metas)["og_title"]
    s3 = s2.select(
        "page_id", "url", "text",
        ws_word_count(F.col("text")).alias("word_count"),
        F.size(F.slice(H.headings(*P.parsed(), 1), 1, H.MAX_H1)).alias("h1_count"),
        F.size(F.slice(H.headings(*P.parsed(), 2), 1, H.MAX_H2)).alias("h2_count"),
        F.size("imgs").alias("total_images"),
        F.size(F.filter(F.col("imgs"), lambda t: F.coalesce(H.attr(t, "alt"), F.lit("")) == "")).alias("images_without_alt"),
        (F.coalesce(desc, F.lit("")) != "").alias("has_meta_description"),
        (F.coalesce(canon, F.lit("")) != "").alias("has_canonical"),
        (F.coalesce(og_title, F.lit("")) != "").alias("has_open_graph"),
        (F.size(P.schema_items(F.col("ld"))) > 0).alias("has_schema_markup"),
        F.coalesce(H.html_lang(*P.parsed()), F.lit(NO_LANGUAGE)).alias("language"),
        *text_fields,
    )
    staged = with_text_stats(s3, "text")
    m = readability_metrics()
    gate = F.col("word_count") >= P.READABILITY_MIN_WORDS
    keep = [c for c in s3.columns if c != "text"]
    return staged.select(
        *keep,
        F.when(gate, m["sentence_count"]).otherwise(F.lit(DEFAULT_SENTENCES)).cast("long").alias("sentence_count"),
        F.when(gate, m["flesch_reading_ease"]).otherwise(F.lit(DEFAULT_FLESCH)).alias("flesch_reading_ease"))


def page_quality(pages: DataFrame, text_fields: Sequence[Column] = ()) -> DataFrame:
    qi = quality_inputs(pages, text_fields)
    cols = Q.quality_columns(
        F.col("word_count"), F.col("sentence_count"), F.col("flesch_reading_ease"),
        F.col("h1_count"), F.col("h2_count"), F.col("total_images"), F.col("images_without_alt"),
        F.col("has_meta_description"), F.col("has_canonical"), F.col("has_open_graph"), F.col("has_schema_markup"))
    return qi.select("*", *[v.alias(k) for k, v in cols.items()])


def quality_rollup(pages: DataFrame) -> DataFrame:
    """Grade distribution per host with host subtotals and a grand total
    (ROLLUP: one partial+final aggregation, no self-union)."""
    pq = page_quality(pages).select(U.hostname(F.col("url")).alias("host"), "grade", "total_score")
    return (pq.rollup("host", "grade")
              .agg(F.count(F.lit(1)).alias("n_pages"),
                   round_half_even(F.avg("total_score"), 4).alias("avg_score"),
                   F.min("total_score").alias("min_score"), F.max("total_score").alias("max_score")))


def quality_by_language(pages: DataFrame) -> DataFrame:
    """Grade distribution per host and language, with totals per host, per
    language and over all (grouping sets: one partial and one final aggregation).
    NULL in ``host``, ``language`` or ``grade`` stands for all of them; ``level``
    tells which of them are (Spark's grouping id)."""
    pq = page_quality(pages).select(F.coalesce(U.hostname(F.col("url")), F.lit("")).alias("host"), "language", "grade", "total_score")
    sets = [["host", "language", "grade"], ["host", "language"], ["host", "grade"], ["language", "grade"], ["host"], ["language"],
            ["grade"], []]
    return pq.groupingSets([[F.col(c) for c in x] for x in sets], "host", "language", "grade").agg(
        F.grouping_id("host", "language", "grade").alias("level"), F.count(F.lit(1)).alias("n_pages"),
        round_half_even(F.avg("total_score"), 4).alias("avg_score"),
        F.min("total_score").alias("min_score"), F.max("total_score").alias("max_score"))
