"""Quality score queries: components, grade, recommendations, record, roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.functions import quality as Q
from pagewise.operators.analysis import page_quality, quality_by_language, quality_inputs, quality_rollup
from pagewise.plans.registry import query
from pagewise.plans.sqlhtml import hostname, html_lang, quality_inputs_sql, quality_sql
from pagewise.plans.sqlfrag import r
from pagewise.session import spread
from pagewise.sources import tables as src

_QI = f"WITH {quality_inputs_sql()}"
_Q = quality_sql()


def _pq(spark, sf):
    return page_quality(spread(src.pages(spark, sf)))


@query("quality_inputs", group="quality", oracle=f"{_QI} SELECT * FROM qi")
def q_quality_inputs(spark, sf):
    qi = quality_inputs(spread(src.pages(spark, sf)))
    return qi.select(*[F.col(c).cast("long") if c in ("h1_count", "h2_count", "total_images", "images_without_alt")
                       else F.col(c) for c in qi.columns])


@query("quality_depth", group="quality", oracle=f"{_QI} SELECT page_id, word_count, ({_Q['depth']})::BIGINT AS score FROM qi")
def q_quality_depth(spark, sf):
    return _pq(spark, sf).select("page_id", "word_count", F.col("score_content_depth").alias("score"))


@query("quality_readability", group="quality",
       oracle=f"{_QI} SELECT page_id, flesch_reading_ease, ({_Q['readability']})::BIGINT AS score FROM qi")
def q_quality_readability(spark, sf):
    return _pq(spark, sf).select("page_id", "flesch_reading_ease", F.col("score_readability").alias("score"))


@query("quality_structure", group="quality",
       oracle=f"{_QI} SELECT page_id, h1_count::BIGINT AS h1_count, h2_count::BIGINT AS h2_count, sentence_count, ({_Q['structure']})::BIGINT AS score FROM qi")
def q_quality_structure(spark, sf):
    return _pq(spark, sf).select("page_id", F.col("h1_count").cast("long").alias("h1_count"),
                                 F.col("h2_count").cast("long").alias("h2_count"), "sentence_count",
                                 F.col("score_structure").alias("score"))


@query("quality_media", group="quality",
       oracle=f"{_QI} SELECT page_id, total_images::BIGINT AS total_images, images_without_alt::BIGINT AS images_without_alt, ({_Q['media']})::BIGINT AS score FROM qi")
def q_quality_media(spark, sf):
    return _pq(spark, sf).select("page_id", F.col("total_images").cast("long").alias("total_images"),
                                 F.col("images_without_alt").cast("long").alias("images_without_alt"),
                                 F.col("score_media").alias("score"))


@query("quality_seo", group="quality",
       oracle=f"{_QI} SELECT page_id, has_meta_description, has_canonical, has_open_graph, has_schema_markup, ({_Q['seo']})::BIGINT AS score FROM qi")
def q_quality_seo(spark, sf):
    return _pq(spark, sf).select("page_id", "has_meta_description", "has_canonical", "has_open_graph",
                                 "has_schema_markup", F.col("score_seo_signals").alias("score"))


@query("quality_grade", group="quality",
       oracle=f"{_QI} SELECT page_id, ({_Q['total']})::BIGINT AS total_score, {_Q['grade']} AS grade FROM qi")
def q_quality_grade(spark, sf):
    return _pq(spark, sf).select("page_id", "total_score", "grade")


@query("quality_recommendations", group="quality",
       oracle=f"{_QI} SELECT page_id, array_to_string({_Q['recs']}, ',') AS recommendations, len({_Q['recs']})::BIGINT AS n_recommendations FROM qi")
def q_quality_recommendations(spark, sf):
    q = _pq(spark, sf)
    return q.select("page_id", F.array_join("recommendations", ",").alias("recommendations"),
                    F.size("recommendations").cast("long").alias("n_recommendations"))


_PARTS = {"content_depth": "depth", "readability": "readability", "structure": "structure", "media": "media",
          "seo_signals": "seo"}


@query("quality_record", group="quality", oracle=f"""{_QI}
SELECT page_id, url, ({_Q['total']})::BIGINT AS total_score, {_Q['grade']} AS grade,
       {', '.join(f"({_Q[v]})::BIGINT AS {k}" for k, v in _PARTS.items())},
       {', '.join(f"{n}::BIGINT AS max_{k}" for k, n in Q.MAX_SCORES.items())},
       array_to_string({_Q['recs']}, ',') AS recommendations FROM qi""")
def q_quality_record(spark, sf):
    """Full record; its breakdown and max_scores maps are flattened to columns."""
    q = _pq(spark, sf).withColumns({"breakdown": Q.breakdown_map(), "max_scores": Q.max_scores_map()})
    return q.select("page_id", "url", "total_score", "grade",
                    *[F.col("breakdown")[k].cast("long").alias(k) for k in _PARTS],
                    *[F.col("max_scores")[k].cast("long").alias(f"max_{k}") for k in Q.MAX_SCORES],
                    F.array_join("recommendations", ",").alias("recommendations"))


@query("quality_rollup", group="quality", oracle=f"""{_QI}, g AS (
    SELECT {hostname('url')} AS host, {_Q['grade']} AS grade, ({_Q['total']})::BIGINT AS total_score FROM qi)
SELECT host, grade, count(*)::BIGINT AS n_pages, {r('avg(total_score)', 4)} AS avg_score,
       min(total_score)::BIGINT AS min_score, max(total_score)::BIGINT AS max_score
FROM g GROUP BY ROLLUP (host, grade)""")
def q_quality_rollup(spark, sf):
    return quality_rollup(spread(src.pages(spark, sf)))


@query("quality_by_language", group="quality", oracle=f"""{_QI}, lg AS (
    SELECT page_id, coalesce({html_lang('clean')}, 'und') AS language FROM ts), g AS (
    SELECT coalesce({hostname('url')}, '') AS host, language, {_Q['grade']} AS grade, ({_Q['total']})::BIGINT AS total_score
    FROM qi JOIN lg USING (page_id))
SELECT host, language, grade, grouping_id(host, language, grade)::BIGINT AS level, count(*)::BIGINT AS n_pages,
       {r('avg(total_score)', 4)} AS avg_score, min(total_score)::BIGINT AS min_score, max(total_score)::BIGINT AS max_score
FROM g GROUP BY CUBE (host, language, grade)""")
def q_quality_by_language(spark, sf):
    return quality_by_language(spread(src.pages(spark, sf)))
