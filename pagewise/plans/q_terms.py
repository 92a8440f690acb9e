"""Comparison queries: term frequencies, norms, dot products, cosine,
keywords and keyword set operations over the corpus and the pair table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.operators import simjoin
from pagewise.operators import terms as tm
from pagewise.operators.compare import compare_records, content_gap
from pagewise.plans.registry import query
from pagewise.plans.sqlfix import CORPUS, PAIRS
from pagewise.plans.sqlfrag import (
    NONWS, cosine_sql, dot_cte, kw_ctes, list_minus, norms_cte, r, readability_sql, stopword_list,
    tf_ctes, ws_count,
)
from pagewise.sources import fixtures as fx

_BASE = f"WITH {CORPUS}, {PAIRS}, {tf_ctes('corpus')}"


def _tf(spark, sf):
    return tm.term_freq(fx.corpus(spark, sf))


@query("term_freq", group="terms", oracle=f"{_BASE} SELECT text_id, term, tf, first_pos FROM tf")
def q_term_freq(spark, sf):
    return _tf(spark, sf)


@query("tf_norm", group="terms", oracle=f"""{_BASE}, {norms_cte()}
SELECT text_id, n_words, n_terms, sum_sq, sqrt(sum_sq::DOUBLE) AS norm FROM norms""")
def q_tf_norm(spark, sf):
    n = tm.tf_norms(_tf(spark, sf))
    return n.select("text_id", "n_words", F.col("n_terms").cast("long").alias("n_terms"), "sum_sq",
                    F.sqrt(F.col("sum_sq").cast("double")).alias("norm"))


@query("pair_dot", group="terms", oracle=f"{_BASE}, {dot_cte()} SELECT pair_id, dot FROM dots")
def q_pair_dot(spark, sf):
    return tm.pair_dot(fx.pairs(spark, sf), _tf(spark, sf))


_COS = f"""{_BASE}, {norms_cte()}, {dot_cte()}
SELECT p.pair_id, p.left_id, p.right_id, coalesce(d.dot, 0)::BIGINT AS dot,
       coalesce(nl.sum_sq, 0)::BIGINT AS sum_sq_left, coalesce(nr.sum_sq, 0)::BIGINT AS sum_sq_right,
       {cosine_sql('d.dot', 'nl.sum_sq', 'nr.sum_sq')} AS similarity_score
FROM pairs p LEFT JOIN dots d USING (pair_id)
     LEFT JOIN norms nl ON nl.text_id = p.left_id LEFT JOIN norms nr ON nr.text_id = p.right_id"""


@query("pair_cosine", group="terms", oracle=_COS)
def q_pair_cosine(spark, sf):
    return tm.pair_cosine(fx.pairs(spark, sf), _tf(spark, sf))


@query("stopword_filter", group="terms", oracle=f"""{_BASE}
SELECT text_id,
       sum(CASE WHEN term IN ({stopword_list()}) THEN tf ELSE 0 END)::BIGINT AS stopword_tokens,
       sum(CASE WHEN term IN ({stopword_list()}) THEN 0 ELSE tf END)::BIGINT AS other_tokens,
       count(*) FILTER (WHERE term NOT IN ({stopword_list()}) AND length(term) >= 3)::BIGINT AS content_terms
FROM tf GROUP BY text_id""")
def q_stopword_filter(spark, sf):
    tf = _tf(spark, sf)
    is_stop = F.col("term").isin(*sorted(tm.STOPWORDS))
    return tf.groupBy("text_id").agg(
        F.sum(F.when(is_stop, F.col("tf")).otherwise(0)).cast("long").alias("stopword_tokens"),
        F.sum(F.when(is_stop, 0).otherwise(F.col("tf"))).cast("long").alias("other_tokens"),
        F.count(F.when(~is_stop & (F.length("term") >= 3), 1)).alias("content_terms"))


@query("top_keywords", group="terms", oracle=f"{_BASE}, {kw_ctes()} SELECT text_id, term, tf, kw_rank FROM kw")
def q_top_keywords(spark, sf):
    return tm.top_keywords(_tf(spark, sf)).withColumn("kw_rank", F.col("kw_rank").cast("long"))


def _pair_kw(spark, sf):
    tf = _tf(spark, sf)
    return tm.pair_keywords(fx.pairs(spark, sf), tm.text_stats(tf))


_PKW = f"""{_BASE}, {kw_ctes()}, pk AS (
    SELECT p.pair_id, CASE WHEN worded THEN coalesce(l.keywords, []::VARCHAR[]) ELSE [] END AS kl,
           CASE WHEN worded THEN coalesce(r.keywords, []::VARCHAR[]) ELSE [] END AS kr
    FROM (SELECT *, left_id IN (SELECT text_id FROM tf) AND right_id IN (SELECT text_id FROM tf) AS worded FROM pairs) p
         LEFT JOIN kwset l ON l.text_id = p.left_id LEFT JOIN kwset r ON r.text_id = p.right_id)"""


@query("shared_keywords", group="terms", oracle=f"""{_PKW}
SELECT pair_id, array_to_string(list_slice(list_sort(list_intersect(kl, kr)), 1, 20), ',') AS shared_keywords,
       len(list_intersect(kl, kr))::BIGINT AS n_shared FROM pk""")
def q_shared_keywords(spark, sf):
    k = _pair_kw(spark, sf)
    return k.select("pair_id", F.array_join("shared_keywords", ",").alias("shared_keywords"),
                    F.size("shared_keywords").cast("long").alias("n_shared"))


@query("unique_keywords", group="terms", oracle=f"""{_PKW}
SELECT pair_id, array_to_string(list_slice(list_sort({list_minus('kl', 'kr')}), 1, 20), ',') AS unique_to_text1,
       array_to_string(list_slice(list_sort({list_minus('kr', 'kl')}), 1, 20), ',') AS unique_to_text2 FROM pk""")
def q_unique_keywords(spark, sf):
    k = _pair_kw(spark, sf)
    return k.select("pair_id", F.array_join("unique_to_text1", ",").alias("unique_to_text1"),
                    F.array_join("unique_to_text2", ",").alias("unique_to_text2"))


_SIM = f"""{_BASE}, {norms_cte()}, {dot_cte()}, {kw_ctes()}, sim AS (
    SELECT p.pair_id, p.left_id, p.right_id,
           {cosine_sql('d.dot', 'nl.sum_sq', 'nr.sum_sq')} AS similarity_score,
           coalesce(nl.sum_sq, 0) = 0 OR coalesce(nr.sum_sq, 0) = 0 AS no_words,
           coalesce(kl.keywords, []::VARCHAR[]) AS kl, coalesce(kr.keywords, []::VARCHAR[]) AS kr
    FROM pairs p LEFT JOIN dots d USING (pair_id)
         LEFT JOIN norms nl ON nl.text_id = p.left_id LEFT JOIN norms nr ON nr.text_id = p.right_id
         LEFT JOIN kwset kl ON kl.text_id = p.left_id LEFT JOIN kwset kr ON kr.text_id = p.right_id)"""


@query("pair_similarity", group="terms", oracle=f"""{_SIM}
SELECT pair_id, left_id, right_id, similarity_score,
       CASE WHEN no_words THEN '' ELSE array_to_string(list_slice(list_sort(list_intersect(kl, kr)), 1, 20), ',') END AS shared_keywords,
       CASE WHEN no_words THEN '' ELSE array_to_string(list_slice(list_sort({list_minus('kl', 'kr')}), 1, 20), ',') END AS unique_to_text1,
       CASE WHEN no_words THEN '' ELSE array_to_string(list_slice(list_sort({list_minus('kr', 'kl')}), 1, 20), ',') END AS unique_to_text2
FROM sim""")
def q_pair_similarity(spark, sf):
    s = tm.pair_similarity(fx.pairs(spark, sf), fx.corpus(spark, sf))
    return s.select("pair_id", "left_id", "right_id", "similarity_score",
                    *[F.array_join(c, ",").alias(c) for c in ("shared_keywords", "unique_to_text1", "unique_to_text2")])


_PROFILE = f"""prof AS (
    SELECT rd.text_id, c.ws_words, c.blank, rd.flesch_reading_ease, rd.avg_grade_level, rd.reading_level
    FROM {readability_sql('corpus', 'text_id', 'text')} rd
    JOIN (SELECT text_id, {ws_count('text')} AS ws_words, NOT regexp_matches(text, {NONWS}) AS blank FROM corpus) c
      USING (text_id))"""


@query("compare_record", group="terms", oracle=f"""{_SIM}, {_PROFILE}
SELECT s.pair_id, s.left_id, s.right_id,
       CASE WHEN coalesce(a.blank, true) OR coalesce(b.blank, true) THEN 'NO_CONTENT' END AS error_code,
       s.similarity_score,
       CASE WHEN no_words THEN '' ELSE array_to_string(list_slice(list_sort(list_intersect(kl, kr)), 1, 20), ',') END AS shared_keywords,
       CASE WHEN no_words THEN '' ELSE array_to_string(list_slice(list_sort({list_minus('kl', 'kr')}), 1, 20), ',') END AS unique_to_text1,
       CASE WHEN no_words THEN '' ELSE array_to_string(list_slice(list_sort({list_minus('kr', 'kl')}), 1, 20), ',') END AS unique_to_text2,
       a.ws_words - b.ws_words AS word_count_diff,
       CASE WHEN a.ws_words >= 20 AND b.ws_words >= 20 THEN {r('a.flesch_reading_ease - b.flesch_reading_ease', 2)} END AS flesch_reading_ease_diff,
       CASE WHEN a.ws_words >= 20 AND b.ws_words >= 20 THEN {r('a.avg_grade_level - b.avg_grade_level', 2)} END AS grade_level_diff,
       CASE WHEN a.ws_words >= 20 AND b.ws_words >= 20 THEN a.reading_level END AS text1_reading_level,
       CASE WHEN a.ws_words >= 20 AND b.ws_words >= 20 THEN b.reading_level END AS text2_reading_level
FROM sim s LEFT JOIN prof a ON a.text_id = s.left_id LEFT JOIN prof b ON b.text_id = s.right_id""")
def q_compare_record(spark, sf):
    c = compare_records(fx.pairs(spark, sf), fx.corpus(spark, sf))
    return c.select(*[F.array_join(x, ",").alias(x) if x in ("shared_keywords", "unique_to_text1", "unique_to_text2")
                      else F.col(x) for x in c.columns])


@query("content_gap", group="terms", oracle=f"""{_BASE}, {kw_ctes()}
SELECT p.left_id, k.term, count(DISTINCT p.right_id)::BIGINT AS n_competitors
FROM pairs p JOIN kw k ON k.text_id = p.right_id
WHERE p.left_id <> p.right_id
  AND NOT EXISTS (SELECT 1 FROM kw o WHERE o.text_id = p.left_id AND o.term = k.term)
GROUP BY p.left_id, k.term""")
def q_content_gap(spark, sf):
    return content_gap(fx.pairs(spark, sf), fx.corpus(spark, sf))


@query("copy_clusters", group="terms", oracle=f"""{_BASE},
  fp AS (SELECT text_id, md5(string_agg(term || ':' || tf, ' ' ORDER BY term || ':' || tf)) AS fingerprint
         FROM tf GROUP BY text_id),
  g AS (SELECT fingerprint, min(text_id) AS cluster_id, count(*)::BIGINT AS cluster_size FROM fp GROUP BY fingerprint)
SELECT fp.text_id, fp.fingerprint, g.cluster_id, g.cluster_size FROM fp JOIN g USING (fingerprint)""")
def q_copy_clusters(spark, sf):
    """Exact-copy detection over the whole corpus (the cosine = 1 slice of a
    similarity join, without emitting pairs)."""
    return tm.copy_clusters(_tf(spark, sf))


# Brute force over all pairs; texts with the same term frequencies are one class.
@query("similarity_join", group="terms", oracle=f"""{_BASE}, {norms_cte()},
  fp AS (SELECT text_id, md5(string_agg(term || ':' || tf, ' ' ORDER BY term)) AS f FROM tf GROUP BY text_id),
  cl AS (SELECT f, min(text_id) AS class_id, count(*)::BIGINT AS class_size FROM fp GROUP BY f),
  d AS (SELECT a.text_id AS l, b.text_id AS r, sum(a.tf * b.tf) AS dot FROM tf a JOIN tf b USING (term)
        WHERE a.text_id <> b.text_id GROUP BY a.text_id, b.text_id),
  k AS (SELECT l AS text_id, count(*)::BIGINT AS n FROM d JOIN norms x ON x.text_id = l JOIN norms y ON y.text_id = r
        WHERE dot >= 0.95::DOUBLE * sqrt(x.sum_sq::DOUBLE) * sqrt(y.sum_sq::DOUBLE) GROUP BY l)
SELECT fp.text_id, class_id, class_size, coalesce(n, 0) AS n_links FROM fp JOIN cl USING (f) LEFT JOIN k USING (text_id)""")
def q_similarity_join(spark, sf):
    """All texts of the corpus with the number of texts at a cosine of 0.95 or more."""
    return simjoin.similarity_join(_tf(spark, sf))
