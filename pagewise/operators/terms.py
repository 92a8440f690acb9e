"""Term-frequency vectors, cosine similarity and keyword sets as joins,
aggregations and windows.

Shapes (all long-form, one row per (text, term)):
  term_freq  (id, term, tf, first_pos)       shuffle on (id, term), partial agg map-side
  tf_norms   (id, n_words, n_terms, sum_sq)  agg on id
  vectors    (id, terms, tfs)                one row per text, agg on id
  pair_dot   (pair_id, dot)                  two equi-joins of vectors, dots by Arrow batch
  keywords   (id, term, kw_rank)             per-id window with a bounded top-k
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.functions.text import round_half_even, words
from pagewise.session import cut_lineage

# The stop-word set used for keywords (lower-case, compared
# case-sensitively).
STOPWORDS = frozenset({
    "a", "about", "above", "after", "again", "all", "also", "an", "and", "are", "as", "at", "be", "been",
    "before", "being", "below", "between", "both", "but", "by", "can", "could", "did", "do", "does", "during",
    "each", "every", "few", "for", "from", "further", "had", "has", "have", "he", "her", "his", "how", "if",
    "in", "into", "is", "it", "its", "just", "may", "might", "more", "most", "my", "no", "not", "of", "off",
    "on", "once", "only", "or", "other", "our", "out", "over", "shall", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "them", "then", "these", "they", "this", "those", "through", "to", "too",
    "under", "up", "very", "was", "well", "were", "what", "when", "where", "which", "who", "will", "with",
    "would", "your",
})

TOP_CANDIDATES = 60   # most frequent terms considered before filtering
TOP_KEYWORDS = 20     # keywords kept per text
MIN_KEYWORD_LEN = 3   # keywords are longer than two letters
MAX_LISTED = 20       # shared / unique keyword lists are cut to this

TASK_TEXT_BYTES = 4 << 20  # text whose terms one task counts
DOT_TERMS = 2_000_000      # vector entries of pairs that are met at once


def term_freq(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """Case-sensitive letter-word counts per text, with first position.

    The texts are hash-partitioned by id once; the (id, term) aggregation, the
    per-id norms and the per-id keyword window all reuse that partitioning, so
    the only shuffle in TF + norms + keywords is this one. The partitions grow in
    number with the bytes of text (one scan measures them), so that what a task
    holds does not grow with the input."""
    by_id = texts.select(id_col, text_col).repartition(text_partitions(texts, text_col), id_col)
    exploded = by_id.select(id_col, F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return exploded.groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"))


def text_partitions(texts: DataFrame, text_col: str = "text") -> int:
    """Partitions of about ``TASK_TEXT_BYTES`` of text each, one per core at least."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT_BYTES))


def tf_norms(tf: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Squared norm as an exact BIGINT (order-independent); sqrt applied last."""
    return tf.groupBy(id_col).agg(
        F.sum("tf").cast("long").alias("n_words"),
        F.count(F.lit(1)).alias("n_terms"),
        F.sum(F.col("tf") * F.col("tf")).cast("long").alias("sum_sq"))


def text_vectors(tf: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, terms, tfs, sum_sq, keywords): one row per text that has a word, by one
    aggregation on the id partitioning of ``tf``. Terms fall by (tf, first
    occurrence); keywords are those of ``top_keywords``, sorted, null if there are
    none. The lists are bounded by the different words of one text."""
    v = tf.groupBy(id_col).agg(
        F.sum(F.col("tf") * F.col("tf")).cast("long").alias("sum_sq"),
        F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("less"), "first_pos", "term"))).alias("v"))

    def is_keyword(x: Column) -> Column:
        return ~x["term"].isin(*sorted(STOPWORDS)) & (F.length(x["term"]) >= MIN_KEYWORD_LEN)
    kept = F.slice(F.filter(F.slice("v", 1, TOP_CANDIDATES), is_keyword), 1, TOP_KEYWORDS)
    return v.select(id_col, F.col("v.term").alias("terms"), F.transform("v", lambda x: -x["less"]).alias("tfs"), "sum_sq",
                    F.when(F.size(kept) > 0, F.array_sort(F.transform(kept, lambda x: x["term"]))).alias("keywords"))


def batch_dots(lists: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that share a term, and their Σ tf_l·tf_r; lists: terms and tfs of the
    left sides, then of the right sides."""
    codes = pa.chunked_array([lists[0].flatten(), lists[2].flatten()]).combine_chunks().dictionary_encode()
    kinds, codes = max(1, len(codes.dictionary)), codes.indices.to_numpy()
    rows = [np.repeat(np.arange(len(t)), t.value_lengths().to_numpy()) for t in (lists[0], lists[2])]
    left, right = (row.astype(np.int64) * kinds + code for row, code in zip(rows, np.split(codes, [len(rows[0])])))
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    products = lists[1].flatten().to_numpy()[i] * lists[3].flatten().to_numpy()[j]
    found, first = np.unique(rows[0][i], return_index=True)
    return found, np.add.reduceat(products, first) if len(found) else products


def pair_dot(pairs: DataFrame, tf: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Σ tf_left·tf_right over shared terms, per pair (pairs without a shared
    term are absent)."""
    return vector_dot(pairs, text_vectors(tf, id_col), id_col)


def vector_dot(pairs: DataFrame, vectors: DataFrame, id_col: str = "text_id") -> DataFrame:
    """``pair_dot`` from ``text_vectors``: the vectors of both sides join the pairs,
    one row per pair, and meet in the pair's row."""
    left = vectors.select(F.col(id_col).alias("left_id"), F.col("terms").alias("terms_l"), F.col("tfs").alias("tfs_l"))
    right = vectors.select(F.col(id_col).alias("right_id"), F.col("terms").alias("terms_r"), F.col("tfs").alias("tfs_r"))
    met = pairs.select("pair_id", "left_id", "right_id").join(left, "left_id").join(right, "right_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = sum(b.column(c).value_lengths().to_numpy() for c in (1, 3)) if b.num_rows else np.zeros(0, np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // DOT_TERMS, prepend=0))
            for at, until in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
                part = b.slice(at, until - at)
                rows, dots = batch_dots([part.column(c) for c in (1, 2, 3, 4)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(dots, pa.int64())],
                                                 names=["pair_id", "dot"])
    kind = pairs.schema["pair_id"].dataType.simpleString()
    dots = met.select("pair_id", "terms_l", "tfs_l", "terms_r", "tfs_r").mapInArrow(run, f"pair_id {kind}, dot long")
    return dots.groupBy("pair_id").agg(F.sum("dot").alias("dot"))


def cosine(dot: Column, sum_sq_l: Column, sum_sq_r: Column) -> Column:
    """dot / (|l|·|r|), 0 when a side has no words; 4 decimals."""
    denom = F.sqrt(sum_sq_l.cast("double")) * F.sqrt(sum_sq_r.cast("double"))
    return F.when(F.coalesce(sum_sq_l, F.lit(0)) == 0, F.lit(0.0)) \
            .when(F.coalesce(sum_sq_r, F.lit(0)) == 0, F.lit(0.0)) \
            .otherwise(round_half_even(F.coalesce(dot, F.lit(0)).cast("double") / denom, 4))


def pair_cosine(pairs: DataFrame, tf: DataFrame, id_col: str = "text_id",
                norms: DataFrame | None = None) -> DataFrame:
    """Cosine per pair. Self-pairs take dot = sum_sq from the norms (no term
    join); the term join runs only for pairs of two different texts."""
    vectors = cut_lineage(text_vectors(tf, id_col), "vectors")
    norms = vectors if norms is None else norms
    nl = norms.select(F.col(id_col).alias("left_id"), F.col("sum_sq").alias("sq_l"))
    nr = norms.select(F.col(id_col).alias("right_id"), F.col("sum_sq").alias("sq_r"))
    dots = vector_dot(pairs.filter(F.col("left_id") != F.col("right_id")), vectors, id_col)
    j = (pairs.join(dots, "pair_id", "left")
              .join(nl, "left_id", "left").join(nr, "right_id", "left"))
    dot = F.when(F.col("left_id") == F.col("right_id"), F.col("sq_l")).otherwise(F.col("dot"))
    return j.select("pair_id", "left_id", "right_id",
                    F.coalesce(dot, F.lit(0)).cast("long").alias("dot"),
                    F.coalesce("sq_l", F.lit(0)).cast("long").alias("sum_sq_left"),
                    F.coalesce("sq_r", F.lit(0)).cast("long").alias("sum_sq_right"),
                    cosine(dot, F.col("sq_l"), F.col("sq_r")).alias("similarity_score"))


def top_keywords(tf: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Per text: rank terms by (tf desc, first occurrence), keep the top 60,
    then drop stop-words and short terms, then keep the first 20.

    Both limits are ``row_number() <= k`` over a per-text window, which
    Spark plans as a WindowGroupLimit (per-group top-k before the sort)."""
    by_freq = Window.partitionBy(id_col).orderBy(F.col("tf").desc(), F.col("first_pos").asc())
    cand = (tf.withColumn("freq_rank", F.row_number().over(by_freq))
              .filter(F.col("freq_rank") <= TOP_CANDIDATES))
    kept = cand.filter(~F.col("term").isin(*sorted(STOPWORDS)) & (F.length("term") >= MIN_KEYWORD_LEN))
    by_rank = Window.partitionBy(id_col).orderBy("freq_rank")
    return (kept.withColumn("kw_rank", F.row_number().over(by_rank))
                .filter(F.col("kw_rank") <= TOP_KEYWORDS)
                .select(id_col, "term", "tf", "kw_rank"))


def pair_keywords(pairs: DataFrame, kw: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Shared and unique keywords per pair from ``text_stats`` rows (texts
    without words have none); empty lists when a side has no words."""
    kl = kw.select(F.col(id_col).alias("left_id"), F.col("keywords").alias("kw_l"), F.lit(True).alias("has_l"))
    kr = kw.select(F.col(id_col).alias("right_id"), F.col("keywords").alias("kw_r"), F.lit(True).alias("has_r"))
    empty = F.array().cast("array<string>")
    j = pairs.join(kl, "left_id", "left").join(kr, "right_id", "left")
    l_ = F.coalesce(F.col("kw_l"), empty)
    r_ = F.coalesce(F.col("kw_r"), empty)

    def listed(c: Column) -> Column:
        return F.when(F.col("has_l") & F.col("has_r"), F.slice(F.array_sort(c), 1, MAX_LISTED)).otherwise(empty)
    return j.select("pair_id", listed(F.array_intersect(l_, r_)).alias("shared_keywords"),
                    listed(F.array_except(l_, r_)).alias("unique_to_text1"),
                    listed(F.array_except(r_, l_)).alias("unique_to_text2"))


def text_stats(tf: DataFrame, id_col: str = "text_id") -> DataFrame:
    """(id, sum_sq, keywords) of ``text_vectors``; at most 20 keywords per id."""
    return text_vectors(tf, id_col).select(id_col, "sum_sq", "keywords")


def pair_similarity(pairs: DataFrame, texts: DataFrame, id_col: str = "text_id",
                    text_col: str = "text", profile: DataFrame | None = None) -> DataFrame:
    """Similarity record per pair: cosine + shared / unique keyword lists.
    A side without words gives score 0 and empty lists. ``profile`` has further
    columns per text (``id_col`` and others); they come with the text's one row,
    as ``<column>_1`` and ``<column>_2``, in the same two joins."""
    # one row per text, materialised once for the dot product (terms and counts)
    # and the record (norm and keywords)
    vectors = cut_lineage(text_vectors(term_freq(texts, id_col, text_col), id_col), "vectors")
    stats = vectors.select(id_col, "sum_sq", "keywords")
    more = [c for c in profile.columns if c != id_col] if profile is not None else []
    if profile is not None:
        stats = cut_lineage(profile.join(stats, id_col, "left"), "text_stats")
    sl = stats.select(F.col(id_col).alias("left_id"), F.col("sum_sq").alias("sq_l"), F.col("keywords").alias("kw_l"),
                      *[F.col(c).alias(f"{c}_1") for c in more])
    sr = stats.select(F.col(id_col).alias("right_id"), F.col("sum_sq").alias("sq_r"), F.col("keywords").alias("kw_r"),
                      *[F.col(c).alias(f"{c}_2") for c in more])
    dots = vector_dot(pairs.filter(F.col("left_id") != F.col("right_id")), vectors, id_col)
    j = (pairs.select("pair_id", "left_id", "right_id").join(dots, "pair_id", "left")
              .join(sl, "left_id", "left").join(sr, "right_id", "left"))
    dot = F.when(F.col("left_id") == F.col("right_id"), F.col("sq_l")).otherwise(F.col("dot"))
    empty = F.array().cast("array<string>")
    l_ = F.coalesce(F.col("kw_l"), empty)
    r_ = F.coalesce(F.col("kw_r"), empty)
    no_words = (F.coalesce(F.col("sq_l"), F.lit(0)) == 0) | (F.coalesce(F.col("sq_r"), F.lit(0)) == 0)

    def listed(c: Column) -> Column:
        return F.when(no_words, empty).otherwise(F.slice(F.array_sort(c), 1, MAX_LISTED))
    return j.select(
        "pair_id", "left_id", "right_id",
        cosine(dot, F.col("sq_l"), F.col("sq_r")).alias("similarity_score"),
        listed(F.array_intersect(l_, r_)).alias("shared_keywords"),
        listed(F.array_except(l_, r_)).alias("unique_to_text1"),
        listed(F.array_except(r_, l_)).alias("unique_to_text2"),
        *[f"{c}_{k}" for k in (1, 2) for c in more])


def copy_clusters(tf: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Texts with identical bags of words (cosine exactly 1 at equal counts):
    (id, fingerprint, cluster_id = smallest id sharing it, cluster_size).

    One row per text that has a word — a group of copies is never expanded into pairs. The
    fingerprint is the md5 of the sorted term:count list (bounded by one
    text's distinct terms); the per-fingerprint min/count aggregate is
    combinable map-side, and joining it back is an equi-join on the
    fingerprint whose hot keys AQE's skew handling splits."""
    fp = (tf.groupBy(id_col)
            .agg(F.md5(F.array_join(F.array_sort(F.collect_list(
                F.concat(F.col("term"), F.lit(":"), F.col("tf").cast("string")))), " ")).alias("fingerprint")))
    groups = fp.groupBy("fingerprint").agg(F.min(id_col).alias("cluster_id"),
                                           F.count(F.lit(1)).alias("cluster_size"))
    return fp.join(groups, "fingerprint").select(id_col, "fingerprint", "cluster_id", "cluster_size")
