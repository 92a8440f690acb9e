"""Cosine similarity, keywords, set operations."""

import math

from pyspark.sql import functions as F

from pagewise.operators import terms as tm
from tests.test_text import T1, T2


def _texts(spark, rows):
    return spark.createDataFrame(rows, "text_id BIGINT, text STRING")


def _pairs(spark, rows):
    return spark.createDataFrame([(f"{a}:{b}", a, b) for a, b in rows], "pair_id STRING, left_id BIGINT, right_id BIGINT")


def test_cosine_golden(spark):
    texts = _texts(spark, [(1, T1), (2, T2), (3, ""), (4, "... !!! 123")])
    pairs = _pairs(spark, [(1, 2), (2, 1), (1, 1), (1, 3), (4, 1)])
    out = {r.pair_id: r for r in tm.pair_cosine(pairs, tm.term_freq(texts)).collect()}
    assert out["1:2"].dot == 13 and out["1:2"].sum_sq_left == 30 and out["1:2"].sum_sq_right == 21
    assert out["1:2"].similarity_score == 0.5179
    assert out["2:1"].similarity_score == out["1:2"].similarity_score  # symmetric
    assert out["1:1"].similarity_score == 1.0
    assert out["1:3"].similarity_score == 0.0 and out["4:1"].similarity_score == 0.0


def test_keywords_rules(spark):
    # "The" survives (case-sensitive stop words); "the", "a", short words do not;
    # ties keep first occurrence.
    text = "The zebra and the yak. The zebra ran. Yak yak ox ox ox."
    texts = _texts(spark, [(1, text)])
    kw = [r.term for r in tm.top_keywords(tm.term_freq(texts)).orderBy("kw_rank").collect()]
    # counts: ox 3 (too short), The 2, zebra 2, yak 2, then ran and Yak once (ran first)
    assert kw == ["The", "zebra", "yak", "ran", "Yak"]


def test_similarity_record_lists(spark):
    texts = _texts(spark, [(1, "alpha beta gamma alpha"), (2, "beta gamma delta delta"), (3, "")])
    pairs = _pairs(spark, [(1, 2), (1, 3)])
    out = {r.pair_id: r for r in tm.pair_similarity(pairs, texts).collect()}
    r = out["1:2"]
    assert r.shared_keywords == ["beta", "gamma"]
    assert r.unique_to_text1 == ["alpha"] and r.unique_to_text2 == ["delta"]
    assert set(r.shared_keywords).isdisjoint(r.unique_to_text1)
    assert out["1:3"].similarity_score == 0.0 and out["1:3"].shared_keywords == []
    # independent check of the cosine
    v1 = {"alpha": 2, "beta": 1, "gamma": 1}
    v2 = {"beta": 1, "gamma": 1, "delta": 2}
    dot = sum(v1[t] * v2.get(t, 0) for t in v1)
    exp = round(dot / (math.sqrt(sum(x * x for x in v1.values())) * math.sqrt(sum(x * x for x in v2.values()))), 4)
    assert r.similarity_score == exp


def test_cosine_bounds_on_corpus(spark):
    from pagewise.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    cos = tm.pair_cosine(fx.pairs(spark, sf), tm.term_freq(fx.corpus(spark, sf)))
    bad = cos.filter((F.col("similarity_score") < 0) | (F.col("similarity_score") > 1.0)).count()
    assert bad == 0
    selfs = cos.filter(F.col("left_id") == F.col("right_id")).filter(F.col("sum_sq_left") > 0)
    assert selfs.filter(F.col("similarity_score") != 1.0).count() == 0


def test_copy_clusters(spark):
    texts = _texts(spark, [(1, "a cat sat. A cat!"), (2, "A cat, a cat sat"), (3, "a dog sat"),
                           (4, "cat a sat A cat"), (5, "")])
    out = {r.text_id: r for r in tm.copy_clusters(tm.term_freq(texts)).collect()}
    # 1, 2 and 4 hold the same bag of words (case-sensitive); 3 differs; 5 has no words
    assert {out[i].cluster_id for i in (1, 2, 4)} == {1} and out[1].cluster_size == 3
    assert out[3].cluster_id == 3 and out[3].cluster_size == 1
    assert 5 not in out


def test_partitions_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(tm, "TASK_TEXT_BYTES", 50)
    texts = _texts(spark, [(i, "alpha beta gamma alpha " * 5) for i in range(40)] + [(3, "beta"), (99, None)])
    tf = tm.term_freq(texts)
    assert tm.text_partitions(texts) == -(-(40 * 115 + 4) // 50)
    assert tf.rdd.getNumPartitions() == tm.text_partitions(texts)
    rows = {(r.text_id, r.term): (r.tf, r.first_pos) for r in tf.collect()}
    assert rows[3, "beta"] == (6, 0) and rows[4, "beta"] == (5, 1) and len(rows) == 120
    assert tm.term_freq(texts.limit(0)).count() == 0


def test_dot_one_row_per_pair(spark, monkeypatch):
    """The vectors meet in the row of the pair, some terms at a time."""
    monkeypatch.setattr(tm, "DOT_TERMS", 3)
    texts = _texts(spark, [(1, T1), (2, T2), (3, "x"), (5, None)] + [(10 + i, "the cat " * i + "b" * i) for i in range(1, 9)])
    both = [(a, b) for a in (1, 2, 3, 5, *range(11, 19)) for b in (1, 2, 3, *range(11, 19))]
    pairs = _pairs(spark, both + [(1, 2)])
    tf = tm.term_freq(texts)
    dots = tm.pair_dot(pairs, tf)
    v = {}
    for r in tf.collect():
        v.setdefault(r.text_id, {})[r.term] = r.tf
    want = {f"{a}:{b}": sum(n * v[b].get(t, 0) for t, n in v.get(a, {}).items()) for a, b in both}
    want["1:2"] *= 2  # the pair comes twice
    assert {r.pair_id: r.dot for r in dots.collect()} == {k: n for k, n in want.items() if n}
