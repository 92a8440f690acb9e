"""Property checks on generated texts (hypothesis builds a batch of texts per
example; one Spark job checks the whole batch)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewise.functions.readability import with_readability
from pagewise.operators import terms as tm
from tests.test_text import py_readability

WORDS = ["the", "river", "bridge", "employee", "beautiful", "rhythm", "queue", "apple", "Café", "déjà",
         "x", "strength", "idea", "eerie", "naïve", "OK", "a", "cat"]
PUNCT = [" ", " ", " ", ". ", "! ", "? ", ", ", "\n", " -- ", " ", "...", "  "]
token = st.one_of(st.sampled_from(WORDS), st.sampled_from(PUNCT))
texts = st.lists(st.lists(token, min_size=0, max_size=80).map("".join), min_size=5, max_size=25)

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(texts)
def test_readability_matches_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id INT, text STRING")
    rows = {r.id: r.asDict() for r in with_readability(df, "text", keep=["id"]).collect()}
    for i, t in enumerate(batch):
        for k, v in py_readability(t).items():
            assert math.isclose(rows[i][k], v, abs_tol=0.1001), (t, k, rows[i][k], v)


@SETTINGS
@given(texts)
def test_reading_time_monotone_in_words(spark, batch):
    # appending words never lowers the word count or the reading time
    pairs = [(i, t, t + " the river bridge") for i, t in enumerate(batch)]
    df = spark.createDataFrame(pairs, "id INT, a STRING, b STRING")
    ra = with_readability(df.select("id", F.col("a").alias("t")), "t", keep=["id"])
    rb = with_readability(df.select("id", F.col("b").alias("t")), "t", keep=["id"])
    j = ra.alias("x").join(rb.alias("y"), "id")
    bad = j.filter((F.col("y.word_count") < F.col("x.word_count"))
                   | (F.col("y.reading_time_seconds") < F.col("x.reading_time_seconds"))).count()
    assert bad == 0


@SETTINGS
@given(texts)
def test_cosine_properties(spark, batch):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(batch)], "text_id BIGINT, text STRING")
    n = len(batch)
    pairs = spark.createDataFrame([(f"{a}:{b}", a, b) for a in range(n) for b in range(n)],
                                  "pair_id STRING, left_id BIGINT, right_id BIGINT")
    cos = {(r.left_id, r.right_id): (r.similarity_score, r.sum_sq_left)
           for r in tm.pair_cosine(pairs, tm.term_freq(t)).collect()}
    for (a, b), (s, sq) in cos.items():
        assert 0.0 <= s <= 1.0
        assert s == cos[(b, a)][0]
        if a == b:
            assert s == (1.0 if sq > 0 else 0.0)
