"""Derived inputs built by Spark from the given tables (never written back).

Each fixture grows with its source table; the same rules are written once
more in SQL for the DuckDB oracle (``pagewise/plans/sqlfix.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.functions import urls as U
from pagewise.operators.scoring import KEYWORD_CATEGORIES, SENTIMENT_LABELS
from pagewise.sources import tables as src

# benchmark texts live in the same id space as documents, shifted by this.
BENCH_OFFSET = 1_000_000_000_000
EMPTY_TEXT_ID = -1


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparable texts: documents, benchmark passages and one empty text
    (the "side without words" case)."""
    docs = src.documents(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "text")
    bench = src.benchmark(spark, sf_dir).select(
        (F.col("item_id") + F.lit(BENCH_OFFSET)).alias("text_id"), "text")
    empty = spark.range(0, 1, 1, 1).select(F.lit(EMPTY_TEXT_ID).cast("long").alias("text_id"),
                                  F.lit("").alias("text"))
    return docs.unionByName(bench).unionByName(empty)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair table (pair_id, kind, left_id, right_id):
    adjacent documents (2k, 2k+1); every document with itself; every document
    with one benchmark item, in turn over all items; one document against the
    empty text."""
    docs = src.documents(spark, sf_dir).select("doc_id")
    n_items = src.benchmark(spark, sf_dir).agg(F.max("item_id")).first()[0] + 1  # one number
    adjacent = (docs.filter(F.col("doc_id") % 2 == 0).alias("a")
                .join(docs.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
                .select(F.lit("adjacent").alias("kind"), F.col("a.doc_id").alias("left_id"),
                        F.col("b.doc_id").alias("right_id")))
    self_p = docs.select(F.lit("self").alias("kind"), F.col("doc_id").alias("left_id"),
                         F.col("doc_id").alias("right_id"))
    bench = docs.select(F.lit("benchmark").alias("kind"), F.col("doc_id").alias("left_id"),
                        (F.col("doc_id") % n_items + F.lit(BENCH_OFFSET)).alias("right_id"))
    empty = (docs.agg(F.min("doc_id").alias("left_id"))
             .select(F.lit("empty").alias("kind"), "left_id",
                     F.lit(EMPTY_TEXT_ID).cast("long").alias("right_id")))
    allp = adjacent.unionByName(self_p).unionByName(bench).unionByName(empty)
    return allp.select(F.concat_ws(":", "kind", "left_id", "right_id").alias("pair_id"),
                       "kind", "left_id", "right_id")


# Fixed values for the completions fixture (test inputs of our own).
SENT_LABELS = SENTIMENT_LABELS
CATEGORIES = KEYWORD_CATEGORIES
OVERLONG_SENTIMENT = ('{"sentiment": "NEGATIVE", "confidence": 0.8, "key_phrases": ['
                      + ", ".join(f'"p{i}"' for i in range(8)) + "]}")
OVERLONG_KEYWORDS = ('{"keywords": [' + ", ".join(f'"k{i}"' for i in range(12)) + '], "topics": ['
                     + ", ".join(f'"t{i}"' for i in range(6)) + '], "entities": ['
                     + ", ".join(f'{{"name": "e{i}", "type": "OTHER"}}' for i in range(11))
                     + '], "category": "science", "tags": [' + ", ".join(f'"g{i}"' for i in range(9)) + "]}")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, task, raw): one raw completion per document and task, chosen
    by doc_id % 8 — valid (0-2), not JSON (3), empty (4), unknown label or
    category (5), odd confidence / empty object (6), over-long lists (7)."""
    d = src.documents(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)).alias("w"))
    k = F.col("doc_id") % 8
    w = [F.coalesce(F.get(F.col("w"), i), F.lit("none")) for i in range(3)]
    lab = F.get(F.array(*[F.lit(x) for x in SENT_LABELS]), (F.col("doc_id") % 4).cast("int"))
    cat = F.get(F.array(*[F.lit(x) for x in CATEGORIES]), (F.col("doc_id") % 10).cast("int"))
    q = F.lit('"')
    sentiment = (
        F.when(k <= 2, F.concat(F.lit('{"sentiment": "'), lab, F.lit('", "confidence": 0.'),
                                (F.lit(5) + F.col("doc_id") % 5).cast("string"),
                                F.lit(', "scores": {"positive": 0.6, "negative": 0.3, "neutral": 0.1}, "key_phrases": ['),
                                q, w[0], q, F.lit(", "), q, w[1], q, F.lit(", "), q, w[2], q, F.lit("]}")))
         .when(k == 3, F.concat(F.lit("not json: "), w[0]))
         .when(k == 4, F.lit(""))
         .when(k == 5, F.lit('{"sentiment": "ecstatic", "confidence": 0.7, "key_phrases": []}'))
         .when(k == 6, F.when(F.col("doc_id") % 3 == 0, F.lit('{"sentiment": "positive", "confidence": 1.5}'))
                        .when(F.col("doc_id") % 3 == 1, F.lit('{"sentiment": "positive", "confidence": "0.9"}'))
                        .otherwise(F.lit('{"sentiment": "negative", "confidence": -0.2}')))
         .otherwise(F.lit(OVERLONG_SENTIMENT)))
    keywords = (
        F.when(k <= 2, F.concat(F.lit('{"keywords": ['), q, w[0], q, F.lit(", "), q, w[1], q,
                                F.lit('], "topics": ['), q, w[2], q, F.lit('], "entities": [{"name": '), q, w[0], q,
                                F.lit(', "type": "ORG"}], "category": '), q, cat, q, F.lit(', "tags": ['), q,
                                F.lower(w[0]), q, F.lit("]}")))
         .when(k == 3, F.concat(F.lit("keywords: "), w[0]))
         .when(k == 4, F.lit(""))
         .when(k == 5, F.lit('{"keywords": ["x"], "category": "gardening"}'))
         .when(k == 6, F.lit("{}"))
         .otherwise(F.lit(OVERLONG_KEYWORDS)))
    summary = (
        F.when(k <= 2, F.concat(F.lit("  "), w[0], F.lit(" "), w[1], F.lit(" "), w[2], F.lit(".  ")))
         .when(k == 3, F.concat(F.lit("Summary: "), w[0]))
         .when(k == 4, F.lit(""))
         .otherwise(F.concat(w[0], F.lit(" and "), w[1])))
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), c.alias("raw"))
                      for t, c in (("summary", summary), ("sentiment", sentiment), ("keywords", keywords))])
    return d.select("doc_id", F.explode(tasks).alias("t")).select("doc_id", "t.task", "t.raw")


def derived_dns(urls: DataFrame) -> DataFrame:
    """A deterministic stand-in resolver table (host, ip) built from the hosts
    of the given URLs: 1 in 16 names does not resolve; some names get a second,
    private address of either family (so 'every resolved address is checked' is
    exercised)."""
    h = urls.select(U.hostname(F.col("url")).alias("host")).distinct()
    h = h.filter((F.col("host") != "") & U.ipv4_to_long(F.col("host")).isNull() & ~F.col("host").contains(":"))
    m = F.md5(F.col("host"))

    def octet(i: int) -> Column:
        return F.conv(F.substring(m, 2 * i + 1, 2), 16, 10).cast("long").cast("string")
    public = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    private = F.concat_ws(".", F.lit("10"), octet(4), octet(5), octet(6))
    unique_local = F.concat(F.lit("fd00::"), F.substring(m, 11, 4))
    addrs = (F.when(F.substring(m, 9, 1).isin("a", "b"), F.array(public, private))
              .when(F.substring(m, 9, 1) == "c", F.array(public, unique_local)).otherwise(F.array(public)))
    return (h.filter(~F.substring(m, 1, 1).isin("0"))
             .select("host", F.explode(addrs).alias("ip")))
