"""Robust parsing of model completions and the Arrow-batched scorer hook."""

from pyspark.sql import functions as F

from pagewise.operators import scoring as SC


def test_sentiment_parse(spark):
    raws = ['{"sentiment": "POSITIVE", "confidence": "0.9", "key_phrases": ["a","b","c","d","e","f"]}',
            "not json", "", '{"sentiment": "ecstatic", "confidence": 1.5}', '{"confidence": -0.2}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i INT, raw STRING")
    f = SC.sentiment_fields(F.col("raw"))
    out = df.select("i", *[v.alias(k) for k, v in f.items()]).orderBy("i").collect()
    assert (out[0].sentiment, out[0].confidence, len(out[0].key_phrases)) == ("positive", 0.9, 5)
    assert (out[1].sentiment, out[1].confidence, out[1].scores) == ("neutral", 0.5, SC.FALLBACK_SCORES)
    assert (out[2].json_valid, out[2].sentiment, out[2].confidence, out[2].scores) == (True, "neutral", 0.5, {})
    assert (out[3].sentiment, out[3].confidence) == ("neutral", 1.0)
    assert (out[4].sentiment, out[4].confidence) == ("neutral", 0.0)
    assert out[5].sentiment == "neutral"


def test_keyword_parse(spark):
    raws = ['{"keywords": ' + str([f"k{i}" for i in range(12)]).replace("'", '"') + ', "category": "gardening"}',
            "{bad", '{"tags": ["a","b","c","d","e","f","g","h"]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i INT, raw STRING")
    f = SC.keyword_fields(F.col("raw"))
    out = df.select("i", *[v.alias(k) for k, v in f.items()]).orderBy("i").collect()
    assert len(out[0].keywords) == 10 and out[0].category == "gardening"
    assert out[1].keywords == [] and out[1].category == "other"
    assert len(out[2].tags) == 7 and out[2].category == "other"


def test_scorer_hook(spark):
    docs = spark.createDataFrame([(1, "Great results. The team was happy."), (2, "Bad news, a terrible loss.")],
                                 "doc_id BIGINT, text STRING")
    p = SC.prompt_table(docs, spark)
    assert p.count() == 6
    scored = SC.score(p)
    echo = SC.score(p, lambda batch: batch["task"] + ":" + batch["input"].str.len().astype(str))
    assert {r.raw for r in echo.collect()} >= {"summary:34", "keywords:26"}
    sent = scored.filter(F.col("task") == "sentiment").select(
        "doc_id", SC.sentiment_fields(F.col("raw"))["sentiment"].alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in sent] == ["positive", "negative"]
