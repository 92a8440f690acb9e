"""Comparison records: how the texts are dealt out and read."""

from pagewise.functions.text import WS_CHARS, ws_word_count
from pagewise.operators import compare
from pagewise.operators import terms as tm
from pagewise.plans import q_endpoints
from pyspark.sql import functions as F


def test_profile_is_dealt_out_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(tm, "TASK_TEXT_BYTES", 100)
    texts = spark.createDataFrame([(i, "one two three four " * 10) for i in range(8)] + [(9, None)], "text_id long, text string")
    profile = compare.text_profile(texts)
    assert profile.rdd.getNumPartitions() == 16
    assert sorted((r.text_id, r.ws_words) for r in profile.collect()) == [*((i, 40) for i in range(8)), (9, 0)]


def test_ws_words_of_every_kind_of_character(spark):
    kinds = [*map(chr, range(1, 0x180)), *WS_CHARS, "​", "⁠", "﻿", "一", "\U0001f600", "~", "!"]
    texts = [f"a{c}b {c} {c}{c}" for c in kinds] + ["", " ", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.n for r in d.select("i", ws_word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}


def test_endpoint_compare_extracts_each_page_once(spark, monkeypatch, tmp_path):
    html = "<html><body><article>{}</article></body></html>"
    spark.createDataFrame([(i, f"https://h{i}.example.com/", html.format(f"word{i} common text " * 12)) for i in range(4)],
                          "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    read = []
    monkeypatch.setattr(q_endpoints, "compare_records",
                        lambda pairs, texts: read.extend(texts.inputFiles()) or compare.compare_records(pairs, texts))
    out = q_endpoints.q_endpoint_compare(spark, str(tmp_path))
    assert {(r.left_id, r.right_id) for r in out.collect()} == {(0, 1), (2, 3)}
    assert read and all("page_texts" in f for f in read)
