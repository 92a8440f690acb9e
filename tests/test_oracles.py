"""Spark queries vs their DuckDB oracle SQL (a representative subset per group
at sf0.001; tools/check_oracles.py runs all of them at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
SUBSET = ["readability", "sentence_count", "pair_similarity", "compare_record", "top_keywords",
          "html_main_text", "link_counts", "url_join", "seo_meta", "quality_grade", "quality_rollup",
          "usage_monthly", "quota_ordinal", "latency_percentiles", "ttl_reuse", "sentiment_record",
          "keyword_record", "url_verdict", "err_validation", "classify_errors", "stream_minute_metering",
          "content_record", "seo_record", "html_author", "seo_jsonld", "quality_rich", "copy_clusters",
          "endpoint_extract", "endpoint_summarize", "endpoint_compare", "stream_sessions", "gate_content_type", "html_markdown", "similarity_join", "result_store",
          "envelope_sink", "quality_by_language", "network_hits", "url_pattern_table", "text_request_key", "link_edges"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_builder():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 105


@pytest.mark.parametrize("name", SUBSET)
def test_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF).toPandas()
    odf = con.execute(entry.oracle_sql()[name]).df()
    ok, msg = compare(name, sdf, odf)
    assert ok, msg


def test_entry_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"host", "grade", "n_pages", "avg_score"} <= set(df.columns)
