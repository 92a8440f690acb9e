"""Streaming queries: each runs a Structured Streaming job over the table's
files (availableNow) into a parquet sink and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.plans.q_usage import _MISSES, _req_sql
from pagewise.plans.registry import REGISTRY, query
from pagewise.streaming import streams as ST


def _unmasked(name: str) -> str:
    """The SQL of an endpoint's records without its gates."""
    from pagewise.plans import q_endpoints  # noqa: F401 — registers the endpoints
    sql = REGISTRY[name].oracle
    return f"SELECT * EXCLUDE (error_code) FROM ({sql.replace('error_code IS NULL', 'true')})"


@query("stream_enrich", group="streaming", oracle=_unmasked("endpoint_seo"))
def q_stream_enrich(spark, sf):
    out = ST.run_available(ST.enrichment_stream(ST.read_stream(spark, sf, "pages")), "enrich")
    return out.select("page_id", "title", F.size("h1_tags").cast("long").alias("h1_count"), "word_count",
                      "internal_links", "external_links")


@query("stream_extract", group="streaming", oracle=_unmasked("endpoint_extract"))
def q_stream_extract(spark, sf):
    out = ST.run_available(ST.extraction_stream(ST.read_stream(spark, sf, "pages")), "extract")
    return out.select("page_id", "title", "word_count", "excerpt", "language",
                      F.col("readability.flesch_reading_ease").alias("flesch_reading_ease"))


@query("stream_dedup", group="streaming", oracle=f"""{_MISSES}
SELECT min(request_id) AS request_id, q.request_key, q.ts, q.endpoint
FROM reqk q JOIN miss m ON m.request_digest = q.request_digest AND m.t = q.ts
GROUP BY q.request_digest, q.request_key, q.ts, q.endpoint""")
def q_stream_dedup(spark, sf):
    """One request of each digest per lifetime; repeats after it are kept again."""
    return ST.run_available(ST.dedup_stream(ST.requests_stream(spark, sf, dense=True)), "dedup")


@query("stream_minute_metering", group="streaming", oracle=f"""WITH req AS {_req_sql(True)}
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, caller, count(*)::BIGINT AS n_calls
FROM req GROUP BY ALL""")
def q_stream_minute_metering(spark, sf):
    s = ST.minute_metering(ST.requests_stream(spark, sf, dense=True))
    return ST.run_available(s, "metering", "update", keys=["window_start", "caller"])


@query("stream_sliding_metering", group="streaming", oracle=f"""WITH req AS {_req_sql(True)}
SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS window_start, caller, count(*)::BIGINT AS n_calls
FROM req, range(5) AS r(k) GROUP BY ALL""")
def q_stream_sliding_metering(spark, sf):
    s = ST.minute_metering(ST.requests_stream(spark, sf, dense=True), "5 minutes", "1 minute")
    return ST.run_available(s, "sliding", "update", keys=["window_start", "caller"])


@query("stream_sessions", group="streaming", oracle=f"""WITH req AS {_req_sql(True)},
  g AS (SELECT caller, ts, endpoint,
               CASE WHEN lag(ts) OVER (PARTITION BY caller ORDER BY ts) IS NULL
                      OR ts - lag(ts) OVER (PARTITION BY caller ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
        FROM req),
  s AS (SELECT *, sum(new_s) OVER (PARTITION BY caller ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT caller, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       count(*)::BIGINT AS n_calls, count(DISTINCT endpoint)::BIGINT AS n_endpoints
FROM s GROUP BY caller, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM req) - INTERVAL 2 MINUTE""")
def q_stream_sessions(spark, sf):
    """Append mode: a session is final (and emitted) once the watermark
    (latest event time - 2 minutes) passes its end; sessions still open when
    the input runs out stay in state for the next run."""
    s = ST.sessions(ST.requests_stream(spark, sf, dense=True))
    return ST.run_available(s, "sessions", "append")

