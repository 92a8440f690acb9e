"""Request-log queries: keys, reuse, tiers, entitlement, usage, quota, rate
limits, billing, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.operators import metering as M
from pagewise.operators import store as ST
from pagewise.plans.registry import query
from pagewise.plans.sqlfrag import r
from pagewise.session import shared_path
from pagewise.sources import requests as RQ
from pagewise.sources import tables as src

_TIERS_ROWS = ", ".join(
    f"('{t}', '{n}', {p if p is not None else 'NULL'}::DOUBLE, "
    f"{{c{i}}}::BIGINT, {rt if rt is not None else 'NULL'}::BIGINT, "
    f"[{', '.join(repr(e) for e in eps)}], {o if o is not None else 'NULL'}::DOUBLE)"
    for i, (t, n, p, c, rt, eps, o) in enumerate(RQ.TIERS))


def _tiers_sql(scaled: bool) -> str:
    vals = {f"c{i}": ("NULL" if c is None else (c // RQ.SCALE_DIVISOR if scaled else c))
            for i, (_, _, _, c, _, _, _) in enumerate(RQ.TIERS)}
    return (f"(SELECT * FROM (VALUES {_TIERS_ROWS.format(**vals)}) "
            f"AS t(tier, tier_name, price_monthly, calls_per_month, rate_per_minute, endpoints, overage_price))")


_CALLER_TIERS = "[" + ", ".join(f"'{t}'" for t in RQ.CALLER_TIERS) + "]"
_ENDPOINT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RQ.EVENT_ENDPOINT.items()) + " END"
_KNOWN = ", ".join(f"'{t[0]}'" for t in RQ.TIERS)


def _req_sql(dense: bool) -> str:
    caller = "user_id" if dense else "user_id % 7"
    ts = ("make_timestamp(epoch_us(date_trunc('month', ts)) + (epoch_us(ts) - epoch_us(date_trunc('month', ts))) // 60)"
          if dense else "ts")
    return f"""(SELECT event_id AS request_id, {ts} AS ts, {caller} AS caller,
        coalesce({_CALLER_TIERS}[user_id % 7 + 1], 'free') AS tier, {_ENDPOINT} AS endpoint,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 ELSE 200 END AS status,
        value * 10 AS latency_ms,
        'https://h' || (user_id % 20) || '.example.com/' || (event_id % 50) AS url,
        'https://h' || ((user_id + 1) % 20) || '.example.com/' || (event_id % 50) AS url2
      FROM events)"""


_KEYDATA = ("CASE endpoint WHEN 'extract' THEN url || ':False:False:text' "
            "WHEN 'summarize' THEN url || ':tldr:200:en' WHEN 'analyze' THEN url || ':tldr:200' "
            "WHEN 'compare' THEN url || '|' || url2 ELSE url END")
_REQ = f"""req AS {_req_sql(False)}, reqk AS (
    SELECT *, 'pw:' || endpoint || ':' || substr(sha256({_KEYDATA}), 1, 16) AS request_key,
           endpoint || ':' || sha256({_KEYDATA}) AS request_digest FROM req)"""
_DENSE = _REQ.replace(_req_sql(False), _req_sql(True))
_EFF = f"CASE WHEN tier IN ({_KNOWN}) THEN tier ELSE 'free' END"


def _req(spark, sf, dense=False):
    return RQ.requests(spark, sf, dense=dense)


@query("request_key", group="usage", oracle=f"""WITH {_REQ}
SELECT request_id, endpoint, request_key FROM reqk""")
def q_request_key(spark, sf):
    return M.with_request_key(_req(spark, sf)).select("request_id", "endpoint", "request_key")


@query("caller_identity", group="usage", oracle="""
SELECT CASE WHEN user_id % 4 <> 1 THEN 'u' || user_id ELSE '198.51.100.' || (user_id % 250) END AS caller, count(*)::BIGINT AS n_requests
FROM events GROUP BY ALL""")
def q_caller_identity(spark, sf):
    """Requests per identity; every fourth user sends no name (empty or null)."""
    user = F.col("user_id")
    named = F.when(user % 4 != 1, F.concat(F.lit("u"), user.cast("string"))).when(user % 8 == 1, F.lit(""))
    ip = F.concat(F.lit("198.51.100."), (user % 250).cast("string"))
    ev = src.events(spark, sf).select(M.identity(named, ip).alias("caller"))
    return ev.groupBy("caller").agg(F.count(F.lit(1)).alias("n_requests"))


@query("tier_lookup", group="usage", oracle=f"""WITH {_REQ}
SELECT q.tier AS requested_tier, t.tier, count(*)::BIGINT AS n_requests, t.calls_per_month, t.rate_per_minute
FROM req q JOIN {_tiers_sql(False)} t ON t.tier = {_EFF.replace('tier', 'q.tier')}
GROUP BY ALL""")
def q_tier_lookup(spark, sf):
    req = _req(spark, sf).withColumnRenamed("tier", "requested_tier").withColumn("tier", F.col("requested_tier"))
    j = M.with_tier(req, RQ.tiers(spark))
    return j.groupBy("requested_tier", "tier", "calls_per_month", "rate_per_minute").agg(
        F.count(F.lit(1)).alias("n_requests"))


@query("entitlement_violations", group="usage", oracle=f"""WITH {_REQ}
SELECT caller, t.tier, endpoint, count(*)::BIGINT AS n_requests
FROM req q JOIN {_tiers_sql(False)} t ON t.tier = {_EFF.replace('tier', 'q.tier')}
WHERE NOT list_contains(t.endpoints, q.endpoint) GROUP BY ALL""")
def q_entitlement_violations(spark, sf):
    return M.entitlement_violations(_req(spark, sf), RQ.tiers(spark))


_USAGE = f"""WITH {_REQ}, used AS (
    SELECT caller, {_EFF} AS tier, date_trunc('month', ts) AS period_start, count(*)::BIGINT AS calls_used
    FROM req GROUP BY ALL),
  usage AS (
    SELECT u.caller, u.tier, u.period_start,
           u.period_start + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS period_end,
           u.calls_used, t.calls_per_month AS calls_limit,
           CASE WHEN t.calls_per_month IS NOT NULL THEN greatest(t.calls_per_month - u.calls_used, 0) END AS calls_remaining,
           t.price_monthly, t.overage_price
    FROM used u JOIN {_tiers_sql(True)} t USING (tier))"""


@query("usage_monthly", group="usage", oracle=f"{_USAGE} SELECT * FROM usage")
def q_usage_monthly(spark, sf):
    return M.usage_monthly(_req(spark, sf), RQ.tiers(spark, scaled=True))


@query("billing", group="usage", oracle=f"""{_USAGE}
SELECT caller, tier, period_start, calls_used, calls_limit,
       greatest(calls_used - coalesce(calls_limit, calls_used), 0)::BIGINT AS over_quota_calls,
       {r('price_monthly + greatest(calls_used - coalesce(calls_limit, calls_used), 0) * coalesce(overage_price, 0.0::DOUBLE)', 4)} AS amount_due
FROM usage""")
def q_billing(spark, sf):
    return M.billing(M.usage_monthly(_req(spark, sf), RQ.tiers(spark, scaled=True)))


@query("quota_ordinal", group="usage", oracle=f"""WITH {_REQ}, o AS (
    SELECT q.request_id, q.caller, t.tier, date_trunc('month', q.ts) AS period_start,
           row_number() OVER (PARTITION BY q.caller, date_trunc('month', q.ts) ORDER BY q.ts, q.request_id)::BIGINT AS ordinal,
           t.calls_per_month AS calls_limit, t.overage_price
    FROM req q JOIN {_tiers_sql(True)} t ON t.tier = {_EFF.replace('tier', 'q.tier')})
SELECT request_id, caller, tier, period_start, ordinal, calls_limit,
       calls_limit IS NULL OR ordinal <= calls_limit AS in_quota,
       CASE WHEN calls_limit IS NULL OR ordinal <= calls_limit THEN 'ok'
            WHEN overage_price IS NULL THEN 'blocked' ELSE 'overage' END AS action
FROM o""")
def q_quota_ordinal(spark, sf):
    return M.quota_ordinal(_req(spark, sf), RQ.tiers(spark, scaled=True))


@query("rate_violations", group="usage", oracle=f"""WITH req AS {_req_sql(True)}, m AS (
    SELECT caller % 7 AS caller, t.tier, t.rate_per_minute, time_bucket(INTERVAL 1 MINUTE, q.ts) AS window_start, count(*)::BIGINT AS n_calls
    FROM req q JOIN {_tiers_sql(False)} t ON t.tier = {_EFF.replace('tier', 'q.tier')} GROUP BY ALL)
SELECT caller, tier, window_start, n_calls, rate_per_minute AS rate_limit
FROM m WHERE rate_per_minute IS NOT NULL AND n_calls > rate_per_minute""")
def q_rate_violations(spark, sf):
    """Few callers on the dense clock, so that limits are reached."""
    req = _req(spark, sf, dense=True).withColumn("caller", F.col("caller") % RQ.N_CALLERS)
    return M.rate_violations(req, RQ.tiers(spark))


@query("request_metrics", group="usage", oracle=f"""WITH {_REQ}
SELECT endpoint, {_EFF} AS tier, count(*)::BIGINT AS n_requests,
       sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END)::BIGINT AS n_errors,
       {r('sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END) / count(*)', 4)} AS error_share,
       {r('avg(latency_ms)', 4)} AS avg_latency_ms
FROM req GROUP BY CUBE (endpoint, {_EFF})""")
def q_request_metrics(spark, sf):
    return M.request_metrics(_req(spark, sf))


@query("latency_percentiles", group="usage", oracle=f"""WITH {_REQ}
SELECT endpoint, count(*)::BIGINT AS n_requests,
       {r('quantile_cont(latency_ms, 0.5)', 4)} AS p50_latency_ms,
       {r('quantile_cont(latency_ms, 0.95)', 4)} AS p95_latency_ms,
       {r('quantile_cont(latency_ms, 0.99)', 4)} AS p99_latency_ms
FROM req GROUP BY endpoint""")
def q_latency_percentiles(spark, sf):
    return M.latency_percentiles(_req(spark, sf))


@query("incremental_reuse", group="usage", oracle=f"""WITH {_REQ},
  firsts AS (SELECT request_digest, min(ts) AS computed_at FROM reqk
             WHERE ('0x' || substr(md5(request_digest), 1, 6))::BIGINT % 3 = 0 GROUP BY request_digest)
SELECT endpoint, coalesce(computed_at < ts, false) AS cached, count(*)::BIGINT AS n_requests
FROM reqk LEFT JOIN firsts USING (request_digest) GROUP BY ALL""")
def q_incremental_reuse(spark, sf):
    req = M.with_request_key(_req(spark, sf))
    served = M.incremental_reuse(req, M.prior_results(req))
    return served.groupBy("endpoint", "cached").agg(F.count(F.lit(1)).alias("n_requests"))


_TEXT_ENDPOINTS = ["summarize", "sentiment", "keywords"]


@query("text_request_key", group="usage", oracle="""
WITH t AS (SELECT doc_id, unnest(['summarize', 'sentiment', 'keywords']) AS endpoint, coalesce(text, '') AS text FROM documents)
SELECT doc_id, endpoint, 'pw:' || endpoint || ':' || substr(sha256(
         CASE WHEN endpoint = 'summarize' THEN text || ':tldr:200:en' ELSE text END), 1, 16) AS request_key FROM t""")
def q_text_request_key(spark, sf):
    """Keys of requests that carry a text instead of a URL."""
    docs = src.documents(spark, sf).select("doc_id", "text", F.explode(F.array(*map(F.lit, _TEXT_ENDPOINTS))).alias("endpoint"))
    data = M.text_key_data(F.col("endpoint"), F.col("text"))
    return docs.select("doc_id", "endpoint", M.request_key(F.col("endpoint"), data).alias("request_key"))


# Two batches over overlapping times: the first three quarters of the log's span, then its last half.
_SPAN = "(SELECT min(ts) AS t0, max(ts) - min(ts) AS span FROM reqk)"
STORE_TTL = 6 * 3600


@query("result_store", group="usage", oracle=f"""WITH {_DENSE},
  sl AS (SELECT *, floor(epoch_us(ts) / {STORE_TTL * 1_000_000}) AS slice FROM reqk),
  b1 AS (SELECT q.* FROM sl q, {_SPAN} s WHERE ts <= t0 + to_microseconds((epoch_us(t0 + span) - epoch_us(t0)) * 3 // 4)),
  b2 AS (SELECT q.* FROM sl q, {_SPAN} s WHERE ts >= t0 + to_microseconds((epoch_us(t0 + span) - epoch_us(t0)) // 2)),
  c1 AS (SELECT request_digest, slice, min(ts) AS made FROM b1 GROUP BY ALL),
  s1 AS (SELECT 'first' AS batch, b1.request_id, b1.endpoint, made AS computed_at, ts > made AS cached FROM b1 JOIN c1 USING (request_digest, slice)),
  h2 AS (SELECT b2.request_id, b2.request_digest, b2.endpoint, b2.slice, b2.ts,
           (SELECT max(made) FROM c1 WHERE c1.request_digest = b2.request_digest AND made <= b2.ts
            AND made + INTERVAL {STORE_TTL} SECOND > b2.ts) AS hit FROM b2),
  c2 AS (SELECT request_digest, slice, min(ts) AS made FROM h2 WHERE hit IS NULL GROUP BY ALL),
  s2 AS (SELECT 'second' AS batch, request_id, endpoint, coalesce(hit, made) AS computed_at,
           hit IS NOT NULL OR ts > made AS cached FROM h2 LEFT JOIN c2 USING (request_digest, slice))
SELECT batch, request_id, endpoint, computed_at, cached FROM s1 UNION ALL SELECT * FROM s2""")
def q_result_store(spark, sf):
    """Two overlapping batches of the request log against one store; the second
    is run twice, which must not change it."""
    req = M.with_request_key(_req(spark, sf, dense=True)).select("request_id", "request_digest", "endpoint", "ts")
    first, last = req.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    at = F.unix_micros("ts")
    parts = [("first", req.where(at <= first + (last - first) * 3 // 4)), ("second", req.where(at >= first + (last - first) // 2))]
    path = shared_path(spark, "results")

    def compute(rows):
        return rows.withColumn("result", F.md5("request_digest"))
    out = {}
    for name, rows in [*parts, parts[1]]:
        out[name] = ST.serve(rows, path, name, compute, STORE_TTL).select(
            F.lit(name).alias("batch"), "request_id", "endpoint", "computed_at", "cached")
    return out["first"].unionByName(out["second"])


# The times at which each digest is computed: the first request, then the first one a lifetime or more later.
_MISSES = f"""WITH RECURSIVE {_DENSE},
  miss AS (SELECT request_digest, min(ts) AS t FROM reqk GROUP BY request_digest
           UNION ALL
           SELECT m.request_digest, min(q.ts) FROM miss m JOIN reqk q
             ON q.request_digest = m.request_digest AND q.ts >= m.t + INTERVAL 3600 SECOND GROUP BY m.request_digest, m.t)"""


@query("ttl_reuse", group="usage", oracle=f"""{_MISSES},
  last AS (SELECT q.request_id, q.request_key, q.ts, q.endpoint, max(m.t) AS t
           FROM reqk q JOIN miss m ON m.request_digest = q.request_digest AND m.t <= q.ts GROUP BY ALL)
SELECT request_id, request_key, ts, endpoint, CASE WHEN t < ts THEN t END AS served_from, t < ts AS cached FROM last""")
def q_ttl_reuse(spark, sf):
    return M.ttl_reuse(M.with_request_key(_req(spark, sf, dense=True)))
