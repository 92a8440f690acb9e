"""Admission queries: URL safety verdicts, input resolution, validation,
error classification and the envelope."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.functions import urls as U
from pagewise.functions.text import ws_word_count
from pagewise.operators import admission as A
from pagewise.operators import networks as N
from pagewise.operators import pages as P
from pagewise.operators import patterns as PT
from pagewise.operators import store as ST
from pagewise.plans import sqlhtml as S
from pagewise.plans.registry import query
from pagewise.plans.sqlfrag import NONWS, sq, ws_count
from pagewise.session import cut_lineage, shared_path, spread
from pagewise.sources import fixtures as fx
from pagewise.sources import requests as RQ
from pagewise.sources import tables as src

# Job configuration: block patterns (comma-separated setting, already split).
BLOCK_PATTERNS = [r"\.net/", "utm_source=", "  "]

_V4 = (r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")


def _urls(spark, sf):
    ts = P.tag_stage(spread(src.pages(spark, sf)))
    links = ts.select(F.explode(U.join_urls(F.col("base"), P.link_hrefs(*P.parsed()))).alias("url"))
    return src.pages(spark, sf).select("url").unionByName(links)


def _dns(urls):
    return fx.derived_dns(urls)


def _sql_ip_num(h: str) -> str:
    parts = [f"split_part({h}, '.', {i})::BIGINT" for i in range(1, 5)]
    return (f"CASE WHEN regexp_matches({h}, {sq(_V4)}) THEN "
            f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END")


def _octet(i: int) -> str:
    return f"(('0x' || substr(md5(host), {2 * i + 1}, 2))::INTEGER)::VARCHAR"


_CIDR = "(VALUES " + ", ".join(f"('{c}', {U.cidr_bounds(c)[0]}, {U.cidr_bounds(c)[1]})" for c in U.BLOCKED_V4) + ") AS c(cidr, lo, hi)"
_PATS = "(VALUES " + ", ".join(f"({sq(p.strip())})" for p in BLOCK_PATTERNS if p.strip()) + ") AS pats(pattern)"

_URL_CTES = f"""WITH ts AS (SELECT page_id, url, {S.strip_code(S.strip_comments('html'))} AS clean FROM pages),
  hr AS (SELECT url, unnest({S.href_list('clean')}) AS href FROM ts),
  urls AS (SELECT url FROM pages UNION ALL SELECT {S.join_url('url', 'href')} AS url FROM hr),
  u AS (SELECT DISTINCT url, {S.scheme('url')} AS scheme, {S.hostname('url')} AS host FROM urls),
  hosts AS (SELECT DISTINCT host FROM u WHERE host <> ''),
  names AS (SELECT host FROM hosts WHERE NOT regexp_matches(host, {sq(_V4)}) AND NOT contains(host, ':')),
  dns AS (SELECT host, ip FROM (
      SELECT host, unnest(CASE WHEN substr(md5(host), 9, 1) IN ('a', 'b')
                               THEN [concat_ws('.', {_octet(0)}, {_octet(1)}, {_octet(2)}, {_octet(3)}),
                                     concat_ws('.', '10', {_octet(4)}, {_octet(5)}, {_octet(6)})]
                               WHEN substr(md5(host), 9, 1) = 'c'
                               THEN [concat_ws('.', {_octet(0)}, {_octet(1)}, {_octet(2)}, {_octet(3)}),
                                     'fd00::' || substr(md5(host), 11, 4)]
                               ELSE [concat_ws('.', {_octet(0)}, {_octet(1)}, {_octet(2)}, {_octet(3)})] END) AS ip
      FROM names WHERE substr(md5(host), 1, 1) <> '0')),
  addrs AS (SELECT host, host AS ip FROM hosts WHERE regexp_matches(host, {sq(_V4)}) OR contains(host, ':')
            UNION ALL SELECT d.host, d.ip FROM dns d JOIN hosts USING (host)),
  hit AS (SELECT a.host, a.ip, c.cidr FROM addrs a LEFT JOIN {_CIDR}
            ON {_sql_ip_num('a.ip')} BETWEEN c.lo AND c.hi),
  addr AS (SELECT host, count(DISTINCT ip)::BIGINT AS n_addresses,
                  bool_or(cidr IS NOT NULL OR regexp_matches(ip, '^(::1$|[fF][cCdD]..:|[fF][eE][89abAB].:)')) AS any_private
           FROM hit GROUP BY host),
  blocked AS (SELECT DISTINCT url FROM u JOIN {_PATS} ON regexp_matches(url, '(?i)' || pattern))"""


@query("url_verdict", group="urls", oracle=f"""{_URL_CTES}
SELECT u.url, u.host, r IS NULL AS ok, r AS reason FROM (
  SELECT u.*, CASE WHEN scheme NOT IN ('http', 'https') THEN 'INVALID_SCHEME' WHEN host = '' THEN 'NO_HOST'
    WHEN host IN ({', '.join(sq(h) for h in U.BLOCKED_HOSTS)}) THEN 'BLOCKED_HOST'
    WHEN b.url IS NOT NULL THEN 'BLOCKED_PATTERN' WHEN coalesce(a.any_private, false) THEN 'PRIVATE_ADDRESS'
    WHEN coalesce(a.n_addresses, 0) = 0 THEN 'UNRESOLVABLE' END AS r
  FROM u LEFT JOIN blocked b USING (url) LEFT JOIN addr a USING (host)) u""")
def q_url_verdict(spark, sf):
    urls = _urls(spark, sf)
    return A.url_verdict(urls, _dns(urls), BLOCK_PATTERNS)


@query("url_blocklist", group="urls", oracle=f"""{_URL_CTES}
SELECT url, count(*)::BIGINT AS n_patterns FROM u JOIN {_PATS} ON regexp_matches(url, '(?i)' || pattern) GROUP BY url""")
def q_url_blocklist(spark, sf):
    u = _urls(spark, sf).select("url").distinct()
    return u.withColumn("n_patterns", A.pattern_hits(F.col("url"), BLOCK_PATTERNS)).where("n_patterns > 0")


@query("url_private_ip", group="urls", oracle=f"""{_URL_CTES}
SELECT host, ip, cidr FROM hit""")
def q_url_private_ip(spark, sf):
    urls = _urls(spark, sf)
    hosts = urls.select(U.hostname(F.col("url")).alias("host")).filter(F.col("host") != "").distinct()
    return A.host_addresses(hosts, _dns(urls)).select(
        "host", "ip", F.explode_outer(A.blocked_networks(F.col("ip"))).alias("cidr"))


@query("url_dns_check", group="urls", oracle=f"""{_URL_CTES}
SELECT h.host, coalesce(a.n_addresses, 0)::BIGINT AS n_addresses, coalesce(a.any_private, false) AS any_private,
       coalesce(a.n_addresses, 0) > 0 AS resolvable
FROM hosts h LEFT JOIN addr a USING (host)""")
def q_url_dns_check(spark, sf):
    urls = _urls(spark, sf)
    hosts = urls.select(U.hostname(F.col("url")).alias("host")).filter(F.col("host") != "").distinct()
    a = A.url_addresses(hosts, _dns(urls))
    j = hosts.join(a, "host", "left")
    return j.select("host", F.coalesce("n_addresses", F.lit(0)).cast("long").alias("n_addresses"),
                    F.coalesce("any_private", F.lit(False)).alias("any_private"),
                    (F.coalesce("n_addresses", F.lit(0)) > 0).alias("resolvable"))


# ---------------------------------------------------------------- inputs

def _options(df):
    """Summarize options derived per row (some deliberately invalid)."""
    fmts = A.SUMMARY_FORMATS + ["haiku"]
    return df.select("request_id", "url", "text",
                     F.get(F.array(*[F.lit(f) for f in fmts]), (F.col("n") % len(fmts)).cast("int")).alias("format"),
                     ((F.col("n") * 37) % 1100).alias("max_length"))


def _url_requests(pages):
    return _options(pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("request_id"), "url",
                                 "text", F.col("page_id").alias("n")))


def _text_requests(spark, sf):
    """Every document as a text request; every seventh without a text, every
    eleventh with a blank one."""
    n = F.col("doc_id")
    text = F.when(n % 7 == 3, F.lit(None).cast("string")).when(n % 11 == 5, F.lit(" \n\t")).otherwise(F.col("text"))
    return _options(src.documents(spark, sf).select(
        F.concat(F.lit("doc:"), n.cast("string")).alias("request_id"), F.lit(None).cast("string").alias("url"),
        text.alias("text"), n.alias("n")))


def _requests(spark, sf):
    """Summarize-style requests as they come in: pages by URL, documents by text."""
    pages = src.pages(spark, sf).withColumn("text", F.lit(None).cast("string"))
    return _url_requests(pages).unionByName(_text_requests(spark, sf))


def _extracted(spark, sf):
    return P.with_main_text(P.tag_stage(spread(src.pages(spark, sf)))).select("page_id", "url", "text")


_REQ_SQL = """reqs AS (
    SELECT 'page:' || page_id AS request_id, url, NULL::VARCHAR AS text, page_id, page_id AS n FROM pages
    UNION ALL SELECT 'doc:' || doc_id, NULL::VARCHAR, CASE WHEN doc_id % 7 = 3 THEN NULL
                     WHEN doc_id % 11 = 5 THEN ' ' || chr(10) || chr(9) ELSE text END, NULL::BIGINT, doc_id FROM documents),
  reqo AS (SELECT *, ['tldr', 'bullets', 'key_takeaways', 'paragraph', 'haiku'][n % 5 + 1] AS format,
                  (n * 37) % 1100 AS max_length FROM reqs)"""
_EXTRACT_SQL = f"""ex AS (SELECT page_id, CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS text
    FROM (SELECT page_id, {S.main_text(S.strip_boilerplate(S.strip_code(S.strip_comments('html'))))} AS m FROM pages))"""
_RESOLVED_SQL = f"""WITH {_REQ_SQL}, {_EXTRACT_SQL},
  res AS (SELECT r.request_id, r.url, r.format, r.max_length, r.text AS given_text,
                 CASE WHEN r.url IS NOT NULL THEN coalesce(e.text, '') ELSE coalesce(r.text, '') END AS text
          FROM reqo r LEFT JOIN ex e USING (page_id))"""


def _resolved(spark, sf):
    return A.resolve_inputs(_url_requests(_extracted(spark, sf)), _text_requests(spark, sf))


@query("input_union", group="admission", oracle=f"""{_RESOLVED_SQL}
SELECT request_id, url IS NOT NULL AS from_url, length(text)::BIGINT AS text_chars, {ws_count('text')} AS ws_words FROM res""")
def q_input_union(spark, sf):
    r = _resolved(spark, sf)
    return r.select("request_id", F.col("url").isNotNull().alias("from_url"),
                    F.length("text").cast("long").alias("text_chars"), ws_word_count(F.col("text")).alias("ws_words"))


@query("err_missing_input", group="admission", oracle=f"""WITH {_REQ_SQL}
SELECT request_id, url IS NULL AND coalesce(text, '') = '' AS missing_input FROM reqo""")
def q_err_missing_input(spark, sf):
    r = _requests(spark, sf)
    return r.select("request_id", A.missing_input(F.col("url"), F.col("text")).alias("missing_input"))


@query("err_no_content", group="admission", oracle=f"""{_RESOLVED_SQL}
SELECT request_id, NOT coalesce(regexp_matches(text, {NONWS}), false) AS no_content FROM res""")
def q_err_no_content(spark, sf):
    r = _resolved(spark, sf)
    return r.select("request_id", A.no_content(F.col("text")).alias("no_content"))


@query("err_validation", group="admission", oracle=f"""WITH {_REQ_SQL}
SELECT request_id, CASE WHEN format NOT IN ('tldr', 'bullets', 'key_takeaways', 'paragraph') THEN 'VALIDATION_ERROR:format'
  WHEN max_length < 20 OR max_length > 1000 THEN 'VALIDATION_ERROR:max_length'
  WHEN coalesce(length(text), 0) > 50000 THEN 'VALIDATION_ERROR:text'
  WHEN url IS NOT NULL AND {S.scheme('url')} NOT IN ('http', 'https') THEN 'VALIDATION_ERROR:url' END AS error
FROM reqo""")
def q_err_validation(spark, sf):
    r = _requests(spark, sf)
    return r.select("request_id", A.validation_error(F.col("url"), F.col("text"), F.col("format"),
                                                     F.col("max_length")).alias("error"))


_KINDS = "(VALUES " + ", ".join(f"('{k}', {s}, '{c}')" for k, s, c in A.ERROR_KINDS) + ") AS ek(kind, http_status, code)"
_EV_ENDPOINT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RQ.EVENT_ENDPOINT.items()) + " END"
_STAGE = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.ENDPOINT_STAGE.items()) + " END"


# Failed events take every known kind in turn, and one that is not known.
_FAILURES = [k for k, _, _ in A.ERROR_KINDS] + ["unhandled"]
_EV_KIND = (f"CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN [{', '.join(sq(k) for k in _FAILURES)}]"
            f"[event_id // 3 % {len(_FAILURES)} + 1] END")


@query("classify_errors", group="admission", oracle=f"""{_URL_CTES},
  o AS (SELECT 'page:' || p.page_id AS outcome_id, 'extract' AS endpoint,
               CASE WHEN v.r IS NOT NULL THEN 'invalid_url' WHEN length(p.html) > 10000000 THEN 'invalid_content' END AS kind
        FROM pages p LEFT JOIN (
          SELECT u.url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'x' WHEN host = '' THEN 'x'
            WHEN host IN ({', '.join(sq(h) for h in U.BLOCKED_HOSTS)}) THEN 'x' WHEN b.url IS NOT NULL THEN 'x'
            WHEN coalesce(a.any_private, false) THEN 'x' WHEN coalesce(a.n_addresses, 0) = 0 THEN 'x' END AS r
          FROM u LEFT JOIN blocked b USING (url) LEFT JOIN addr a USING (host)) v USING (url)
        UNION ALL
        SELECT 'event:' || event_id, {_EV_ENDPOINT}, {_EV_KIND}
        FROM events)
SELECT o.endpoint, o.kind, CASE WHEN o.kind IS NOT NULL THEN coalesce(ek.http_status, 500) END AS http_status,
       CASE WHEN o.kind IS NOT NULL THEN coalesce(ek.code, upper({_STAGE.replace('endpoint', 'o.endpoint')}) || '_FAILED') END AS error_code,
       count(*)::BIGINT AS n
FROM o LEFT JOIN {_KINDS} USING (kind) GROUP BY ALL""")
def q_classify_errors(spark, sf):
    urls = _urls(spark, sf)
    v = A.url_verdict(urls, _dns(urls), BLOCK_PATTERNS).select("url", "ok")
    pg = src.pages(spark, sf).select("page_id", "url", F.length("html").alias("n")).join(v, "url", "left")
    pages_o = pg.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("outcome_id"),
                        F.lit("extract").alias("endpoint"),
                        F.when(~F.coalesce(F.col("ok"), F.lit(True)), F.lit("invalid_url"))
                         .when(F.col("n") > 10_000_000, F.lit("invalid_content")).alias("kind"))
    ev = src.events(spark, sf)
    ev_o = ev.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("outcome_id"),
                     RQ.endpoint_of(F.col("event_type")).alias("endpoint"),
                     F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0),
                            F.get(F.array(*[F.lit(k) for k in _FAILURES]),
                                  F.expr(f"cast(event_id div 3 % {len(_FAILURES)} as int)"))).alias("kind"))
    c = A.classify_errors(pages_o.unionByName(ev_o), spark)
    return c.groupBy("endpoint", "kind", "http_status", "error_code").agg(F.count(F.lit(1)).alias("n"))


@query("envelope", group="admission", oracle=f"""{_RESOLVED_SQL}
SELECT regexp_matches(text, {NONWS}) AS success, CASE WHEN regexp_matches(text, {NONWS}) THEN request_id END AS request_id,
       CASE WHEN regexp_matches(text, {NONWS}) THEN length(text)::BIGINT END AS text_chars,
       CASE WHEN NOT regexp_matches(text, {NONWS}) THEN 'NO_CONTENT' END AS error_code, false AS cached FROM res""")
def q_envelope(spark, sf):
    """Resolved inputs in envelopes: a blank text is an error, anything else a
    success (the wall-clock time is left out of the result)."""
    rows = _resolved(spark, sf).select("request_id", F.length("text").cast("long").alias("text_chars"),
                                       A.no_content(F.col("text")).alias("blank"))
    e = A.envelope(rows, ["request_id", "text_chars"], F.when(F.col("blank"), F.lit("NO_CONTENT")))
    return e.select("success", "data.request_id", "data.text_chars", F.col("error.code").alias("error_code"), "cached")


@query("envelope_sink", group="admission", oracle=f"""{_RESOLVED_SQL}, e AS (
    SELECT CASE WHEN length(text) % 2 = 0 THEN 'summarize' ELSE 'sentiment' END AS endpoint,
           DATE '2024-01-01' + (length(text) % 3)::INTEGER AS day, regexp_matches(text, {NONWS}) AS success, length(text) AS n FROM res)
SELECT f.fmt, strftime(day, '%Y-%m-%d') AS day, endpoint, success, count(*)::BIGINT AS n_envelopes,
       sum(CASE WHEN success THEN n END)::BIGINT AS text_chars, count(*) FILTER (NOT success)::BIGINT AS n_errors
FROM e, (VALUES ('parquet'), ('json')) AS f(fmt) GROUP BY ALL""")
def q_envelope_sink(spark, sf):
    """Envelopes written twice by (day, endpoint) and read back, in both formats."""
    rows = _resolved(spark, sf).select(
        "request_id", F.length("text").cast("long").alias("text_chars"), A.no_content(F.col("text")).alias("blank"),
        F.when(F.length("text") % 2 == 0, F.lit("summarize")).otherwise(F.lit("sentiment")).alias("endpoint"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.length("text") % 3).cast("int")).alias("day"))
    sent = A.envelope(rows, ["request_id", "text_chars"], F.when(F.col("blank"), F.lit("NO_CONTENT")), keep=["day", "endpoint"])
    out = []
    for fmt in ("parquet", "json"):
        path = shared_path(spark, f"envelopes-{fmt}")
        for _ in range(2):  # the second run replaces the first
            ST.write_envelopes(sent, path, "daily", fmt=fmt)
        out.append(ST.read_envelopes(spark, path, sent, fmt).groupBy(F.col("day").cast("string").alias("day"), "endpoint", "success").agg(
            F.count(F.lit(1)).alias("n_envelopes"), F.sum("data.text_chars").alias("text_chars"),
            F.count("error.code").alias("n_errors")).withColumn("fmt", F.lit(fmt)))
    return out[0].unionByName(out[1])


# Networks from data: those of the fixed list, one of 20 bits around every eighth IPv4 address
# that a host resolves to, and one of 120 bits around every other IPv6 address.
_BLOCKED_V6 = ["::1/128", "fc00::/7", "fe80::/10"]
_NET_SQL = f"""nets AS (
    SELECT unnest([{', '.join(sq(c) for c in [*U.BLOCKED_V4, *_BLOCKED_V6])}]) AS cidr
    UNION SELECT ip || '/20' FROM addrs WHERE regexp_matches(ip, {sq(_V4)}) AND substr(md5(ip), 1, 1) IN ('0', '8')
    UNION SELECT ip || '/120' FROM addrs WHERE contains(ip, ':') AND substr(md5(ip), 1, 1) < '8')"""
# 128 bits as two numbers of 64; the addresses of these tables are of the form a::b or ::b
_HALF = "(('0x' || rpad(lpad(split_part({x}, '::', 1), 4, '0'), 16, '0'))::UBIGINT)"
_LOW = "(('0x' || lpad(split_part({x}, '::', 2), 16, '0'))::UBIGINT)"


@query("network_hits", group="urls", oracle=f"""{_URL_CTES}, {_NET_SQL},
  n4 AS (SELECT cidr, split_part(cidr, '/', 2)::INTEGER AS l, {_sql_ip_num("split_part(cidr, '/', 1)")} AS v FROM nets),
  a4 AS (SELECT DISTINCT ip, {_sql_ip_num('ip')} AS v FROM addrs),
  n6 AS (SELECT cidr, split_part(cidr, '/', 2)::INTEGER AS l, split_part(cidr, '/', 1) AS s FROM nets WHERE contains(cidr, ':')),
  b6 AS (SELECT cidr, l, {_HALF.format(x='s')} AS hi, {_LOW.format(x="(CASE WHEN s LIKE '%::' THEN s || '0' ELSE s END)")} AS lo FROM n6),
  a6 AS (SELECT DISTINCT ip, {_HALF.format(x='ip')} AS hi, {_LOW.format(x='ip')} AS lo FROM addrs WHERE contains(ip, ':'))
SELECT a4.ip, n4.cidr FROM a4 JOIN n4 ON a4.v >> (32 - l) = n4.v >> (32 - l)
UNION ALL
SELECT a6.ip, b6.cidr FROM a6 JOIN b6
  ON CASE WHEN l <= 64 THEN a6.hi >> (64 - l) = b6.hi >> (64 - l)
          ELSE a6.hi = b6.hi AND a6.lo >> (128 - l) = b6.lo >> (128 - l) END""")
def q_network_hits(spark, sf):
    """Every address that a host resolves to against a table of networks of both families."""
    urls = _urls(spark, sf)
    hosts = urls.select(U.hostname(F.col("url")).alias("host")).filter(F.col("host") != "").distinct()
    # read by the networks made of them, their lengths and the join
    addresses = cut_lineage(A.host_addresses(hosts, _dns(urls)).select("ip").distinct(), "addresses")
    mark, six = F.substring(F.md5("ip"), 1, 1), F.col("ip").contains(":")
    own = addresses.select(F.when(~six & mark.isin("0", "8"), F.concat("ip", F.lit("/20"))).when(
        six & (mark < "8"), F.concat("ip", F.lit("/120"))).alias("cidr")).where("cidr IS NOT NULL")
    fixed = spark.createDataFrame([(c,) for c in [*U.BLOCKED_V4, *_BLOCKED_V6]], "cidr string")
    return N.network_hits(addresses, fixed.unionByName(own))


# A pattern table from data: the fixed patterns, and the names and paths of some page URLs.
_TABLE_PATTERNS = [*BLOCK_PATTERNS, "/[0-9]+$", "https?://h", "(blog|news)/", "page-?[0-9]{1,3}\\b", "[?&]ref=", "no-such-literal"]
_PATTERN_SQL = f"""pt AS (
    SELECT unnest([{', '.join(sq(p.strip()) for p in _TABLE_PATTERNS if p.strip())}]) AS pattern
    UNION SELECT replace({S.hostname('url')}, '.', '\\.') || '/' FROM pages WHERE page_id % 5 = 0
    UNION SELECT {S.part('url', U.G_PATH)} || '$' FROM pages WHERE page_id % 7 = 0 AND {S.part('url', U.G_PATH)} <> '')"""


@query("url_pattern_table", group="urls", oracle=f"""{_URL_CTES}, {_PATTERN_SQL}
SELECT pattern, count(DISTINCT url)::BIGINT AS n_urls, min(url) AS first_url
FROM pt JOIN u ON regexp_matches(url, '(?i)' || pattern) GROUP BY pattern""")
def q_url_pattern_table(spark, sf):
    """All URLs against a pattern table of any size."""
    pages = src.pages(spark, sf)
    own = pages.where("page_id % 5 = 0").select(F.concat(F.replace(U.hostname(F.col("url")), F.lit("."), F.lit("\\.")), F.lit("/")).alias("pattern"))
    paths = pages.where("page_id % 7 = 0").select(U.path(F.col("url")).alias("p")).where("p <> ''").select(F.concat("p", F.lit("$")).alias("pattern"))
    fixed = spark.createDataFrame([(p,) for p in _TABLE_PATTERNS], "pattern string")
    hits = PT.pattern_hits(_urls(spark, sf), fixed.unionByName(own).unionByName(paths))
    return hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_urls"), F.min("url").alias("first_url"))
