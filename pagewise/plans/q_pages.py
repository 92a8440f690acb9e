"""Page queries: scan + gates, HTML extraction fields, SEO fields, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.functions import html as H
from pagewise.functions import urls as U
from pagewise.functions.text import excerpt, ws_word_count
from pagewise.operators import pages as P
from pagewise.plans import sqlhtml as S
from pagewise.plans.registry import query
from pagewise.plans.sqlfrag import sq, ws_count, ws_trim
from pagewise.session import spread
from pagewise.sources import tables as src

MAX_HTML_CHARS = 10_000_000


def _pages(spark, sf):
    return spread(src.pages(spark, sf))


def _ts(spark, sf):
    return P.tag_stage(_pages(spark, sf))


# A DuckDB "tag stage" over pages: nc (no comments), clean (no scripts/styles).
_TS = f"""ts AS (SELECT page_id, url, nc, {S.strip_code('nc')} AS clean
               FROM (SELECT page_id, url, {S.strip_comments('html')} AS nc FROM pages))"""


@query("scan_pages", group="pages", oracle="""
SELECT page_id, url, length(html)::BIGINT AS html_chars FROM pages""")
def q_scan_pages(spark, sf):
    return src.pages(spark, sf).select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


@query("gate_size", group="pages", oracle=f"""
SELECT page_id, length(html) <= {MAX_HTML_CHARS} AS accepted,
       CASE WHEN length(html) > {MAX_HTML_CHARS} THEN 'INVALID_CONTENT' END AS error_code FROM pages""")
def q_gate_size(spark, sf):
    p = src.pages(spark, sf)
    ok = F.length("html") <= MAX_HTML_CHARS
    return p.select("page_id", ok.alias("accepted"), F.when(~ok, F.lit("INVALID_CONTENT")).alias("error_code"))


@query("html_title", group="pages", oracle=f"""WITH {_TS}
SELECT page_id, coalesce({S.title('clean')}, '') AS title FROM ts""")
def q_html_title(spark, sf):
    return _ts(spark, sf).select("page_id", F.coalesce(H.title(*P.parsed()), F.lit("")).alias("title"))


@query("html_lang", group="pages", oracle=f"""WITH {_TS}
SELECT page_id, {S.html_lang('clean')} AS language FROM ts""")
def q_html_lang(spark, sf):
    return _ts(spark, sf).select("page_id", H.html_lang(*P.parsed()).alias("language"))


_MAIN = f"""WITH {_TS}, mt AS (
    SELECT page_id, CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS text
    FROM (SELECT page_id, {S.main_text(S.strip_boilerplate('clean'))} AS m FROM ts))"""


@query("html_main_text", group="pages", oracle=f"""{_MAIN}
SELECT page_id, text, {ws_count('text')} AS word_count,
       CASE WHEN length(text) > 300 THEN {ws_trim('substr(text, 1, 300)')} || '...' ELSE {ws_trim('text')} END AS excerpt
FROM mt""")
def q_html_main_text(spark, sf):
    t = P.with_main_text(_ts(spark, sf)).select("page_id", "text")
    return t.select("page_id", "text", ws_word_count(F.col("text")).alias("word_count"),
                    excerpt(F.col("text")).alias("excerpt"))


@query("seo_headings", group="pages", oracle=f"""WITH {_TS}, hd AS (
    SELECT page_id, {S.headings('clean', 1)} AS h1, {S.headings('clean', 2)} AS h2 FROM ts)
SELECT page_id, array_to_string(list_slice(h1, 1, 10), ' | ') AS h1_tags, len(list_slice(h1, 1, 10))::BIGINT AS h1_count,
       array_to_string(list_slice(h2, 1, 20), ' | ') AS h2_tags, len(list_slice(h2, 1, 20))::BIGINT AS h2_count
FROM hd""")
def q_seo_headings(spark, sf):
    t = _ts(spark, sf).select("page_id", F.slice(H.headings(*P.parsed(), 1), 1, 10).alias("h1"),
                              F.slice(H.headings(*P.parsed(), 2), 1, 20).alias("h2"))
    return t.select("page_id", F.array_join("h1", " | ").alias("h1_tags"), F.size("h1").cast("long").alias("h1_count"),
                    F.array_join("h2", " | ").alias("h2_tags"), F.size("h2").cast("long").alias("h2_count"))


@query("seo_visible_words", group="pages", oracle=f"""WITH {_TS}
SELECT page_id, {ws_count(S.body_text('clean'))} AS word_count FROM ts""")
def q_seo_visible_words(spark, sf):
    return _ts(spark, sf).select("page_id", ws_word_count(H.body_text(*P.parsed())).alias("word_count"))


# one row per a[href] with its resolved URL
_HREFS = f"""WITH {_TS}, hr AS (
    SELECT page_id, url, unnest(hl) AS href, unnest(range(len(hl))) AS pos
    FROM (SELECT page_id, url, {S.href_list('clean')} AS hl FROM ts)),
  hj AS (SELECT page_id, url, pos, href, {S.join_url('url', 'href')} AS joined FROM hr)"""


@query("url_join", group="urls", oracle=f"""{_HREFS}
SELECT page_id, pos::BIGINT AS pos, href, joined FROM hj""")
def q_url_join(spark, sf):
    t = _ts(spark, sf)
    t = t.select("page_id", F.arrays_zip(P.link_hrefs(*P.parsed()).alias("href"),
                                         U.join_urls(F.col("base"), P.link_hrefs(*P.parsed())).alias("joined")).alias("z"))
    t = t.select("page_id", F.posexplode("z").alias("pos", "hj"))
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("hj.href").alias("href"),
                    F.col("hj.joined").alias("joined"))


@query("link_counts", group="pages", oracle=f"""WITH {_TS}, hr AS (
    SELECT page_id, url, {S.href_list('clean')} AS hl FROM ts)
SELECT page_id,
  len(list_filter(hl, lambda h: {S.netloc(S.join_url('url', 'h'))} = {S.netloc('url')} OR {S.netloc(S.join_url('url', 'h'))} = ''))::BIGINT AS internal_links,
  (len(hl) - len(list_filter(hl, lambda h: {S.netloc(S.join_url('url', 'h'))} = {S.netloc('url')} OR {S.netloc(S.join_url('url', 'h'))} = '')))::BIGINT AS external_links
FROM hr""")
def q_link_counts(spark, sf):
    t = _ts(spark, sf).select("page_id", "base", P.link_netlocs(F.col("base"), P.link_hrefs(*P.parsed())).alias("nl"))
    i, e = P.link_class_counts(F.col("base"), F.col("nl"))
    return t.select("page_id", i.alias("internal_links"), e.alias("external_links"))


@query("html_links", group="pages", oracle=f"""WITH {_TS}, hr AS (
    SELECT page_id, url, list_filter(list_transform({S.href_list('clean')}, lambda h: {S.join_url('url', 'h')}),
                                     lambda u: {S.scheme('u')} IN ('http', 'https')) AS lk FROM ts)
SELECT page_id, array_to_string(list_slice({S.distinct_ordered('lk')}, 1, 100), ' ') AS links,
       len(list_slice({S.distinct_ordered('lk')}, 1, 100))::BIGINT AS n_links FROM hr""")
def q_html_links(spark, sf):
    t = _ts(spark, sf).select("page_id", P.link_urls(F.col("base"), P.link_hrefs(*P.parsed())).alias("lk"))
    return t.select("page_id", F.array_join("lk", " ").alias("links"), F.size("lk").cast("long").alias("n_links"))


@query("link_edges", group="pages", oracle=f"""{_HREFS}
SELECT {S.hostname('url')} AS src_host, {S.hostname('joined')} AS dst_host,
       count(*)::BIGINT AS n_links, count(DISTINCT page_id)::BIGINT AS n_pages
FROM hj WHERE {S.scheme('joined')} IN ('http', 'https') GROUP BY ALL""")
def q_link_edges(spark, sf):
    return P.link_edges(_pages(spark, sf))


_URLS = f"""{_HREFS}, urls AS (SELECT url FROM pages UNION ALL SELECT joined AS url FROM hj)"""


def _all_urls(spark, sf):
    t = _ts(spark, sf)
    links = t.select(F.explode(U.join_urls(F.col("base"), P.link_hrefs(*P.parsed()))).alias("url"))
    return src.pages(spark, sf).select("url").unionByName(links)


@query("url_parts", group="urls", oracle=f"""{_URLS}
SELECT url, count(*)::BIGINT AS n, {S.scheme('url')} AS scheme, {S.netloc('url')} AS netloc, {S.hostname('url')} AS hostname,
       {S.part('url', U.G_PATH)} AS path, {S.part('url', U.G_QUERY)} AS query, {S.part('url', U.G_FRAG)} AS fragment
FROM urls GROUP BY url""")
def q_url_parts(spark, sf):
    u = _all_urls(spark, sf).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("url")
    return u.select("url", "n", U.scheme(c).alias("scheme"), U.netloc(c).alias("netloc"),
                    U.hostname(c).alias("hostname"), U.path(c).alias("path"), U.query(c).alias("query"),
                    U.fragment(c).alias("fragment"))


@query("url_sanitize", group="urls", oracle=f"""{_URLS}
SELECT DISTINCT url, CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END AS log_url
FROM (SELECT url, {S.scheme('url')} || '://' || {S.netloc('url')} || {S.part('url', U.G_PATH)} AS c FROM urls)""")
def q_url_sanitize(spark, sf):
    return _all_urls(spark, sf).select("url", U.sanitize_for_log(F.col("url")).alias("log_url")).distinct()


@query("seo_meta", group="pages", oracle=f"""WITH {_TS}, mt AS (
    SELECT page_id, list_transform(regexp_extract_all(clean, {sq(S.META_RE)}, 0),
        lambda m: {{'name': {S.attr('m', 'name')}, 'property': {S.attr('m', 'property')},
                   'content': {S.attr('m', 'content')}, 'charset': {S.attr('m', 'charset')}}}) AS metas, clean
    FROM ts), fm AS (
    SELECT page_id, clean,
        list_filter(metas, lambda m: regexp_matches(m.name, '(?i)description'))[1] AS d,
        list_filter(metas, lambda m: regexp_matches(m.name, '(?i)robots'))[1] AS r,
        list_filter(metas, lambda m: m.name = 'viewport')[1] AS v,
        list_filter(metas, lambda m: m.charset IS NOT NULL)[1] AS c FROM mt)
SELECT page_id,
    CASE WHEN d IS NOT NULL THEN coalesce(d.content, '') END AS meta_description,
    CASE WHEN r IS NOT NULL THEN coalesce(r.content, '') END AS robots,
    CASE WHEN v IS NOT NULL THEN coalesce(v.content, '') END AS viewport,
    CASE WHEN c IS NOT NULL THEN coalesce(c.charset, '') END AS charset
FROM fm""")
def q_seo_meta(spark, sf):
    s = P.seo_record(_pages(spark, sf))
    return s.select("page_id", "meta_description", "robots", "viewport", "charset")


@query("html_markdown", group="pages", oracle=f"""WITH {_TS}, md AS (
    SELECT page_id, {S.markdown(S.strip_boilerplate('clean'))} AS m FROM ts)
SELECT page_id, CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS markdown,
       length(CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END)::BIGINT AS markdown_chars FROM md""")
def q_html_markdown(spark, sf):
    """Markdown of the content region (a layout of our own)."""
    t = P.with_markdown(_ts(spark, sf)).select("page_id", "markdown")
    return t.select("page_id", "markdown", F.length("markdown").cast("long").alias("markdown_chars"))


# Response header per page for the content-type gate: the page table carries
# none, so a header is derived per row (one in 7 non-HTML, one in 7 missing).
_CT_SQL = ("CASE page_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN '' WHEN 2 THEN 'TEXT/HTML; charset=utf-8' "
           "WHEN 3 THEN 'text/plain' WHEN 4 THEN 'image/png' ELSE 'text/html' END")


@query("gate_content_type", group="pages", oracle=f"""
SELECT page_id, ct AS content_type,
       ct = '' OR contains(lower(ct), 'html') OR contains(lower(ct), 'text') AS accepted
FROM (SELECT page_id, {_CT_SQL} AS ct FROM pages)""")
def q_gate_content_type(spark, sf):
    """Keep a page when its content type is empty or mentions html or text
    (case-insensitive); others are rejected as INVALID_CONTENT upstream."""
    p = src.pages(spark, sf).select("page_id", F.expr(_CT_SQL).alias("content_type"))
    ct = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    ok = (ct == "") | ct.contains("html") | ct.contains("text")
    return p.select("page_id", "content_type", ok.alias("accepted"))
