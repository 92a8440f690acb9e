"""The six endpoints as table flows: each composes the gates, records and
parsers above over whole tables; errors become a per-row ``error_code``
(the job never fails on a bad row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.functions.text import is_blank
from pagewise.operators import admission as A
from pagewise.operators import analysis as AN
from pagewise.operators import pages as P
from pagewise.operators import scoring as SC
from pagewise.operators.compare import compare_records
from pagewise.plans import sqlhtml as S
from pagewise.plans.q_admission import BLOCK_PATTERNS, _URL_CTES, _dns
from pagewise.plans.q_scoring import _CONF_SQL, _LABEL_SQL
from pagewise.plans.registry import REGISTRY, query
from pagewise.plans.sqlfix import CORPUS, PAIRS
from pagewise.plans.sqlfrag import NONWS, readability_sql, sq, ws_count, ws_trim
from pagewise.session import cut_lineage, spread
from pagewise.sources import tables as src
from pagewise.sources.rich import pages_rich

MAX_HTML_CHARS = 10_000_000

_VERDICT_SQL = f"""{_URL_CTES},
  verdict AS (SELECT u.url, CASE WHEN scheme NOT IN ('http', 'https') OR host = ''
                                   OR host IN ({', '.join(sq(h) for h in A.U.BLOCKED_HOSTS)})
                                   OR b.url IS NOT NULL OR coalesce(a.any_private, false)
                                   OR coalesce(a.n_addresses, 0) = 0 THEN false ELSE true END AS ok
              FROM u LEFT JOIN blocked b USING (url) LEFT JOIN addr a USING (host)),
  gated AS (SELECT p.page_id, p.url, p.html,
                   CASE WHEN NOT coalesce(v.ok, true) THEN 'INVALID_URL'
                        WHEN length(p.html) > {MAX_HTML_CHARS} THEN 'INVALID_CONTENT' END AS error_code
            FROM pages p LEFT JOIN verdict v USING (url))"""


def _page_gates(spark, sf):
    """(page_id, gate): the fetch-stage gates of each page, URL verdict first,
    then size. Neither html nor text takes part in its joins."""
    pages = src.pages(spark, sf).select("page_id", "url", (F.length("html") > MAX_HTML_CHARS).alias("too_long"))
    # Only the page URLs are gated; the resolver table is per host, so the
    # verdict of a page URL does not depend on which other URLs are present.
    urls = src.pages(spark, sf).select("url")
    v = A.url_verdict(urls, _dns(urls), BLOCK_PATTERNS).select("url", "ok")
    g = pages.join(v, "url", "left")
    gate = (F.when(~F.coalesce(F.col("ok"), F.lit(True)), F.lit("INVALID_URL"))
             .when(F.col("too_long"), F.lit("INVALID_CONTENT")))
    return g.select("page_id", gate.alias("gate"))


@query("endpoint_extract", group="endpoints", oracle=f"""{_VERDICT_SQL},
  mt AS (SELECT page_id, error_code,
                {S.title(S.strip_code(S.strip_comments('html')))} AS t0,
                {S.html_lang(S.strip_code(S.strip_comments('html')))} AS language,
                {S.main_text(S.strip_boilerplate(S.strip_code(S.strip_comments('html'))))} AS m FROM gated),
  mt2 AS (SELECT *, CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS text FROM mt),
  rd AS (SELECT * FROM {readability_sql('mt2', 'page_id', 'text', extra='error_code, t0, language, text')})
SELECT page_id, error_code,
       CASE WHEN error_code IS NULL THEN coalesce(t0, '') END AS title,
       CASE WHEN error_code IS NULL THEN {ws_count('text')} END AS word_count,
       CASE WHEN error_code IS NULL THEN CASE WHEN length(text) > 300 THEN {ws_trim('substr(text, 1, 300)')} || '...'
                                              ELSE {ws_trim('text')} END END AS excerpt,
       CASE WHEN error_code IS NULL THEN language END AS language,
       CASE WHEN error_code IS NULL AND {ws_count('text')} >= 20 THEN flesch_reading_ease END AS flesch_reading_ease
FROM rd""")
def q_endpoint_extract(spark, sf):
    fields = ["title", "word_count", "excerpt", "language", "flesch_reading_ease"]
    c = P.content_record(spread(src.pages(spark, sf))).select(
        "page_id", *fields[:-1], F.col("readability.flesch_reading_ease").alias("flesch_reading_ease"))
    ok = F.col("gate").isNull()
    return c.join(_page_gates(spark, sf), "page_id").select(
        "page_id", F.col("gate").alias("error_code"), *[F.when(ok, F.col(x)).alias(x) for x in fields])


@query("endpoint_seo", group="endpoints", oracle=f"""{_VERDICT_SQL},
  sc AS (SELECT page_id, error_code, url, {S.strip_code(S.strip_comments('html'))} AS clean FROM gated),
  shr AS (SELECT *, {S.href_list('clean')} AS hl FROM sc),
  f AS (SELECT page_id, error_code, {S.title('clean')} AS title, len(list_slice({S.headings('clean', 1)}, 1, 10))::BIGINT AS h1_count,
               {ws_count(S.body_text('clean'))} AS word_count,
               len(list_filter(hl, lambda h: {S.netloc(S.join_url('url', 'h'))} <> {S.netloc('url')} AND {S.netloc(S.join_url('url', 'h'))} <> ''))::BIGINT AS external_links,
               len(hl)::BIGINT AS n_links FROM shr)
SELECT page_id, error_code,
       CASE WHEN error_code IS NULL THEN title END AS title,
       CASE WHEN error_code IS NULL THEN h1_count END AS h1_count,
       CASE WHEN error_code IS NULL THEN word_count END AS word_count,
       CASE WHEN error_code IS NULL THEN n_links - external_links END AS internal_links,
       CASE WHEN error_code IS NULL THEN external_links END AS external_links
FROM f""")
def q_endpoint_seo(spark, sf):
    fields = ["title", "h1_count", "word_count", "internal_links", "external_links"]
    s = P.seo_record(spread(src.pages(spark, sf))).withColumn("h1_count", F.size("h1_tags").cast("long"))
    ok = F.col("gate").isNull()
    return s.select("page_id", *fields).join(_page_gates(spark, sf), "page_id").select(
        "page_id", F.col("gate").alias("error_code"), *[F.when(ok, F.col(x)).alias(x) for x in fields])


_FORMATS5 = "['tldr', 'bullets', 'key_takeaways', 'paragraph', 'haiku']"

# Pages by URL (behind the URL and size gates) and documents by text, as one request table.
_MODEL_REQS = f"""{_VERDICT_SQL},
  px AS (SELECT page_id, error_code,
                {S.main_text(S.strip_boilerplate(S.strip_code(S.strip_comments('html'))))} AS m FROM gated),
  mr AS (SELECT 'page:' || page_id AS request_id, page_id AS n, error_code AS gate,
                CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS text FROM px
         UNION ALL SELECT 'doc:' || doc_id, doc_id, CASE WHEN length(text) > 50000 THEN 'VALIDATION_ERROR:text'
                          WHEN coalesce(text, '') = '' THEN 'MISSING_INPUT' END, text FROM documents)"""


def _model_requests(spark, sf, fields):
    """(request_id, n, gate, *fields) of page requests (by URL) and document
    requests (by text); ``fields`` are computed from ``text`` row by row, and the
    page gates join the small result."""
    t = P.with_main_text(P.tag_stage(spread(src.pages(spark, sf))))
    pages = t.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("request_id"),
                     F.col("page_id").alias("n"), "page_id", *fields)
    pages = pages.join(_page_gates(spark, sf), "page_id").drop("page_id")
    gate = (F.when(F.length("text") > A.MAX_TEXT_CHARS, F.lit("VALIDATION_ERROR:text"))
             .when(F.coalesce("text", F.lit("")) == "", F.lit("MISSING_INPUT")))
    docs = spread(src.documents(spark, sf)).select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("request_id"), F.col("doc_id").alias("n"),
        *fields, gate.alias("gate"))
    return pages.unionByName(docs)


@query("endpoint_summarize", group="endpoints", oracle=f"""{_MODEL_REQS},
  e AS (SELECT *, {_FORMATS5}[n % 5 + 1] AS format, (n * 37) % 1100 AS max_length FROM mr),
  f AS (SELECT *, CASE WHEN format NOT IN ('tldr', 'bullets', 'key_takeaways', 'paragraph') THEN 'VALIDATION_ERROR:format'
                       WHEN max_length < 20 OR max_length > 1000 THEN 'VALIDATION_ERROR:max_length'
                       WHEN gate IS NOT NULL THEN gate
                       WHEN NOT regexp_matches(text, {NONWS}) THEN 'NO_CONTENT' END AS error_code FROM e)
SELECT request_id, error_code, format,
       CASE WHEN error_code IS NULL
            THEN {ws_count(ws_trim(f"regexp_extract({ws_trim('substr(text, 1, 50000)')}, {sq(SC.FIRST_SENTENCE_RE)}, 0)"))} END AS summary_words,
       CASE WHEN error_code IS NULL THEN {ws_count('text')} END AS original_words
FROM f""")
def q_endpoint_summarize(spark, sf):
    """Pages by URL and documents by text: gates and validation, then the prompt
    input and the model step on what is valid, then the parsed summary."""
    fmts = A.SUMMARY_FORMATS + ["haiku"]
    raw = SC.standin_raw(F.lit("summary"), F.substring("text", 1, SC.TASK_PARAMS["summary"][0]))
    f = SC.summary_fields(raw, F.col("text"))
    d = _model_requests(spark, sf, [A.no_content(F.col("text")).alias("blank"), f["word_count"].alias("summary_words"),
                                    f["original_word_count"].alias("original_words")])
    d = d.select("*", F.get(F.array(*[F.lit(x) for x in fmts]), (F.col("n") % 5).cast("int")).alias("format"),
                 ((F.col("n") * 37) % 1100).alias("max_length"))
    none = F.lit(None).cast("string")
    err = F.coalesce(A.validation_error(none, none, F.col("format"), F.col("max_length")), F.col("gate"),
                     F.when(F.col("blank"), F.lit("NO_CONTENT")))
    ok = err.isNull()
    return d.select("request_id", err.alias("error_code"), "format",
                    *[F.when(ok, F.col(c)).alias(c) for c in ("summary_words", "original_words")])


@query("endpoint_sentiment", group="endpoints", oracle=f"""{_MODEL_REQS},
  f AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN NOT regexp_matches(text, {NONWS}) THEN 'NO_CONTENT' END AS error_code FROM mr)
SELECT request_id, error_code, CASE WHEN error_code IS NULL THEN {_LABEL_SQL} END AS sentiment,
       CASE WHEN error_code IS NULL THEN {_CONF_SQL} END AS confidence FROM f""")
def q_endpoint_sentiment(spark, sf):
    raw = SC.standin_raw(F.lit("sentiment"), F.substring("text", 1, SC.TASK_PARAMS["sentiment"][0]))
    d = _model_requests(spark, sf, [is_blank(F.col("text")).alias("blank"), raw.alias("raw")])
    err = F.coalesce("gate", F.when(F.col("blank"), F.lit("NO_CONTENT")))
    f = SC.sentiment_fields(F.col("raw"))
    return d.select("request_id", err.alias("error_code"), *[F.when(err.isNull(), f[c]).alias(c) for c in
                                                             ("sentiment", "confidence")])


def _analyze_oracle() -> str:
    from pagewise.plans import q_rich
    long_words = "list_filter(regexp_extract_all(substr(text, 1, 8000), '[a-zA-Z]+'), lambda w: length(w) > 3)"
    first = f"regexp_extract({ws_trim('substr(text, 1, 50000)')}, {sq(SC.FIRST_SENTENCE_RE)}, 0)"
    return f"""
SELECT page_id, g.url, e AS error_code, m.word_count, q.total_score, q.grade,
       CASE WHEN e IS NULL THEN m.summary_words END AS summary_words, CASE WHEN e IS NULL THEN m.sentiment END AS sentiment,
       CASE WHEN e IS NULL THEN 'other' END AS category, CASE WHEN e IS NULL THEN m.n_keywords END AS n_keywords
FROM (SELECT g.*, m.blank, coalesce(g.error_code, CASE WHEN m.blank THEN 'NO_CONTENT' END) AS e
      FROM ({_VERDICT_SQL} SELECT page_id, url, error_code FROM gated) g
      JOIN (WITH {q_rich._MT_RICH} SELECT page_id, NOT regexp_matches(text, {NONWS}) AS blank FROM mt) m USING (page_id)) g
JOIN ({REGISTRY['quality_rich'].oracle}) q USING (page_id)
JOIN (WITH {q_rich._MT_RICH} SELECT page_id, {ws_count('text')} AS word_count, {ws_count(ws_trim(first))} AS summary_words,
             {_LABEL_SQL} AS sentiment, least(10, len(list_distinct({long_words})))::BIGINT AS n_keywords FROM mt) m USING (page_id)"""


@query("endpoint_analyze", group="endpoints", oracle=_analyze_oracle())
def q_endpoint_analyze(spark, sf):
    """pages_rich -> content + SEO + quality score and the three model tasks
    (stand-in columns) in one pass over the pages; then the page gates, joined to
    the small records, and the no-content guard."""
    def raw(task: str):
        return SC.standin_raw(F.lit(task), F.substring("text", 1, SC.TASK_PARAMS[task][0]))
    k = SC.keyword_fields(raw("keywords"))
    fields = [is_blank(F.col("text")).alias("blank"),
              SC.summary_fields(raw("summary"), F.lit(""))["word_count"].alias("summary_words"),
              SC.sentiment_fields(raw("sentiment"))["sentiment"].alias("sentiment"),
              k["category"].alias("category"), F.size(k["keywords"]).cast("long").alias("n_keywords")]
    q = AN.page_quality(spread(pages_rich(spark, sf)), fields).select(
        "page_id", "url", "word_count", "total_score", "grade", "blank", "summary_words", "sentiment", "category", "n_keywords")
    err = F.coalesce("gate", F.when(F.col("blank"), F.lit("NO_CONTENT")))
    return q.join(_page_gates(spark, sf), "page_id").select(
        "page_id", "url", err.alias("error_code"), "word_count", "total_score", "grade",
        *[F.when(err.isNull(), F.col(c)).alias(c) for c in ("summary_words", "sentiment", "category", "n_keywords")])


def _page_texts(spark, sf):
    ts = P.with_main_text(P.tag_stage(spread(src.pages(spark, sf))))
    return ts.select(F.col("page_id").alias("text_id"), "text")


def _page_pairs(spark, sf):
    p = src.pages(spark, sf).select("page_id")
    a, b = p.alias("a"), p.alias("b")
    pairs = (a.filter(F.col("a.page_id") % 2 == 0).join(b, F.col("b.page_id") == F.col("a.page_id") + 1)
              .select(F.col("a.page_id").alias("left_id"), F.col("b.page_id").alias("right_id")))
    return pairs.select(F.concat_ws(":", F.lit("pages"), "left_id", "right_id").alias("pair_id"),
                        F.lit("pages").alias("kind"), "left_id", "right_id")


_PAGE_CORPUS = f"""corpus AS (SELECT page_id AS text_id, CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS text
    FROM (SELECT page_id, {S.main_text(S.strip_boilerplate(S.strip_code(S.strip_comments('html'))))} AS m FROM pages))"""
_PAGE_PAIRS = """pairs AS (SELECT concat_ws(':', 'pages', a.page_id, b.page_id) AS pair_id, 'pages' AS kind,
                              a.page_id AS left_id, b.page_id AS right_id
                       FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0)"""


_COMPARED = ["similarity_score", "shared_keywords", "unique_to_text1", "unique_to_text2", "word_count_diff",
             "flesch_reading_ease_diff", "grade_level_diff", "text1_reading_level", "text2_reading_level"]


def _compare_oracle() -> str:
    from pagewise.plans import q_terms  # noqa: F401 — registers compare_record
    base = REGISTRY["compare_record"].oracle
    head = f"WITH {CORPUS}, {PAIRS},"
    assert base.startswith(head)
    compared = f"WITH {_PAGE_CORPUS}, {_PAGE_PAIRS}," + base[len(head):]
    kept = ", ".join(f"CASE WHEN a.error_code IS NULL AND b.error_code IS NULL THEN c.{x} END AS {x}" for x in _COMPARED)
    return f"""{_VERDICT_SQL}, c AS ({compared})
SELECT c.pair_id, c.left_id, c.right_id, coalesce(a.error_code, b.error_code, c.error_code) AS error_code, {kept}
FROM c JOIN gated a ON a.page_id = c.left_id JOIN gated b ON b.page_id = c.right_id"""


@query("endpoint_compare", group="endpoints", oracle=_compare_oracle())
def q_endpoint_compare(spark, sf):
    """The gates of both pages come first (the first page's before the second's);
    a pair that does not pass has no result."""
    # the main texts are read by the measure of their size, the terms and the profile
    texts = cut_lineage(_page_texts(spark, sf), "page_texts")
    c = compare_records(_page_pairs(spark, sf), texts)
    gates = _page_gates(spark, sf)
    c = c.join(gates.select(F.col("page_id").alias("left_id"), F.col("gate").alias("gate_1")), "left_id")
    c = c.join(gates.select(F.col("page_id").alias("right_id"), F.col("gate").alias("gate_2")), "right_id")
    lists = ("shared_keywords", "unique_to_text1", "unique_to_text2")
    open_ = F.col("gate_1").isNull() & F.col("gate_2").isNull()
    return c.select("pair_id", "left_id", "right_id", F.coalesce("gate_1", "gate_2", "error_code").alias("error_code"),
                    *[F.when(open_, F.array_join(x, ",") if x in lists else F.col(x)).alias(x) for x in _COMPARED])
