"""Queries over ``pages_rich`` (pages with generated meta / OG / card /
JSON-LD / author / date / image / link blocks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.operators import analysis as AN
from pagewise.operators import pages as P
from pagewise.plans import sqlhtml as S
from pagewise.plans.registry import query
from pagewise.plans.sqlfrag import sq, ws_trim
from pagewise.session import spread
from pagewise.sources.rich import pages_rich, pages_rich_sql

EMPTY = "''"
_R = pages_rich_sql()
_TSR = f"""{_R}, ts AS (SELECT page_id, url, nc, {S.strip_code('nc')} AS clean
               FROM (SELECT page_id, url, {S.strip_comments('html')} AS nc FROM pages_rich)),
  tm AS (SELECT *, {S.meta_list('clean')} AS metas, regexp_extract_all(nc, {sq(S.LD_JSON_RE)}, 1) AS ld FROM ts)"""


def _rich(spark, sf):
    return spread(pages_rich(spark, sf))


def _first_meta(pred: str) -> str:
    return f"list_filter(metas, lambda m: {pred})[1]"


def _stripped_or_null(x: str) -> str:
    return f"nullif({ws_trim(f'coalesce({x}, {EMPTY})')}, '')"


_LD_DECIDED = ("list_filter(ld, lambda s: CASE WHEN json_valid(s) THEN json_type(s) = 'OBJECT' "
               "AND coalesce(json_type(s, '$.author') IN ('OBJECT', 'VARCHAR'), false) ELSE false END)[1]")


@query("html_author", group="rich", oracle=f"""WITH {_TSR}, a AS (
    SELECT page_id, {_first_meta("regexp_matches(m.name, '(?i)author')")} AS m1,
           {_first_meta("regexp_matches(m.property, '(?i)article:author')")} AS m2, {_LD_DECIDED} AS d FROM tm)
SELECT page_id, CASE WHEN m1 IS NOT NULL THEN {_stripped_or_null('m1.content')}
                     WHEN m2 IS NOT NULL THEN {_stripped_or_null('m2.content')}
                     WHEN json_type(d, '$.author') = 'VARCHAR' THEN json_extract_string(d, '$.author')
                     ELSE json_extract_string(d, '$.author.name') END AS author FROM a""")
def q_html_author(spark, sf):
    return P.content_record(_rich(spark, sf)).select("page_id", "author")


@query("html_date", group="rich", oracle=f"""WITH {_TSR}, a AS (
    SELECT page_id, {_first_meta("regexp_matches(m.property, '(?i)article:published_time')")} AS m1,
           list_filter(regexp_extract_all(clean, {sq(S.TIME_TAG_RE)}, 0), lambda t: {S.attr_present('t', 'datetime')})[1] AS t0,
           {_first_meta("regexp_matches(m.name, '(?i)^date$')")} AS m3 FROM tm)
SELECT page_id, CASE WHEN m1 IS NOT NULL THEN {_stripped_or_null('m1.content')}
                     WHEN t0 IS NOT NULL THEN {S.attr('t0', 'datetime')}
                     WHEN m3 IS NOT NULL THEN {_stripped_or_null('m3.content')} END AS published_date FROM a""")
def q_html_date(spark, sf):
    return P.content_record(_rich(spark, sf)).select("page_id", "published_date")


def _og(p: str) -> str:
    m = _first_meta(f"m.property = 'og:{p}'")
    return f"CASE WHEN {m} IS NOT NULL THEN {ws_trim(f'coalesce(({m}).content, {EMPTY})')} END AS og_{p}"


@query("seo_open_graph", group="rich", oracle=f"""WITH {_TSR}
SELECT page_id, {', '.join(_og(p) for p in P.OG_FIELDS)} FROM tm""")
def q_seo_open_graph(spark, sf):
    s = P.seo_record(_rich(spark, sf))
    return s.select("page_id", *[F.col(f"open_graph.og_{p}").alias(f"og_{p}") for p in P.OG_FIELDS])


def _tc(c: str) -> str:
    by_name = _first_meta(f"m.name = 'twitter:{c}'")
    by_prop = _first_meta(f"m.property = 'twitter:{c}'")
    m = f"coalesce({by_name}, {by_prop})"
    return f"CASE WHEN {m} IS NOT NULL THEN {ws_trim(f'coalesce(({m}).content, {EMPTY})')} END AS {c}"


@query("seo_twitter", group="rich", oracle=f"""WITH {_TSR}
SELECT page_id, {', '.join(_tc(c) for c in P.CARD_FIELDS)} FROM tm""")
def q_seo_twitter(spark, sf):
    s = P.seo_record(_rich(spark, sf))
    return s.select("page_id", *[F.col(f"twitter_card.{c}").alias(c) for c in P.CARD_FIELDS])


_ITEMS = ("flatten(list_transform(ld, lambda s: CASE WHEN NOT json_valid(s) THEN []::JSON[] "
          "WHEN json_type(s) = 'OBJECT' THEN [s::JSON] "
          "WHEN json_type(s) = 'ARRAY' THEN list_filter(json_extract(s, '$[*]'), lambda x: json_type(x) = 'OBJECT') "
          "ELSE []::JSON[] END))")
_TYPE = ("list_transform(items, lambda x: CASE WHEN json_type(x, '$.\"@type\"') IS NULL THEN 'Unknown' "
         "WHEN json_type(x, '$.\"@type\"') = 'VARCHAR' THEN json_extract_string(x, '$.\"@type\"') "
         "ELSE json_extract(x, '$.\"@type\"')::VARCHAR END)")


@query("seo_jsonld", group="rich", oracle=f"""WITH {_TSR}, it AS (SELECT page_id, {_ITEMS} AS items FROM tm)
SELECT page_id, array_to_string({_TYPE}, '|') AS types, len(items)::BIGINT AS n_types,
       len(list_slice(items, 1, 10))::BIGINT AS n_data FROM it""")
def q_seo_jsonld(spark, sf):
    s = P.seo_record(_rich(spark, sf))
    return s.select("page_id", F.array_join("schema_markup.types", "|").alias("types"),
                    F.size("schema_markup.types").cast("long").alias("n_types"),
                    F.size("schema_markup.data").cast("long").alias("n_data"))


@query("seo_meta_rich", group="rich", oracle=f"""WITH {_TSR}, fm AS (
    SELECT page_id, clean, {_first_meta("regexp_matches(m.name, '(?i)description')")} AS d,
           {_first_meta("regexp_matches(m.name, '(?i)robots')")} AS r, {_first_meta("m.name = 'viewport'")} AS v,
           {_first_meta("m.charset IS NOT NULL")} AS c FROM tm)
SELECT page_id, CASE WHEN d IS NOT NULL THEN coalesce(d.content, '') END AS meta_description,
       {S.canonical('clean')} AS canonical_url,
       CASE WHEN r IS NOT NULL THEN coalesce(r.content, '') END AS robots,
       CASE WHEN v IS NOT NULL THEN coalesce(v.content, '') END AS viewport,
       CASE WHEN c IS NOT NULL THEN coalesce(c.charset, '') END AS charset FROM fm""")
def q_seo_meta_rich(spark, sf):
    return P.seo_record(_rich(spark, sf)).select("page_id", "meta_description", "canonical_url", "robots",
                                                 "viewport", "charset")


_IMGS = f"""im AS (SELECT page_id, url, list_transform(list_filter(regexp_extract_all(clean, {sq(S.IMG_TAG_RE)}, 0),
                lambda t: {S.attr_present('t', 'src')}), lambda t: coalesce({S.attr('t', 'src')}, '')) AS srcs,
              regexp_extract_all(clean, {sq(S.IMG_TAG_RE)}, 0) AS imgs FROM ts),
  ij AS (SELECT page_id, imgs, list_transform(srcs, lambda h: {S.join_url('url', 'h')}) AS lk FROM im)"""


@query("html_images", group="rich", oracle=f"""WITH {_TSR}, {_IMGS}
SELECT page_id, array_to_string(list_slice({S.distinct_ordered('lk')}, 1, 50), ' ') AS images,
       len(list_slice({S.distinct_ordered('lk')}, 1, 50))::BIGINT AS n_images FROM ij""")
def q_html_images(spark, sf):
    c = P.content_record(_rich(spark, sf), include_images=True)
    return c.select("page_id", F.array_join("images", " ").alias("images"), F.size("images").cast("long").alias("n_images"))


@query("image_alt_audit", group="rich", oracle=f"""WITH {_TSR}, {_IMGS}
SELECT page_id, len(imgs)::BIGINT AS total_images,
       len(list_filter(imgs, lambda t: coalesce({S.attr('t', 'alt')}, '') = ''))::BIGINT AS images_without_alt FROM ij""")
def q_image_alt_audit(spark, sf):
    return P.seo_record(_rich(spark, sf)).select("page_id", "total_images", "images_without_alt")


@query("seo_headings_rich", group="rich", oracle=f"""WITH {_TSR}
SELECT page_id, array_to_string(list_slice({S.headings('clean', 1)}, 1, 10), ' | ') AS h1_tags,
       array_to_string(list_slice({S.headings('clean', 2)}, 1, 20), ' | ') AS h2_tags FROM ts""")
def q_seo_headings_rich(spark, sf):
    s = P.seo_record(_rich(spark, sf))
    return s.select("page_id", F.array_join("h1_tags", " | ").alias("h1_tags"),
                    F.array_join("h2_tags", " | ").alias("h2_tags"))


@query("link_counts_rich", group="rich", oracle=f"""WITH {_TSR}, hr AS (SELECT page_id, url, {S.href_list('clean')} AS hl FROM ts)
SELECT page_id,
  len(list_filter(hl, lambda h: {S.netloc(S.join_url('url', 'h'))} = {S.netloc('url')} OR {S.netloc(S.join_url('url', 'h'))} = ''))::BIGINT AS internal_links,
  (len(hl) - len(list_filter(hl, lambda h: {S.netloc(S.join_url('url', 'h'))} = {S.netloc('url')} OR {S.netloc(S.join_url('url', 'h'))} = '')))::BIGINT AS external_links
FROM hr""")
def q_link_counts_rich(spark, sf):
    return P.seo_record(_rich(spark, sf)).select("page_id", "internal_links", "external_links")


_QR = S.quality_sql()


@query("quality_rich", group="rich", oracle=f"""WITH {_R}, {S.quality_inputs_sql('pages_rich')}
SELECT page_id, ({_QR['total']})::BIGINT AS total_score, {_QR['grade']} AS grade,
       array_to_string({_QR['recs']}, ',') AS recommendations,
       has_meta_description, has_canonical, has_open_graph, has_schema_markup,
       total_images::BIGINT AS total_images, images_without_alt::BIGINT AS images_without_alt FROM qi""")
def q_quality_rich(spark, sf):
    q = AN.page_quality(_rich(spark, sf))
    return q.select("page_id", "total_score", "grade", F.array_join("recommendations", ",").alias("recommendations"),
                    "has_meta_description", "has_canonical", "has_open_graph", "has_schema_markup",
                    F.col("total_images").cast("long").alias("total_images"),
                    F.col("images_without_alt").cast("long").alias("images_without_alt"))


def _sub(name: str) -> str:
    from pagewise.plans.registry import REGISTRY
    return f"({REGISTRY[name].oracle})"


_MT_RICH = f"""{_R}, ts AS (SELECT page_id, url, {S.strip_code(S.strip_comments('html'))} AS clean FROM pages_rich),
  mt0 AS (SELECT page_id, clean, {S.main_text(S.strip_boilerplate('clean'))} AS m FROM ts),
  mt AS (SELECT page_id, clean, CASE WHEN length(m) > 50000 THEN substr(m, 1, 50000) || '...' ELSE m END AS text FROM mt0)"""


def _content_oracle() -> str:
    from pagewise.plans.sqlfrag import readability_sql, ws_count
    return f"""WITH {_MT_RICH},
  rd AS (SELECT * FROM {readability_sql('mt', 'page_id', 'text', extra='clean, text')}),
  base AS (SELECT page_id, coalesce({S.title('clean')}, '') AS title, {S.html_lang('clean')} AS language,
                  {ws_count('text')} AS word_count,
                  CASE WHEN length(text) > 300 THEN {ws_trim('substr(text, 1, 300)')} || '...' ELSE {ws_trim('text')} END AS excerpt,
                  CASE WHEN {ws_count('text')} >= 20 THEN flesch_reading_ease END AS flesch_reading_ease,
                  CASE WHEN {ws_count('text')} >= 20 THEN avg_grade_level END AS avg_grade_level FROM rd)
SELECT b.page_id, b.title, a.author, d.published_date, b.word_count, b.excerpt, b.language,
       i.n_images, b.flesch_reading_ease, b.avg_grade_level
FROM base b JOIN {_sub('html_author')} a USING (page_id) JOIN {_sub('html_date')} d USING (page_id)
     JOIN {_sub('html_images')} i USING (page_id)"""


@query("content_record", group="rich", oracle=_content_oracle())
def q_content_record(spark, sf):
    c = P.content_record(_rich(spark, sf), include_images=True)
    return c.select("page_id", "title", "author", "published_date", "word_count", "excerpt", "language",
                    F.size("images").cast("long").alias("n_images"),
                    F.col("readability.flesch_reading_ease").alias("flesch_reading_ease"),
                    F.col("readability.avg_grade_level").alias("avg_grade_level"))


def _seo_oracle() -> str:
    from pagewise.plans.sqlfrag import ws_count
    return f"""WITH {_R}, ts AS (SELECT page_id, {S.strip_code(S.strip_comments('html'))} AS clean FROM pages_rich),
  base AS (SELECT page_id, {S.title('clean')} AS title, {S.html_lang('clean')} AS language,
                  {ws_count(S.body_text('clean'))} AS word_count FROM ts)
SELECT b.page_id, b.title, m.meta_description, m.canonical_url, h.h1_tags, h.h2_tags, o.og_title, o.og_type,
       t.card, t.site, j.types AS schema_types, m.robots, m.viewport, m.charset, b.language, b.word_count,
       l.internal_links, l.external_links, i.images_without_alt, i.total_images
FROM base b JOIN {_sub('seo_meta_rich')} m USING (page_id) JOIN {_sub('seo_headings_rich')} h USING (page_id)
     JOIN {_sub('seo_open_graph')} o USING (page_id) JOIN {_sub('seo_twitter')} t USING (page_id)
     JOIN {_sub('seo_jsonld')} j USING (page_id) JOIN {_sub('link_counts_rich')} l USING (page_id)
     JOIN {_sub('image_alt_audit')} i USING (page_id)"""


@query("seo_record", group="rich", oracle=_seo_oracle())
def q_seo_record(spark, sf):
    s = P.seo_record(_rich(spark, sf))
    return s.select("page_id", "title", "meta_description", "canonical_url",
                    F.array_join("h1_tags", " | ").alias("h1_tags"), F.array_join("h2_tags", " | ").alias("h2_tags"),
                    F.col("open_graph.og_title").alias("og_title"), F.col("open_graph.og_type").alias("og_type"),
                    F.col("twitter_card.card").alias("card"), F.col("twitter_card.site").alias("site"),
                    F.array_join("schema_markup.types", "|").alias("schema_types"), "robots", "viewport", "charset",
                    "language", "word_count", "internal_links", "external_links", "images_without_alt", "total_images")
