"""``pages_rich``: the driver's ``pages`` with a generated head block inserted
before ``</head>`` and a body block before ``</article>``, chosen by page_id
modulo rules, so meta / Open Graph / card / canonical / JSON-LD / author /
date / image / link features (absent from the raw pages) are exercised.

The blocks are written once as portable SQL expressions (CASE, %, ||) used
by Spark through ``F.expr`` and by the DuckDB oracle verbatim, so the fixture
is the same in both engines by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.sources import tables as src


def _n(t: str) -> str:
    return f"CAST(page_id AS {t})"


def head_block_sql(t: str = "STRING") -> str:
    n = _n(t)
    desc = (f"CASE WHEN page_id % 5 = 0 THEN '' "
            f"WHEN page_id % 5 = 1 THEN '<meta name=\"description\" content=\"\">' "
            f"WHEN page_id % 3 = 0 THEN '<meta name=description content=About-page-' || {n} || '>' "
            f"WHEN page_id % 2 = 1 THEN '<meta content=\"About page ' || {n} || '\" name=\"description\">' "
            f"ELSE '<meta name=\"description\" content=\"About page ' || {n} || '\">' END")
    tw_desc = f"CASE WHEN page_id % 7 = 3 THEN '<meta name=\"twitter:description\" content=\"Card ' || {n} || '\">' ELSE '' END"
    ld_author = f"'<script type=\"application/ld+json\">{{\"@type\": \"Article\", \"author\": {{\"name\": \"LD Writer ' || {n} || '\"}}}}</script>'"
    author = (f"CASE WHEN page_id % 4 = 0 THEN '<meta name=\"author\" content=\"Writer ' || {n} || '\">' "
              f"WHEN page_id % 4 = 1 THEN '<meta property=\"article:author\" content=\" Writer ' || {n} || ' \">' "
              f"WHEN page_id % 4 = 2 THEN {ld_author} "
              f"ELSE '<meta name=\"author\" content=\" \">' || {ld_author} END")
    date = (f"CASE WHEN page_id % 3 = 0 THEN '<meta property=\"article:published_time\" content=\" 2024-01-' || {n} || ' \">' "
            f"WHEN page_id % 6 = 2 THEN '<meta name=\"Date\" content=\"2024-03-' || {n} || '\">' ELSE '' END")
    og_all = " || ".join(f"'<meta property=\"og:{p}\" content=\" OG {p} ' || {n} || '\">'"
                         for p in ["title", "description", "image", "url", "type", "site_name"])
    og = (f"CASE WHEN page_id % 2 = 0 THEN {og_all} "
          f"WHEN page_id % 8 = 7 THEN '<meta property=\"og:title\" content=\"\">' "
          f"WHEN page_id % 4 = 1 THEN '<meta property=\"og:type\" content=\"website\">' ELSE '' END")
    card_name = " || ".join(f"'<meta name=\"twitter:{c}\" content=\"TC {c} ' || {n} || '\">'"
                            for c in ["card", "title", "description", "image", "site"])
    card_prop = " || ".join(f"'<meta property=\"twitter:{c}\" content=\"TP {c} ' || {n} || '\">'"
                            for c in ["card", "title", "description", "image", "site"])
    card = (f"CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 2 = 0 THEN {card_name} ELSE {card_prop} END")
    canon = (f"CASE WHEN page_id % 3 < 2 THEN '<link rel=\"canonical\" href=\"https://canon.example/' || {n} || '\">' "
             f"WHEN page_id % 2 = 0 THEN '<link rel=\"alternate canonical\" href=\"https://canon.example/alt/' || {n} || '\">' "
             f"ELSE '<link rel=\"alternate\" href=\"https://alt.example/' || {n} || '\">' END")
    ld = (f"CASE WHEN page_id % 5 = 2 THEN '<script type=\"application/ld+json\">[{{\"@type\": \"WebPage\"}}, "
          f"{{\"@type\": \"BreadcrumbList\"}}, 7]</script>' "
          f"WHEN page_id % 5 = 3 THEN '<script type=\"application/ld+json\">{{\"@type\": broken</script>' ELSE '' END "
          f"|| CASE WHEN page_id % 7 = 1 THEN '<script type=\"application/ld+json\">{{\"name\": \"no type\"}}</script>' "
          f"WHEN page_id % 7 = 2 THEN '<script type=\"application/ld+json\">{{\"@type\": [\"Thing\", \"Place\"]}}</script>' "
          f"ELSE '' END")
    robots = "CASE WHEN page_id % 3 = 0 THEN '<meta name=\"robots\" content=\"noindex\">' ELSE '' END"
    viewport = "CASE WHEN page_id % 2 = 0 THEN '<meta name=\"viewport\" content=\"width=device-width\">' ELSE '' END"
    return " || ".join(f"({x})" for x in [tw_desc, desc, author, date, og, card, canon, ld, robots, viewport])


def body_block_sql(t: str = "STRING") -> str:
    n = _n(t)
    h1 = f"CASE WHEN page_id % 6 = 5 THEN '<h1>Second heading ' || {n} || '</h1>' ELSE '' END"
    h2 = (f"CASE WHEN page_id % 4 >= 1 THEN '<h2>Part <b>one</b> of ' || {n} || '</h2>' ELSE '' END "
          f"|| CASE WHEN page_id % 4 >= 2 THEN '<h2>Part two</h2>' ELSE '' END "
          f"|| CASE WHEN page_id % 4 >= 3 THEN '<h2>Part three</h2>' ELSE '' END")
    imgs = (f"CASE WHEN page_id % 5 >= 1 THEN '<img src=\"/img/' || {n} || '-a.png\" alt=\"first\">' ELSE '' END "
            f"|| CASE WHEN page_id % 5 >= 2 THEN '<img src=\"b.png\">' ELSE '' END "
            f"|| CASE WHEN page_id % 5 = 3 THEN '<img src=\"/img/' || {n} || '-a.png\" alt=\"again\">' "
            f"WHEN page_id % 5 = 4 THEN '<img src=\"https://cdn.example/c.png\" alt=\"\"><img src=\"../up.png\">' ELSE '' END")
    links = ("'<a href=\"https://external.example/page\">ext</a><a href=\"mailto:team@example.org\">mail</a>"
             "<a href=\"//proto.example/rel\">proto</a><a href=\"../x\">up</a><a href=\"https://external.example/page\">again</a>'")
    time_tag = f"CASE WHEN page_id % 3 = 1 THEN '<time datetime=\"2024-02-' || {n} || '\">Feb</time>' ELSE '' END"
    return " || ".join(f"({x})" for x in [h1, h2, imgs, links, time_tag])


def pages_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.pages(spark, sf_dir)
    with_blocks = p.select("page_id", "url", "html",
                           F.expr(head_block_sql("STRING")).alias("_head"),
                           F.expr(body_block_sql("STRING")).alias("_body"))
    html = F.regexp_replace(F.col("html"), F.lit("</head>"), F.concat(F.col("_head"), F.lit("</head>")))
    html = F.regexp_replace(html, F.lit("</article>"), F.concat(F.col("_body"), F.lit("</article>")))
    return with_blocks.select("page_id", "url", html.alias("html"))


def pages_rich_sql() -> str:
    """CTE ``pages_rich`` for the oracle."""
    return (f"pages_rich AS (SELECT page_id, url, "
            f"regexp_replace(regexp_replace(html, '</head>', ({head_block_sql('VARCHAR')}) || '</head>'), "
            f"'</article>', ({body_block_sql('VARCHAR')}) || '</article>') AS html FROM pages)")
