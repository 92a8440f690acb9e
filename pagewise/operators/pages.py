"""Page records: content extraction, SEO metadata, link edges.

``tag_stage`` scans ``pages`` once and keeps only (page_id, url) plus the
cleaned HTML strings; every record is then one projection over it, so the
HTML is parsed once no matter how many fields are asked for. Nothing here
shuffles: all work is per row, partitioned like the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import html as H
from pagewise.functions import urls as U
from pagewise.functions.readability import readability_struct, with_text_stats
from pagewise.functions.text import excerpt, truncate_text, ws_word_count

MAX_CONTENT_CHARS = 50_000
READABILITY_MIN_WORDS = 20
AUTHOR_META_RE = "(?i)author"
AUTHOR_PROP_RE = "(?i)article:author"
DATE_PROP_RE = "(?i)article:published_time"
DATE_NAME_RE = "(?i)^date$"

OG_FIELDS = ["title", "description", "image", "url", "type", "site_name"]
CARD_FIELDS = ["card", "title", "description", "image", "site"]


def tag_stage(pages: DataFrame) -> DataFrame:
    """(page_id, url, nc = html without comments, toks = tokens of nc without
    scripts/styles, names = their tag names, base = the page URL parsed once)."""
    # a JSON-LD object with a repeated key is read as JSON readers do: the last value counts
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    s1 = pages.select("page_id", "url", H.strip_comments(F.col("html")).alias("nc"))
    s2 = s1.select("page_id", "url", "nc", H.tokens(H.strip_code(F.col("nc"))).alias("toks"),
                   U.url_parts(F.col("url")).alias("base"))
    return s2.withColumn("names", H.token_names(F.col("toks")))


def parsed() -> tuple[Column, Column]:
    """The columns of the tag stage that the HTML functions take."""
    return F.col("toks"), F.col("names")


def without_boilerplate(df: DataFrame, toks: str, names: str, p: str = "_wb_") -> DataFrame:
    """``toks`` and ``names`` without the boilerplate elements and what is in them."""
    for name in H.BOILERPLATE:
        df = df.withColumn(f"{p}out", H.outer_elements(F.col(names), name))
        df = df.withColumns({c: H.without(F.col(c), F.col(f"{p}out")) for c in (toks, names)}).drop(f"{p}out")
    return df


def with_region(df: DataFrame, p: str) -> DataFrame:
    """Add ``{p}toks``, ``{p}names`` (the page without boilerplate) and ``{p}in``,
    the bounds of its content region, in staged projections: every intermediate is an
    attribute, so nothing is evaluated twice per row."""
    d = df.withColumns({f"{p}toks": F.col("toks"), f"{p}names": F.col("names")})
    d = without_boilerplate(d, f"{p}toks", f"{p}names", p)
    d = d.withColumn(f"{p}at", H.region_start(F.col(f"{p}toks"), F.col(f"{p}names")))
    return d.withColumn(f"{p}in", H.region_bounds(F.col(f"{p}names"), F.col(f"{p}at"))).drop(f"{p}at")


def in_region(c: str, p: str) -> Column:
    return F.slice(F.col(f"{p}{c}"), F.col(f"{p}in.a") + 1, F.greatest(F.col(f"{p}in.b") - F.col(f"{p}in.a"), F.lit(0)))


def with_main_text(df: DataFrame, out: str = "text", limit: int | None = MAX_CONTENT_CHARS, p: str = "_mt_") -> DataFrame:
    """Add the main-content text as ``out``: boilerplate removed -> paragraphs of
    the first content region -> text (else all body text) -> truncation."""
    d = with_region(df, p)
    d = d.withColumns({f"{p}rt": in_region("toks", p), f"{p}rn": in_region("names", p)})
    d = d.withColumn(f"{p}paras", F.array_join(H.paragraphs(F.col(f"{p}rt"), F.col(f"{p}rn")), "\n\n"))
    paras = F.col(f"{p}paras")
    d = d.withColumn(f"{p}full", F.when(paras != "", paras).otherwise(
        H.body_text(F.col(f"{p}toks"), F.col(f"{p}names"))))
    full = F.col(f"{p}full")
    d = d.withColumn(out, truncate_text(full, limit) if limit else full)
    return d.drop(*[f"{p}{c}" for c in ("toks", "names", "in", "rt", "rn", "paras", "full")])


def with_markdown(df: DataFrame, out: str = "markdown", p: str = "_md_") -> DataFrame:
    """Add the markdown of the content region as ``out``."""
    d = with_region(df, p)
    d = d.withColumns({f"{p}rt": in_region("toks", p), f"{p}rn": in_region("names", p)})
    d = d.withColumn(out, truncate_text(H.markdown(F.col(f"{p}rt"), F.col(f"{p}rn")), MAX_CONTENT_CHARS))
    return d.drop(*[f"{p}{c}" for c in ("toks", "names", "in", "rt", "rn")])


# ---------------------------------------------------------------- metadata

def author(metas: Column, ld: Column) -> Column:
    m1 = H.meta_lookup(metas, lambda m: m["name"].rlike(AUTHOR_META_RE))
    m2 = H.meta_lookup(metas, lambda m: m["property"].rlike(AUTHOR_PROP_RE))
    # JSON-LD: the first top-level object whose author is an object (-> its
    # name, possibly NULL) or a string decides.
    parsed = F.transform(ld, lambda s: F.try_parse_json(s))
    decided = F.filter(parsed, lambda v: F.schema_of_variant(v).startswith("OBJECT")
                       & (F.schema_of_variant(F.try_variant_get(v, "$.author", "variant")).startswith("OBJECT")
                          | (F.schema_of_variant(F.try_variant_get(v, "$.author", "variant")) == "STRING")))
    v0 = H.first(decided)
    from_ld = F.when(F.schema_of_variant(F.try_variant_get(v0, "$.author", "variant")) == "STRING",
                     F.try_variant_get(v0, "$.author", "string")) \
               .otherwise(F.try_variant_get(v0, "$.author.name", "string"))
    return (F.when(m1.isNotNull(), H.stripped_or_null(F.coalesce(m1["content"], F.lit(""))))
             .when(m2.isNotNull(), H.stripped_or_null(F.coalesce(m2["content"], F.lit(""))))
             .otherwise(from_ld))


def published_date(metas: Column, toks: Column, names: Column) -> Column:
    m1 = H.meta_lookup(metas, lambda m: m["property"].rlike(DATE_PROP_RE))
    times = F.filter(H.tags(toks, names, "time"), lambda t: H.attr_present(t, "datetime"))
    t0 = H.first(times)
    m3 = H.meta_lookup(metas, lambda m: m["name"].rlike(DATE_NAME_RE))
    return (F.when(m1.isNotNull(), H.stripped_or_null(F.coalesce(m1["content"], F.lit(""))))
             .when(t0.isNotNull(), H.attr(t0, "datetime"))
             .when(m3.isNotNull(), H.stripped_or_null(F.coalesce(m3["content"], F.lit("")))))


def open_graph(metas: Column) -> Column:
    def og(p: str) -> Column:
        m = H.meta_lookup(metas, lambda x: x["property"] == f"og:{p}")
        return F.when(m.isNotNull(), H.ws_trim(F.coalesce(m["content"], F.lit("")))).alias(f"og_{p}")
    return F.struct(*[og(p) for p in OG_FIELDS])


def twitter_card(metas: Column) -> Column:
    def tc(n: str) -> Column:
        by_name = H.meta_lookup(metas, lambda x: x["name"] == f"twitter:{n}")
        by_prop = H.meta_lookup(metas, lambda x: x["property"] == f"twitter:{n}")
        m = F.coalesce(by_name, by_prop)
        return F.when(m.isNotNull(), H.ws_trim(F.coalesce(m["content"], F.lit("")))).alias(n)
    return F.struct(*[tc(n) for n in CARD_FIELDS])


def schema_items(ld: Column) -> Column:
    """JSON-LD items: an object script gives itself, an array script gives its
    object elements; unparsable scripts are skipped; no @graph descent."""
    parsed = F.transform(ld, lambda s: F.try_parse_json(s))
    per_script = F.transform(parsed, lambda v: F.when(
        F.schema_of_variant(v).startswith("OBJECT"), F.array(v)).otherwise(
        F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")),
                 lambda x: F.schema_of_variant(x).startswith("OBJECT"))))
    return F.flatten(per_script)


def schema_type(item: Column) -> Column:
    t = F.try_variant_get(item, '$["@type"]', "variant")
    return (F.when(t.isNull(), F.lit("Unknown"))
             .when(F.schema_of_variant(t) == "STRING", F.try_variant_get(item, '$["@type"]', "string"))
             .otherwise(F.to_json(t)))


def schema_markup(ld: Column) -> Column:
    items = schema_items(ld)
    return F.struct(F.transform(items, schema_type).alias("types"),
                    F.transform(F.slice(items, 1, H.MAX_SCHEMA_ITEMS), lambda x: F.to_json(x)).alias("data"))


# ---------------------------------------------------------------- links / images

def link_hrefs(toks: Column, names: Column) -> Column:
    hrefs = F.transform(H.tags(toks, names, "a"), lambda t: H.attr(t, "href"))
    return F.filter(hrefs, lambda h: h.isNotNull())


def img_tags(toks: Column, names: Column) -> Column:
    return H.tags(toks, names, "img")


def image_urls(base: Column, imgs: Column) -> Column:
    """Resolved img[src] URLs, order-preserving de-duplication, first 50."""
    srcs = F.filter(F.transform(imgs, lambda t: H.attr(t, "src")), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(U.join_urls(base, srcs)), 1, H.MAX_IMAGES)


def link_urls(base: Column, hrefs: Column) -> Column:
    """Resolved a[href] URLs with a web scheme, de-duplicated, first 100."""
    web = F.filter(U.join_urls(base, hrefs), lambda u: U.scheme(u).isin(*U.ALLOWED_SCHEMES))
    return F.slice(F.array_distinct(web), 1, H.MAX_LINKS)


def link_netlocs(base: Column, hrefs: Column) -> Column:
    """netloc of every resolved a[href] (materialise before counting)."""
    return F.transform(U.join_urls(base, hrefs), U.netloc)


def link_class_counts(base: Column, netlocs: Column) -> tuple[Column, Column]:
    """(internal, external) over all a[href] (not de-duplicated): internal when
    the resolved netloc equals the page's netloc or is empty. ``netlocs`` is a
    materialised ``link_netlocs`` column."""
    external = F.size(F.filter(netlocs, lambda n: (n != base["netloc"]) & (n != ""))).cast("long")
    return (F.size(netlocs).cast("long") - external), external


# ---------------------------------------------------------------- records

def content_record(pages: DataFrame, include_images: bool = False, include_links: bool = False,
                   output_format: str = "text") -> DataFrame:
    """Content record per page (flat columns; readability as a STRUCT that is
    NULL under 20 whitespace words). Optional outputs are only computed when
    requested — column pruning drops the work otherwise."""
    ts = with_main_text(tag_stage(pages))
    if output_format == "markdown":
        ts = with_markdown(ts)
    else:
        ts = ts.withColumn("markdown", F.lit(None).cast("string"))
    s2 = ts.select("page_id", "url", "toks", "names", "nc", "base", "text", "markdown",
                   H.meta_structs(*parsed()).alias("metas"))
    cols = [
        "page_id", "url",
        F.coalesce(H.title(*parsed()), F.lit("")).alias("title"),
        author(F.col("metas"), H.ld_json_scripts(F.col("nc"))).alias("author"),
        published_date(F.col("metas"), *parsed()).alias("published_date"),
        "text",
        ws_word_count(F.col("text")).alias("word_count"),
        excerpt(F.col("text")).alias("excerpt"),
        H.html_lang(*parsed()).alias("language"),
        "markdown",
    ]
    empty = F.array().cast("array<string>")
    cols.append(image_urls(F.col("base"), img_tags(*parsed())).alias("images") if include_images
                else empty.alias("images"))
    cols.append(link_urls(F.col("base"), link_hrefs(*parsed())).alias("links") if include_links
                else empty.alias("links"))
    s3 = s2.select(*cols)
    staged = with_text_stats(s3, "text")
    keep = [c for c in s3.columns]
    return staged.select(*keep, F.when(F.col("word_count") >= READABILITY_MIN_WORDS,
                                       readability_struct()).alias("readability"))


def seo_record(pages: DataFrame) -> DataFrame:
    """SEO record per page (nested structs for OG / card / schema)."""
    ts = tag_stage(pages)
    s2 = ts.select("page_id", "url", "toks", "names", "base",
                   H.meta_structs(*parsed()).alias("metas"),
                   H.ld_json_scripts(F.col("nc")).alias("ld"),
                   link_netlocs(F.col("base"), link_hrefs(*parsed())).alias("netlocs"),
                   img_tags(*parsed()).alias("imgs"))
    metas = F.col("metas")
    desc = H.meta_lookup(metas, lambda m: m["name"].rlike("(?i)description"))
    robots = H.meta_lookup(metas, lambda m: m["name"].rlike("(?i)robots"))
    viewport = H.meta_lookup(metas, lambda m: m["name"] == "viewport")
    charset = H.meta_lookup(metas, lambda m: m["charset"].isNotNull())
    internal, external = link_class_counts(F.col("base"), F.col("netlocs"))
    no_alt = F.size(F.filter(F.col("imgs"), lambda t: F.coalesce(H.attr(t, "alt"), F.lit("")) == "")).cast("long")
    return s2.select(
        "page_id", "url",
        H.title(*parsed()).alias("title"),
        H.meta_content(desc).alias("meta_description"),
        H.canonical(*parsed()).alias("canonical_url"),
        F.slice(H.headings(*parsed(), 1), 1, H.MAX_H1).alias("h1_tags"),
        F.slice(H.headings(*parsed(), 2), 1, H.MAX_H2).alias("h2_tags"),
        open_graph(metas).alias("open_graph"),
        twitter_card(metas).alias("twitter_card"),
        schema_markup(F.col("ld")).alias("schema_markup"),
        H.meta_content(robots).alias("robots"),
        H.meta_content(viewport).alias("viewport"),
        F.when(charset.isNotNull(), F.coalesce(charset["charset"], F.lit(""))).alias("charset"),
        H.html_lang(*parsed()).alias("language"),
        ws_word_count(H.body_text(*parsed())).alias("word_count"),
        internal.alias("internal_links"), external.alias("external_links"),
        no_alt.alias("images_without_alt"),
        F.size("imgs").cast("long").alias("total_images"),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Host-level link graph: (src_host, dst_host, n_links, n_pages) over every
    resolved a[href] with a web scheme. A page's target hosts are sorted within its
    row, so that the first link to each of them is known and both counts are sums:
    one shuffle, combined map-side."""
    ts = tag_stage(pages)
    web = F.filter(U.join_urls(F.col("base"), link_hrefs(*parsed())), lambda u: U.scheme(u).isin(*U.ALLOWED_SCHEMES))
    e = ts.select(U.hostname(F.col("url")).alias("src_host"), web.alias("web"))
    e = e.select("src_host", F.array_sort(F.transform("web", U.hostname)).alias("hosts"))
    told = H.bind(F.col("hosts"), lambda hs: F.transform(hs, lambda h, i: F.struct(
        h.alias("dst_host"), (~F.coalesce(F.get(hs, i - 1) == h, F.lit(False))).cast("long").alias("first"))))
    return (e.select("src_host", F.inline(told)).groupBy("src_host", "dst_host")
             .agg(F.count(F.lit(1)).alias("n_links"), F.sum("first").alias("n_pages")))
