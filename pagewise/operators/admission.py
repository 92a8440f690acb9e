"""Admission: URL safety verdicts, input resolution and validation, error
classification and the success / error envelope.

Every check is a column predicate (blocked networks and configured patterns
are literals of the plan) or a join to a small fixed dimension (error kinds);
per-URL address lists come from a DNS table joined on host, never from a
network call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.functions import urls as U
from pagewise.functions.text import is_blank
from pagewise.operators.scoring import SUMMARY_FORMATS

# Request limits.
MAX_TEXT_CHARS = 50_000
MIN_SUMMARY_WORDS, MAX_SUMMARY_WORDS = 20, 1000

# Error kind -> (http status, code); anything else is
# 500 <STAGE>_FAILED.
ERROR_KINDS = [
    ("invalid_url", 400, "INVALID_URL"),
    ("timeout", 504, "TIMEOUT"),
    ("upstream_status", 502, "UPSTREAM_ERROR"),
    ("connect", 502, "CONNECTION_FAILED"),
    ("invalid_content", 422, "INVALID_CONTENT"),
]
# Endpoint -> stage name used in the generic failure code.
ENDPOINT_STAGE = {"extract": "extraction", "summarize": "summarization", "sentiment": "sentiment",
                  "seo": "seo_extraction", "analyze": "analysis", "compare": "comparison"}


# ------------------------------------------------------------------ URLs

def blocked_networks(ip: Column) -> Column:
    """The blocked IPv4 networks (CIDR names, a fixed list) that hold ``ip``."""
    n = U.ipv4_to_long(ip)
    hits = [F.when(n.between(*U.cidr_bounds(c)), F.lit(c)) for c in U.BLOCKED_V4]
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def pattern_hits(url: Column, patterns: list[str]) -> Column:
    """How many of the configured block patterns (trimmed, empties dropped,
    case ignored) the URL matches; the patterns are literals of the plan."""
    clean = [p.strip() for p in patterns if p and p.strip()]
    return sum((F.when(url.rlike(f"(?i){p}"), 1).otherwise(0) for p in clean), F.lit(0)).cast("long")


def host_addresses(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """(host, ip): an address literal of either family resolves to itself, a
    name to its addresses in ``dns`` (equi-join on host)."""
    literal = U.ipv4_to_long(F.col("host")).isNotNull() | F.col("host").contains(":")
    own = hosts.filter(literal).select("host", F.col("host").alias("ip"))
    return own.unionByName(hosts.filter(~literal).join(dns, "host").select("host", "ip"))


def is_blocked_address(ip: Column) -> Column:
    """A private or reserved address of either family."""
    return (F.size(blocked_networks(ip)) > 0) | U.is_blocked_ipv6(ip)


def url_addresses(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """(host, n_addresses, any_private): every address a host resolves to is checked."""
    return host_addresses(hosts, dns).groupBy("host").agg(
        F.countDistinct("ip").alias("n_addresses"), F.bool_or(is_blocked_address(F.col("ip"))).alias("any_private"))


def url_verdict(urls: DataFrame, dns: DataFrame, patterns: list[str]) -> DataFrame:
    """(url, host, ok, reason): the first failing check wins, in the order
    scheme -> host -> blocked host -> configured pattern -> private address
    -> unresolvable. One projection, and one join of the distinct hosts'
    addresses."""
    u = urls.select("url").distinct().select("url", U.scheme(F.col("url")).alias("scheme"),
                                              U.hostname(F.col("url")).alias("host"),
                                              (pattern_hits(F.col("url"), patterns) > 0).alias("pattern_hit"))
    hosts = u.select("host").filter(F.col("host") != "").distinct()
    j = u.join(url_addresses(hosts, dns), "host", "left")
    reason = (F.when(~F.col("scheme").isin(*U.ALLOWED_SCHEMES), F.lit("INVALID_SCHEME"))
               .when(F.col("host") == "", F.lit("NO_HOST"))
               .when(F.col("host").isin(*U.BLOCKED_HOSTS), F.lit("BLOCKED_HOST"))
               .when(F.col("pattern_hit"), F.lit("BLOCKED_PATTERN"))
               .when(F.coalesce(F.col("any_private"), F.lit(False)), F.lit("PRIVATE_ADDRESS"))
               .when(F.coalesce(F.col("n_addresses"), F.lit(0)) == 0, F.lit("UNRESOLVABLE")))
    return j.select("url", "host", reason.isNull().alias("ok"), reason.alias("reason"))


# ------------------------------------------------------------------ inputs

def resolve_inputs(url_requests: DataFrame, text_requests: DataFrame) -> DataFrame:
    """URL-or-text union without a join: rows with a URL carry the page's
    extracted text (URL wins over text), the others their own ('' when
    missing). Both inputs hold (request_id, url, text) and further columns of
    the same names."""
    return url_requests.unionByName(text_requests).withColumn("text", F.coalesce("text", F.lit("")))


def validation_error(url: Column, text: Column, fmt: Column, max_length: Column) -> Column:
    """Parameter checks done before any work: format, length bounds, text
    size, URL scheme; NULL when valid."""
    return (F.when(~fmt.isin(*SUMMARY_FORMATS), F.lit("VALIDATION_ERROR:format"))
             .when((max_length < MIN_SUMMARY_WORDS) | (max_length > MAX_SUMMARY_WORDS),
                   F.lit("VALIDATION_ERROR:max_length"))
             .when(F.coalesce(F.length(text), F.lit(0)) > MAX_TEXT_CHARS, F.lit("VALIDATION_ERROR:text"))
             .when(url.isNotNull() & ~U.scheme(url).isin(*U.ALLOWED_SCHEMES), F.lit("VALIDATION_ERROR:url")))


def missing_input(url: Column, text: Column) -> Column:
    """Neither a URL nor a non-empty text."""
    return url.isNull() & (F.coalesce(text, F.lit("")) == "")


def no_content(text: Column) -> Column:
    return is_blank(text)


# ------------------------------------------------------------------ errors

def error_kinds(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ERROR_KINDS, "kind STRING, http_status INT, code STRING"))


def classify_errors(outcomes: DataFrame, spark: SparkSession) -> DataFrame:
    """``outcomes``: (..., kind, endpoint) with kind NULL for success.
    Known kinds map through the dimension; other kinds are 500
    <STAGE>_FAILED for the endpoint's stage."""
    stage = F.create_map(*[x for k, v in ENDPOINT_STAGE.items() for x in (F.lit(k), F.lit(v))])
    j = outcomes.join(error_kinds(spark), "kind", "left")
    failed = F.col("kind").isNotNull()
    return j.select(
        *[c for c in outcomes.columns if c != "kind"], "kind",
        F.when(failed, F.coalesce(F.col("http_status"), F.lit(500))).alias("http_status"),
        F.when(failed, F.coalesce(F.col("code"), F.concat(F.upper(stage[F.col("endpoint")]), F.lit("_FAILED"))))
         .alias("error_code"))


def envelope(rows: DataFrame, data_cols: list[str], error_code: Column, message: Column | None = None,
             cached: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(success, data STRUCT, error STRUCT, cached, timestamp) and the columns
    ``keep``: a row with an ``error_code`` becomes an error, any other a success."""
    failed = error_code.isNotNull()
    error = F.struct(error_code.alias("code"), (message if message is not None else F.lit(None).cast("string")).alias("message"))
    return rows.select(
        (~failed).alias("success"), F.when(~failed, F.struct(*data_cols)).alias("data"), F.when(failed, error).alias("error"),
        (F.coalesce(cached, F.lit(False)) & ~failed if cached is not None else F.lit(False)).alias("cached"),
        F.current_timestamp().alias("timestamp"), *(keep or []))
