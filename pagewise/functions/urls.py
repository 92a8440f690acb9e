"""URL scalar functions: split, host, join (relative resolution), sanitise,
and the safety checks that make up a URL verdict.

The split uses the RFC 3986 appendix-B pattern through ``regexp_extract``
(lenient like a scripting-language URL parser; ``parse_url`` rejects URLs
with spaces).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix-B split; the scheme must start with a letter.
URL_RE = r"^(([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
G_SCHEME, G_AUTH, G_NETLOC, G_PATH, G_QMARK, G_QUERY, G_HASH, G_FRAG = 2, 3, 4, 5, 6, 7, 8, 9

# Allowed schemes, always-blocked hosts, blocked networks.
ALLOWED_SCHEMES = ["http", "https"]
BLOCKED_HOSTS = ["metadata.google.internal", "169.254.169.254", "metadata.azure.internal"]
BLOCKED_V4 = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
              "169.254.0.0/16", "0.0.0.0/8"]
BLOCKED_V6 = ["::1/128", "fc00::/7", "fe80::/10"]

# Verdict reason codes, in check order.
LOG_URL_MAX = 200


def _part(url: Column, g: int) -> Column:
    return F.regexp_extract(url, URL_RE, g)


def clean_url(url: Column) -> Column:
    """Strip leading C0 controls and spaces; drop tab/CR/LF anywhere."""
    u = F.regexp_replace(url, F.lit(r"[\t\r\n]"), F.lit(""))
    return F.regexp_replace(u, F.lit(r"^[\x00-\x20]+"), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, G_SCHEME))


def netloc(url: Column) -> Column:
    return _part(url, G_NETLOC)


def path(url: Column) -> Column:
    return _part(url, G_PATH)


def query(url: Column) -> Column:
    return _part(url, G_QUERY)


def fragment(url: Column) -> Column:
    return _part(url, G_FRAG)


def has_query(url: Column) -> Column:
    return _part(url, G_QMARK) != ""


def has_fragment(url: Column) -> Column:
    return _part(url, G_HASH) != ""


def hostname(url: Column) -> Column:
    """Lower-cased host without userinfo and port; IPv6 without brackets."""
    after_at = F.regexp_replace(netloc(url), F.lit(r"^.*@"), F.lit(""))
    return F.lower(F.when(after_at.startswith("["),
                          F.regexp_extract(after_at, r"^\[([^\]]*)\]", 1))
                    .otherwise(F.regexp_extract(after_at, r"^([^:]*)", 1)))


def sanitize_for_log(url: Column) -> Column:
    """scheme://netloc + path; query and fragment dropped; > 200 chars cut + '...'."""
    clean = F.concat(scheme(url), F.lit("://"), netloc(url), path(url))
    return F.when(F.length(clean) > LOG_URL_MAX,
                  F.concat(F.substring(clean, 1, LOG_URL_MAX), F.lit("..."))).otherwise(clean)


def _remove_dot_segments(segments: Column) -> Column:
    """Resolve '.' and '..' over a segment array (a pop on '..', never below empty)."""
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segments, empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc)
                        .otherwise(F.concat(acc, F.array(s))))
    last = F.get(segments, F.size(segments) - 1)
    return F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)


# Separator for the one-pass split of a URL into its parts (a C0 control
# character: never part of a cleaned href or a fetched URL).
_SEP = "\u0001"
_PARTS_TEMPLATE = _SEP.join(f"${g}" for g in (G_SCHEME, G_AUTH, G_NETLOC, G_PATH, G_QMARK, G_QUERY, G_FRAG))


def url_parts(u: Column) -> Column:
    """All split parts of a URL as one struct from ONE regex pass: the URL is
    rewritten to its groups joined by a separator, then split."""
    p = F.split(F.regexp_replace(u, F.lit(URL_RE), F.lit(_PARTS_TEMPLATE)), _SEP, -1)
    return F.struct(
        F.lower(F.get(p, 0)).alias("scheme"), (F.get(p, 1) != "").alias("has_auth"),
        F.get(p, 2).alias("netloc"), F.get(p, 3).alias("path"),
        (F.get(p, 4) != "").alias("has_q"), F.get(p, 5).alias("query"),
        F.get(p, 6).alias("frag"), u.alias("raw"))


def resolve_parts(b: Column, h: Column) -> Column:
    """Resolve reference parts ``h`` against base parts ``b`` (both structs
    from ``url_parts``; ``h`` built from the cleaned href): absolute hrefs
    unchanged; '//host' takes the base scheme; empty href is the base; '?q'
    and '#f' keep the base path; other paths are merged with the base
    directory and dot segments are removed."""
    h_path, b_path = h["path"], b["path"]
    base_dir = F.split(b_path, "/", -1)
    base_dir = F.when(F.get(base_dir, F.size(base_dir) - 1) != "",
                      F.slice(base_dir, 1, F.greatest(F.size(base_dir) - 1, F.lit(0)))).otherwise(base_dir)
    rel_segs = F.concat(base_dir, F.split(h_path, "/", -1))
    n = F.size(rel_segs)
    # drop empty segments strictly between the first and the last
    rel_segs = F.when(n <= 2, rel_segs).otherwise(
        F.concat(F.slice(rel_segs, 1, 1),
                 F.filter(F.slice(rel_segs, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != ""),
                 F.slice(rel_segs, -1, 1)))
    segs = F.when(h_path.startswith("/"), F.split(h_path, "/", -1)).otherwise(rel_segs)
    joined = F.array_join(_remove_dot_segments(segs), "/")
    joined = F.when(joined == "", F.lit("/")).otherwise(joined)
    joined = F.when(joined.startswith("/") | (b["netloc"] == ""), joined).otherwise(F.concat(F.lit("/"), joined))

    q_of = lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))
    f_of = lambda f: F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit(""))
    prefix = F.concat(b["scheme"], F.lit("://"), b["netloc"])
    return (F.when(h["raw"] == "", b["raw"])
             .when((h["scheme"] != "") & ((h["scheme"] != b["scheme"]) | h["has_auth"]), h["raw"])
             .when(h["has_auth"], F.concat(b["scheme"], F.lit(":"), h["raw"]))
             .when(h_path == "", F.concat(prefix, b_path,
                                          q_of(F.when(h["has_q"], h["query"]).otherwise(b["query"])),
                                          f_of(h["frag"])))
             .otherwise(F.concat(prefix, joined, q_of(h["query"]), f_of(h["frag"]))))


def join_url(base: Column, href: Column) -> Column:
    """urljoin(base, href) for one pair (convenience form; for many hrefs per
    row use ``join_urls`` which parses each URL once)."""
    return resolve_parts(url_parts(base), url_parts(clean_url(href)))


def join_urls(base_parts: Column, hrefs: Column) -> Column:
    """Resolve an array of hrefs against a row's base URL. ``base_parts`` must
    be a materialised ``url_parts`` column; each href is cleaned and parsed
    once (nested transforms), then assembled."""
    cleaned = F.transform(hrefs, clean_url)
    parsed = F.transform(cleaned, url_parts)
    return F.transform(parsed, lambda h: resolve_parts(base_parts, h))


def ipv4_to_long(host: Column) -> Column:
    """Dotted-quad literal -> BIGINT, NULL when not an IPv4 literal."""
    ok = host.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    parts = F.split(host, r"\.")
    val = (F.get(parts, 0).cast("long") * 16777216 + F.get(parts, 1).cast("long") * 65536
           + F.get(parts, 2).cast("long") * 256 + F.get(parts, 3).cast("long"))
    return F.when(ok, val)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in net.split("."))
    lo = (a << 24) | (b << 16) | (c << 8) | d
    size = 1 << (32 - int(bits))
    return lo, lo + size - 1


def is_blocked_ipv6(host: Column) -> Column:
    """::1, fc00::/7 (first hextet fc/fd), fe80::/10 (fe8-feb) on an IPv6 literal."""
    h = F.lower(host)
    is_v6 = h.contains(":")
    first = F.lpad(F.split(h, ":").getItem(0), 4, "0")
    loopback = h.rlike(r"^(0{1,4}:){7}0{0,3}1$|^(0{1,4}:){0,6}:0{0,3}1$|^::1$")
    return is_v6 & (loopback | first.rlike(r"^f[cd]") | first.rlike(r"^fe[89ab]"))
