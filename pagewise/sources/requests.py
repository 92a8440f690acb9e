"""Request-log view of ``events`` and the small fixed dimensions (tiers,
endpoint mapping). All derived row-locally — no global aggregate is needed
to build them, so they stream as well as they batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.sources import tables as src

# Caller -> tier (index = caller), event type -> endpoint.
CALLER_TIERS = ["free", "starter", "pro", "business", "enterprise", "free", "gold"]
EVENT_ENDPOINT = {"signup": "extract", "view": "seo", "click": "summarize",
                  "error": "analyze", "purchase": "compare"}
N_CALLERS = len(CALLER_TIERS)

# Pricing tiers (name, monthly price, calls/month, calls/minute,
# endpoints, overage per call). None = "custom" / "unlimited" / hard limit.
PAID_ENDPOINTS = ["extract", "summarize", "sentiment", "seo", "analyze"]
TIERS = [
    ("free", "Basic (Free)", 0.0, 100, 5, ["extract"], None),
    ("starter", "Starter", 9.99, 2500, 10, PAID_ENDPOINTS, 0.005),
    ("pro", "Pro", 29.99, 15000, 30, PAID_ENDPOINTS, 0.003),
    ("business", "Business", 99.99, 75000, 60, PAID_ENDPOINTS, 0.002),
    ("enterprise", "Enterprise", None, None, None, PAID_ENDPOINTS, None),
]
DEFAULT_TIER = "free"
# Test scaling: monthly limits divided by this so the small logs trip them.
SCALE_DIVISOR = 50

TIER_SCHEMA = T.StructType([
    T.StructField("tier", T.StringType()), T.StructField("tier_name", T.StringType()),
    T.StructField("price_monthly", T.DoubleType()), T.StructField("calls_per_month", T.LongType()),
    T.StructField("rate_per_minute", T.LongType()), T.StructField("endpoints", T.ArrayType(T.StringType())),
    T.StructField("overage_price", T.DoubleType()),
])


def tiers(spark: SparkSession, scaled: bool = False) -> DataFrame:
    """Tier dimension (5 rows, fixed size — safe to broadcast)."""
    rows = [(t, n, p, (c // SCALE_DIVISOR if scaled and c is not None else c), r, e, o)
            for t, n, p, c, r, e, o in TIERS]
    return F.broadcast(spark.createDataFrame(rows, TIER_SCHEMA))


def endpoint_of(event_type: Column) -> Column:
    m = F.create_map(*[x for k, v in EVENT_ENDPOINT.items() for x in (F.lit(k), F.lit(v))])
    return m[event_type]


def tier_of_caller(caller: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in CALLER_TIERS]), caller.cast("int"))


def month_compressed(ts: Column, factor: int = 60) -> Column:
    """Compress time ``factor``x towards the start of the row's month."""
    ms = F.date_trunc("month", ts)
    us = F.unix_micros(ms) + F.floor((F.unix_micros(ts) - F.unix_micros(ms)) / factor).cast("long")
    return F.timestamp_micros(us)


def requests(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """(request_id, ts, caller, tier, endpoint, status, latency_ms, url, url2).

    ``dense``: caller = user_id and time compressed 60x within the month, so
    per-minute limits and 30-minute sessions are reached."""
    return requests_from_events(src.events(spark, sf_dir), dense)


def requests_from_events(ev: DataFrame, dense: bool = False) -> DataFrame:
    """Row-local derivation; works on batch and streaming ``events`` alike."""
    caller = F.col("user_id") if dense else (F.col("user_id") % N_CALLERS)
    ts = month_compressed(F.col("ts")) if dense else F.col("ts")
    tier = F.coalesce(tier_of_caller(F.col("user_id") % N_CALLERS), F.lit(DEFAULT_TIER))
    return ev.select(
        F.col("event_id").alias("request_id"), ts.alias("ts"), caller.alias("caller"), tier.alias("tier"),
        endpoint_of(F.col("event_type")).alias("endpoint"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), 500).otherwise(200).alias("status"),
        (F.col("value") * 10).alias("latency_ms"),
        F.concat(F.lit("https://h"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com/"),
                 (F.col("event_id") % 50).cast("string")).alias("url"),
        F.concat(F.lit("https://h"), ((F.col("user_id") + 1) % 20).cast("string"), F.lit(".example.com/"),
                 (F.col("event_id") % 50).cast("string")).alias("url2"),
    )
