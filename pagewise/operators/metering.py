"""Request keys, result reuse, usage metering, quotas, rate limits, billing and
request-log metrics over a request log.

Scale notes: one caller may own a third of the log. Counts and sums use
partial (map-side) aggregation; the per-caller running count used for quota
ordinals is computed in two phases (per caller-month-minute ranks plus a prefix
sum over the small per-minute count table) so no single task sorts a hot
caller's whole month; exact latency percentiles come from a mergeable sketch
that brackets each rank and an exact count of what lies in the bracket, a small
share of the rows; the result cache is scanned in pieces of a digest's requests,
whose effects on the cache are composed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.functions.text import round_half_even
from pagewise.session import cut_lineage
from pagewise.sources.requests import DEFAULT_TIER, TIERS

KEY_NAMESPACE = "pw"
TTL_SECONDS = 3600
# Defaults of the request options that enter a key.
DEFAULT_FORMAT, DEFAULT_MAX_LENGTH, DEFAULT_LANGUAGE = "tldr", 200, "en"
QUANTILES = [0.5, 0.95, 0.99]
KNOWN_TIERS = [t[0] for t in TIERS]


def key_data(endpoint: Column, url: Column, url2: Column) -> Column:
    """Per-endpoint key material (request options at their defaults)."""
    return (F.when(endpoint == "extract", F.concat_ws(":", url, F.lit("False"), F.lit("False"), F.lit("text")))
             .when(endpoint == "summarize", F.concat_ws(":", url, F.lit(DEFAULT_FORMAT),
                                                         F.lit(str(DEFAULT_MAX_LENGTH)), F.lit(DEFAULT_LANGUAGE)))
             .when(endpoint == "analyze", F.concat_ws(":", url, F.lit(DEFAULT_FORMAT), F.lit(str(DEFAULT_MAX_LENGTH))))
             .when(endpoint == "compare", F.concat_ws("|", url, url2))
             .otherwise(url))


def text_key_data(endpoint: Column, text: Column, fmt: Column | None = None, max_length: Column | None = None,
                  language: Column | None = None) -> Column:
    """Key material of a request that carries its text: the whole text takes the
    place of the URL (requests that differ anywhere in it have different keys)."""
    source = F.coalesce(text, F.lit(""))
    fmt = F.lit(DEFAULT_FORMAT) if fmt is None else fmt
    max_length = F.lit(str(DEFAULT_MAX_LENGTH)) if max_length is None else max_length.cast("string")
    language = F.lit(DEFAULT_LANGUAGE) if language is None else language
    return F.when(endpoint == "summarize", F.concat_ws(":", source, fmt, max_length, language)).otherwise(source)


def request_key(endpoint: Column, data: Column) -> Column:
    return F.concat(F.lit(KEY_NAMESPACE + ":"), endpoint, F.lit(":"), F.substring(F.sha2(data, 256), 1, 16))


def with_request_key(req: DataFrame) -> DataFrame:
    """Adds ``request_digest`` (the full digest, on which results are matched)
    and ``request_key``, its short form for display."""
    data = key_data(F.col("endpoint"), F.col("url"), F.col("url2"))
    return (req.withColumn("request_key", request_key(F.col("endpoint"), data))
            .withColumn("request_digest", F.concat(F.col("endpoint"), F.lit(":"), F.sha2(data, 256))))


def identity(user: Column, address: Column) -> Column:
    """Who a request counts for: the named subscriber, else the client address."""
    return F.coalesce(F.nullif(user.cast("string"), F.lit("")), address)


def effective_tier(tier: Column) -> Column:
    """Unknown tiers fall back to the free tier."""
    return F.when(tier.isin(*KNOWN_TIERS), tier).otherwise(F.lit(DEFAULT_TIER))


def with_tier(req: DataFrame, tiers: DataFrame) -> DataFrame:
    """Broadcast join to the (fixed-size) tier dimension."""
    r = req.withColumn("tier", effective_tier(F.col("tier")))
    return r.join(F.broadcast(tiers), "tier", "inner")


def entitlement_violations(req: DataFrame, tiers: DataFrame) -> DataFrame:
    r = with_tier(req, tiers).filter(~F.array_contains(F.col("endpoints"), F.col("endpoint")))
    return r.groupBy("caller", "tier", "endpoint").agg(F.count(F.lit(1)).alias("n_requests"))


def usage_monthly(req: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per caller and calendar month: used, limit, remaining (floor 0), bounds."""
    r = req.withColumn("tier", effective_tier(F.col("tier")))
    used = (r.groupBy("caller", "tier", F.date_trunc("month", "ts").alias("period_start"))
             .agg(F.count(F.lit(1)).alias("calls_used")))
    u = used.join(F.broadcast(tiers.select("tier", "calls_per_month", "price_monthly", "overage_price")), "tier")
    return u.select(
        "caller", "tier", "period_start",
        (F.col("period_start") + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 1 SECOND")).alias("period_end"),
        "calls_used", F.col("calls_per_month").alias("calls_limit"),
        F.when(F.col("calls_per_month").isNotNull(),
               F.greatest(F.col("calls_per_month") - F.col("calls_used"), F.lit(0))).alias("calls_remaining"),
        "price_monthly", "overage_price")


def billing(usage: DataFrame) -> DataFrame:
    """price + max(used - limit, 0) * overage (no overage price = hard limit,
    no charge; a 'custom' price stays NULL)."""
    over = F.greatest(F.col("calls_used") - F.coalesce(F.col("calls_limit"), F.col("calls_used")), F.lit(0))
    return usage.select(
        "caller", "tier", "period_start", "calls_used", "calls_limit",
        over.cast("long").alias("over_quota_calls"),
        round_half_even(F.col("price_monthly") + over * F.coalesce(F.col("overage_price"), F.lit(0.0)), 4)
        .alias("amount_due"))


def running_ordinal(df: DataFrame, part: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``ordinal`` = 1-based position of each row within ``part`` ordered by
    ``order``; ``bucket`` must be monotone in the order (e.g. the hour of ts).

    Phase 1 ranks rows within (part, bucket) — a hot ``part`` is split across
    buckets. Phase 2 prefix-sums the per-bucket counts (one row per bucket)."""
    d = df.withColumn("_bucket", bucket)
    local = d.withColumn("_local", F.row_number().over(
        Window.partitionBy(*part, "_bucket").orderBy(*order)))
    # bucket sizes by a map-side-combined count (the input is read twice, both
    # times column-pruned; cheaper than materialising the whole ranked log)
    counts = d.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (local.join(offsets, [*part, "_bucket"])
                 .withColumn("ordinal", (F.col("_offset") + F.col("_local")).cast("long"))
                 .drop("_bucket", "_local", "_offset"))


def quota_ordinal(req: DataFrame, tiers: DataFrame) -> DataFrame:
    """nth call of the caller in the month; within quota or not; the action
    past the quota: blocked (no overage price) or billed as overage."""
    r = with_tier(req, tiers).withColumn("period_start", F.date_trunc("month", "ts"))
    o = running_ordinal(r, ["caller", "period_start"], ["ts", "request_id"], F.date_trunc("minute", "ts"))
    in_q = F.col("calls_per_month").isNull() | (F.col("ordinal") <= F.col("calls_per_month"))
    return o.select("request_id", "caller", "tier", "period_start", "ordinal",
                    F.col("calls_per_month").alias("calls_limit"), in_q.alias("in_quota"),
                    F.when(in_q, F.lit("ok")).when(F.col("overage_price").isNull(), F.lit("blocked"))
                     .otherwise(F.lit("overage")).alias("action"))


def rate_violations(req: DataFrame, tiers: DataFrame, window: str = "1 minute") -> DataFrame:
    r = with_tier(req, tiers)
    per_min = (r.groupBy("caller", "tier", "rate_per_minute", F.window("ts", window).alias("w"))
                .agg(F.count(F.lit(1)).alias("n_calls")))
    return per_min.filter(F.col("rate_per_minute").isNotNull() & (F.col("n_calls") > F.col("rate_per_minute"))) \
                  .select("caller", "tier", F.col("w.start").alias("window_start"), "n_calls",
                          F.col("rate_per_minute").alias("rate_limit"))


def request_metrics(req: DataFrame) -> DataFrame:
    """Count, error share and mean latency by endpoint and tier with CUBE totals."""
    r = req.withColumn("tier", effective_tier(F.col("tier")))
    is_err = (F.col("status") >= 500).cast("long")
    return (r.cube("endpoint", "tier")
             .agg(F.count(F.lit(1)).alias("n_requests"), F.sum(is_err).alias("n_errors"),
                  round_half_even(F.sum(is_err) / F.count(F.lit(1)), 4).alias("error_share"),
                  round_half_even(F.avg("latency_ms"), 4).alias("avg_latency_ms")))


SKETCH_ACCURACY = 20_000  # the sketch's ranks are off by a share of 1 / SKETCH_ACCURACY at most


def latency_percentiles(req: DataFrame, group: str = "endpoint", value: str = "latency_ms") -> DataFrame:
    """Exact p50 / p95 / p99 (linear interpolation) per group, in three shuffles
    of small tables.

    A quantile sketch per group, merged from the tasks' sketches, gives for each
    quantile two values that its ranks lie between: the sketch is asked for ranks
    further away than its error bound. The second pass counts the rows below the
    bracket and, value by value, those in it (about ``4 / SKETCH_ACCURACY`` of
    the rows), so every task passes one row on for what lies below. Running
    counts over the bracket find both neighbours of the quantile's position.
    Null values are counted as requests and have no rank."""
    asked = []
    for q in QUANTILES:
        asked += [max(0.0, q - 2 / SKETCH_ACCURACY), min(1.0, q + 2 / SKETCH_ACCURACY)]
    sketch = req.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count(value).alias("n"),
        F.percentile_approx(value, asked, SKETCH_ACCURACY).alias("at"), F.min(value).alias("least"), F.max(value).alias("most"))
    brackets = F.array(*[F.struct(
        F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("pos"),
        # with few rows a rank or two is more than the margin
        F.when(F.col("n") < SKETCH_ACCURACY, F.col("least")).otherwise(F.get("at", 2 * i)).alias("low"),
        F.when(F.col("n") < SKETCH_ACCURACY, F.col("most")).otherwise(F.get("at", 2 * i + 1)).alias("high"))
        for i, q in enumerate(QUANTILES)])
    sketch = sketch.select(F.col(group).alias("_g"), "n_requests", "n", F.explode(brackets).alias("b"))
    sketch = sketch.select("_g", "n_requests", "n", "b.i", "b.pos", "b.low", "b.high")
    sketch = cut_lineage(sketch, "quantile_brackets")
    rows = req.select(F.col(group).alias("_k"), F.col(value).alias("v")).join(sketch, F.col("_k").eqNullSafe(F.col("_g")))
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))  # NULL: below the bracket
    counted = (rows.where((F.col("v") <= F.col("high")) | (F.col("n") == 0))
               .groupBy("_g", "n_requests", "i", "pos", inside.alias("v")).agg(F.count("v").alias("cnt")))
    running = Window.partitionBy("_g", "n_requests", "i").orderBy(F.asc_nulls_first("v")).rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = counted.repartition("_g", "n_requests").withColumn("cum", F.sum("cnt").over(running))

    def at(i: int) -> Column:
        """Value at the quantile's position: between those of the ranks on both sides."""
        here = (F.col("i") == i) & F.col("v").isNotNull()
        low, high = (F.min(F.when(here & (F.col("cum") > k), F.col("v"))) for k in (F.floor("pos"), F.ceil("pos")))
        pos = F.max(F.when(F.col("i") == i, F.col("pos")))
        return round_half_even(low + (pos - F.floor(pos)) * (high - low), 4)
    return ranked.groupBy("_g", "n_requests").agg(
        *[at(i).alias(f"p{int(round(q * 100))}_latency_ms") for i, q in enumerate(QUANTILES)]).withColumnRenamed("_g", group)


def incremental_reuse(req: DataFrame, prior: DataFrame) -> DataFrame:
    """Serve a stored result when the request's digest was computed strictly
    before it, else compute: every request with ``cached``."""
    stored = prior.groupBy("request_digest").agg(F.min("computed_at").alias("computed_at"))
    j = req.join(stored, "request_digest", "left")
    return j.withColumn("cached", F.coalesce(F.col("computed_at") < F.col("ts"), F.lit(False))).drop("computed_at")


def prior_results(req: DataFrame) -> DataFrame:
    """Stored results: every third digest, computed when it was first requested."""
    third = F.conv(F.substring(F.md5("request_digest"), 1, 6), 16, 10).cast("long") % 3 == 0
    return req.where(third).groupBy("request_digest", "endpoint").agg(F.min("ts").alias("computed_at"))


SERVED = ["request_id", "request_key", "ts", "endpoint"]
_PIECE_DDL = ("kind string, request_digest string, part int, entry long, exit long, request_id long, request_key string, "
              "ts timestamp, endpoint string, served_from timestamp, cached boolean")


def _misses(at: np.ndarray, start: int, ttl: int) -> np.ndarray:
    """Times at which a result is computed: ``start``, then the first request a lifetime or more later, and so on."""
    out, k = [start], int(np.searchsorted(at, start + ttl))
    while k < len(at):
        out.append(int(at[k]))
        k = int(np.searchsorted(at, out[-1] + ttl))
    return np.array(out)


def _exits(at: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """What a piece of a digest's requests (ascending times) does to the cache: for
    every time that can be the first miss in it, the last miss in it. Only
    requests within a lifetime of the first one, and the next one after, can."""
    at = np.unique(at)
    after = np.searchsorted(at, at + ttl)
    last = np.where(after < len(at), after, np.arange(len(at)))
    while True:  # pointer doubling
        further = last[last]
        if (further == last).all():
            break
        last = further
    entries = min(len(at), int(after[0]) + 1)
    return at[:entries], at[last[:entries]]


def _served(at: np.ndarray, misses: np.ndarray) -> np.ndarray:
    """Time of the result that serves each request (masked: the request is a miss itself)."""
    k = np.searchsorted(misses, at, "right") - 1
    from_ = misses[np.maximum(k, 0)]
    return np.ma.masked_array(from_, (k < 0) | (from_ >= at))


def _with_served(rows: pa.Table, served: np.ndarray, kind: str, part: int) -> pa.RecordBatch:
    n = rows.num_rows
    from_ = pa.array(served.data.astype(np.int64), mask=np.ma.getmaskarray(served))
    columns = [pa.array([kind] * n), rows["request_digest"], pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.int64()),
               pa.nulls(n, pa.int64()), *[rows[c] for c in SERVED], from_.cast(rows.schema.field("ts").type), from_.is_valid()]
    names = ["kind", "request_digest", "part", "entry", "exit", *SERVED, "served_from", "cached"]
    return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches(max_chunksize=n or 1)


def _digests(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one ``key``, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(key)
        if not len(keys):
            continue
        codes = keys.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0] != keys[x]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def ttl_reuse(req: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Result cache with a lifetime: a request is served from the stored result
    of its digest if that was computed strictly earlier and less than
    ``ttl_seconds`` ago (``served_from`` is when); else it is computed and its
    result is stored.

    Which request computes depends on the one that computed before it. Requests
    are range-partitioned by digest and time, so a digest with very many of them
    lies in pieces in many tasks. A task finishes the digests that it holds from
    their first request on; of the piece that it begins with, which may go on
    from the partition before, it tells what the piece does to the cache for
    every possible first miss. These functions are composed along each digest;
    that gives the first miss of every piece, from which its requests are served."""
    ttl = ttl_seconds * 1_000_000
    cols = ["request_digest", *SERVED]
    order = ["request_digest", "ts", "request_id"]
    rows = req.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, t in enumerate(_digests(batches, "request_digest")):
            at = t["ts"].cast(pa.int64()).to_numpy()
            misses = _misses(at, int(at[0]), ttl)
            if k:
                yield from _with_served(t, _served(at, misses), "row", part)
                entries, exits = at[:1], misses[-1:]  # it may go on in the next partition
            else:
                yield from _with_served(t, np.ma.masked_all(len(at), np.int64), "pending", part)
                entries, exits = _exits(at, ttl)
            n = len(entries)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["piece"] * n), pa.array([t["request_digest"][0].as_py()] * n, pa.string()),
                 pa.array(np.full(n, part, np.int32)), pa.array(entries), pa.array(exits), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.string()), pa.nulls(n, t.schema.field("ts").type), pa.nulls(n, pa.string()),
                 pa.nulls(n, t.schema.field("ts").type), pa.nulls(n, pa.bool_())],
                ["kind", "request_digest", "part", "entry", "exit", *SERVED, "served_from", "cached"])

    done = cut_lineage(rows.mapInArrow(scan, _PIECE_DDL), "reuse", partition_by=("kind",))
    open_ = done.where("kind = 'pending'").select("request_digest", "part").distinct()  # no more rows than partitions
    pieces = done.where("kind = 'piece'").select("request_digest", "part", "entry", "exit")
    pieces = pieces.join(F.broadcast(open_.select("request_digest").distinct()), "request_digest", "left_semi")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, part, free, chosen = None, None, None, True
        for b in batches:
            out = []
            for d, p, entry, exit_ in zip(*[b.column(c).to_pylist() for c in ("request_digest", "part", "entry", "exit")],
                                          strict=True):
                if d != digest:
                    digest, part, free = d, None, None  # free: from when on a request is a miss
                if p != part:
                    part, chosen = p, False
                if not chosen and (free is None or entry >= free):
                    chosen = True
                    out.append((d, p, entry))
                    free = exit_ + ttl
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()),
                     pa.array([x[2] for x in out], pa.int64())], ["request_digest", "part", "start"])
    starts = (pieces.repartition("request_digest").sortWithinPartitions("request_digest", "part", "entry")
              .mapInArrow(compose, "request_digest string, part int, start long"))
    # where a piece holds no miss, its requests are served from the last miss before it
    state = starts.join(pieces.select("request_digest", "part", F.col("entry").alias("start"), "exit"),
                        ["request_digest", "part", "start"])
    before = Window.partitionBy("request_digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    state = open_.join(state, ["request_digest", "part"], "full").withColumn("held", F.max("exit").over(before))
    # one row for each piece that a partition begins or ends with
    pending = done.where("kind = 'pending'").join(F.broadcast(state.drop("exit", "entry")), ["request_digest", "part"], "left")
    pending = pending.select("part", *cols, "start", "held").repartition("part").sortWithinPartitions("part", "ts", "request_id")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _digests(batches, "part"):
            at = t["ts"].cast(pa.int64()).to_numpy()
            start, held = t["start"][0].as_py(), t["held"][0].as_py()
            misses = _misses(at, start, ttl) if start is not None else np.zeros(0, np.int64)
            if held is not None:
                misses = np.append(np.int64(held), misses)
            yield from _with_served(t, _served(at, misses), "row", t["part"][0].as_py())
    keep = [*SERVED, "served_from", "cached"]
    return done.where("kind = 'row'").select(*keep).unionByName(pending.mapInArrow(serve, _PIECE_DDL).select(*keep))
