"""Stored results and envelope files.

Both are Parquet (or JSON) folders partitioned by date and something bounded,
written with dynamic partition overwrite: a batch writes only partitions that
carry its own name, so a batch that is run again replaces its rows and touches
nobody else's.

``serve`` is incremental computing over a result store: a request whose digest
has a result that is fresh at its time is served from the store; the others are
computed, once for each digest, and stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.operators.metering import TTL_SECONDS

BUCKETS = 16  # of the digest, within a day
STORE_COLUMNS = ["request_digest", "computed_at", "result"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _bucket(digest: str = "request_digest"):
    return F.pmod(F.xxhash64(digest), F.lit(BUCKETS)).cast("int")


def put(results: DataFrame, path: str, batch: str) -> None:
    """Store ``STORE_COLUMNS`` of a batch by (day, bucket, batch)."""
    rows = results.select(*STORE_COLUMNS, F.to_date("computed_at").alias("day"), _bucket().alias("bucket"),
                          F.lit(batch).alias("batch"))
    (rows.repartition("day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "bucket", "batch").parquet(path))


def stored(spark: SparkSession, path: str, since=None, until=None, but: str | None = None) -> DataFrame:
    """The rows of a store, of the days from ``since`` to ``until`` only (other
    folders are not listed or read), without those of batch ``but``."""
    schema = "request_digest string, computed_at timestamp, result string, day date, bucket int, batch string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    if since is not None:
        rows = rows.where(F.col("day").between(F.lit(since), F.lit(until)))
    return rows if but is None else rows.where(F.col("batch") != but)


def serve(requests: DataFrame, path: str, batch: str, compute: Callable[[DataFrame], DataFrame],
          ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``requests`` with ``result``, ``computed_at`` and ``cached``.

    ``requests`` holds ``request_digest``, ``ts`` and what ``compute`` reads;
    ``compute`` gets one row for each digest and lifetime that no stored result
    covers (that of the earliest such request) and returns it with a column
    ``result``. Those results are stored under ``batch``; a second run of the
    batch finds the store as the first one did, computes the same and replaces
    its rows. A request is served by the latest result computed at or before its
    time and less than ``ttl_seconds`` ago; requests of one lifetime window of a
    digest in the batch share one computation. Rows with a null digest or time
    have no result."""
    spark = requests.sparkSession
    first, last = requests.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return requests.withColumns({"result": F.lit(None).cast("string"), "computed_at": F.lit(None).cast("timestamp"),
                                     "cached": F.lit(False)})
    since = spark.range(1).select(F.to_date(F.lit(first) - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))).first()[0]
    life = F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    # a digest has few results that are fresh at some time of the batch: one list a digest, met in one equi-join
    known = stored(spark, path, since, last.date(), batch).where(F.col("computed_at") > F.lit(first) - life)
    known = known.groupBy("request_digest").agg(F.collect_set(F.struct("computed_at", "result")).alias("known"))
    asked = requests.withColumn("_slice", F.floor(F.unix_micros("ts") / F.lit(ttl_seconds * 1_000_000)))
    met = asked.join(known, "request_digest", "left")
    fresh = F.array_max(F.filter("known", lambda k: (k["computed_at"] <= F.col("ts")) & (k["computed_at"] + life > F.col("ts"))))
    met = met.withColumn("_hit", fresh).drop("known")
    misses = met.where("_hit IS NULL AND request_digest IS NOT NULL AND ts IS NOT NULL").drop("_hit")
    one = misses.groupBy("request_digest", "_slice").agg(F.min_by(F.struct(*requests.columns), "ts").alias("r"))
    done = compute(one.select("_slice", "r.*")).select("request_digest", "_slice", F.col("ts").alias("_at"), F.col("result").alias("_made"))
    put(done.select("request_digest", F.col("_at").alias("computed_at"), F.col("_made").alias("result")), path, batch)
    mine = spark.read.parquet(path).where(F.col("batch") == batch).select(
        "request_digest", F.col("computed_at").alias("_at"), F.col("result").alias("_made"),
        F.floor(F.unix_micros("computed_at") / F.lit(ttl_seconds * 1_000_000)).alias("_slice"))
    out = met.join(mine, ["request_digest", "_slice"], "left")
    hit = F.col("_hit").isNotNull()
    return out.select(*requests.columns, F.when(hit, F.col("_hit.result")).otherwise(F.col("_made")).alias("result"),
                      F.when(hit, F.col("_hit.computed_at")).otherwise(F.col("_at")).alias("computed_at"),
                      (hit | (F.col("ts") > F.col("_at"))).alias("cached")).withColumn("cached", F.coalesce("cached", F.lit(False)))


# ------------------------------------------------------------------ envelopes

def write_envelopes(envelopes: DataFrame, path: str, batch: str, day: str = "day", endpoint: str = "endpoint",
                    fmt: str = "parquet") -> None:
    """Write envelopes (``success, data, error, cached, timestamp`` and the two
    partition columns) as ``parquet`` or ``json`` by (day, endpoint, batch). A
    batch that is written again replaces its own rows."""
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt is parquet or json")
    rows = envelopes.withColumnsRenamed({day: "day", endpoint: "endpoint"}).withColumn("batch", F.lit(batch))
    (rows.repartition("day", "endpoint").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "endpoint", "batch").format(fmt).save(path))


def read_envelopes(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """The envelopes of a folder, with the columns of ``like`` (the frame that was written)."""
    kept = [f.name + " " + f.dataType.simpleString() for f in like.schema if f.name not in ("day", "endpoint")]
    schema = ", ".join([*[f"`{k.split(' ', 1)[0]}` {k.split(' ', 1)[1]}" for k in kept], "day date", "endpoint string", "batch string"])
    return spark.read.schema(schema).format(fmt).load(path)
