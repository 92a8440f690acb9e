"""Structured Streaming forms of the batch jobs.

The transformations are the same functions the batch queries use (they are
row-local or aggregate with watermarks), so a stream and a batch over the
same files agree:

  enrichment_stream     pages arriving as files -> SEO records (stateless)
  extraction_stream     pages arriving as files -> content records (stateless)
  dedup_stream          drop repeats of a request key within the TTL
  minute_metering       tumbling or sliding counts per caller (watermarked)
  sessions              30-minute-gap caller sessions (session_window)

``run_available`` drives a stream with ``trigger(availableNow=True)`` into a
parquet table through ``foreachBatch`` and returns the table as a batch
DataFrame. A micro-batch writes the folder of its batch id, so a batch that is
run again after a failure replaces its own rows. With ``job_dir`` a job keeps
its checkpoint and table in a folder of its own and goes on from them; without,
both are new under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewise.operators import metering as M
from pagewise.operators import pages as P
from pagewise.session import shared_path
from pagewise.sources import requests as RQ
from pagewise.sources import tables as src

TTL = "1 hour"
SESSION_GAP = "30 minutes"
LATE_ROWS = "2 minutes"


def read_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """File-source stream over one table: a parquet file or a folder of part
    files. ``max_files`` limits the files of a micro-batch (unset: all)."""
    reader = spark.readStream.schema(src.SCHEMAS[table])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern the path may be a file as well as a folder
    return reader.parquet(f"{sf_dir.rstrip('/')}/{table}.parque[t]")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def enrichment_stream(pages: DataFrame) -> DataFrame:
    """Stateless: the SEO record of each arriving page."""
    return P.seo_record(pages)


def extraction_stream(pages: DataFrame) -> DataFrame:
    """Stateless: the content record of each arriving page."""
    return P.content_record(pages)


DEDUP_SCHEMA = "request_id long, request_key string, ts timestamp, endpoint string"


def dedup_stream(requests: DataFrame, ttl: str = TTL) -> DataFrame:
    """Keep a request unless one of its digest was kept less than ``ttl``
    before it. State is one time per digest, freed when the watermark has
    passed its lifetime."""
    keyed = M.with_request_key(requests).withWatermark("ts", ttl)
    life = pd.Timedelta(ttl)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        kept = []
        for ts in rows["ts"]:
            kept.append(last is None or ts - last >= life)
            if kept[-1]:
                last = ts
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + life).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows.loc[kept, ["request_id", "request_key", "ts", "endpoint"]]

    return keyed.groupBy("request_digest").applyInPandasWithState(
        keep, DEDUP_SCHEMA, "last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def minute_metering(requests: DataFrame, window: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Calls per caller and window; tumbling, or sliding by ``slide``."""
    return (requests.withWatermark("ts", LATE_ROWS)
                    .groupBy(F.window("ts", window, slide).alias("w"), "caller")
                    .agg(F.count(F.lit(1)).alias("n_calls"))
                    .select(F.col("w.start").alias("window_start"), "caller", "n_calls"))


def sessions(requests: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Caller sessions; each task merges its own rows to sessions before the
    shuffle, so a busy caller sends sessions and not rows."""
    requests.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (requests.withWatermark("ts", LATE_ROWS)
                    .groupBy(F.session_window("ts", gap).alias("s"), "caller")
                    .agg(F.count(F.lit(1)).alias("n_calls"),
                         F.size(F.collect_set("endpoint")).cast("long").alias("n_endpoints"))
                    .select("caller", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                            "n_calls", "n_endpoints"))


def run_available(stream: DataFrame, name: str, output_mode: str = "append",
                  keys: list[str] | None = None, job_dir: str | None = None) -> DataFrame:
    """Process everything available, then stop; return the sink as a batch
    DataFrame. In update mode a key can be emitted by several micro-batches;
    the latest emission per ``keys`` wins when reading back."""
    spark = stream.sparkSession
    base = job_dir or shared_path(spark, f"stream-{name}")
    table = f"{base}/table"
    schema = stream.schema.add("_batch", "long")
    # so that a run without output leaves an empty table
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{table}/_batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/_batch={batch_id}")

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
               .option("checkpointLocation", f"{base}/checkpoint")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(schema).parquet(table)
    if keys:
        latest = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
        out = out.withColumn("_rk", F.row_number().over(latest)).filter("_rk = 1").drop("_rk")
    return out.drop("_batch")


def requests_stream(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return RQ.requests_from_events(events_stream(spark, sf_dir), dense)
