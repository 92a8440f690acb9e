"""Session construction and shared-storage helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are unset so local runs and tests behave like the
cluster (AQE on, UTC, no UI).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_WRITTEN: list[str] = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pagewise") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("PAGEWISE_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster sets it to shared storage. Only on a local master (tests,
    local runs), where driver and executors share one disk, an unset value is
    filled with a scratch folder; on a cluster an unset value is an error,
    because each executor would write to its own disk.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="pagewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, removed by ``release``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Materialise an intermediate as a parquet table in the shared
    ``spark.checkpoint.dir`` and read it back.

    Used where several consumers read the same large intermediate (each would
    otherwise recompute it when their pushed-down filters differ). The table
    cuts lineage — a lost executor costs a re-read, not a recompute — and,
    unlike an RDD checkpoint, it is columnar and carries real file sizes, so
    the planner never mistakes it for a broadcastable table. ``release``
    removes the tables once their results have been written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("error").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far by this driver; call it
    after the results that read them are stored. Returns how many."""
    n = 0
    while _WRITTEN:
        path = _WRITTEN.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


SCAN_PARTITIONS = "spark.pagewise.scanPartitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin redistribute a scan into ``partitions`` parts; by default
    the number in ``spark.pagewise.scanPartitions``, and no shuffle where that
    is unset. For inputs whose files give the scan fewer splits than the
    CPU-heavy per-row work can use (one row group, as in the test data)."""
    partitions = partitions or int(df.sparkSession.conf.get(SCAN_PARTITIONS, "0"))
    return df.repartition(partitions) if partitions else df
