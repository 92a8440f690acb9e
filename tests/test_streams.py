"""Streaming forms agree with batch; one request per lifetime; resuming."""

from pyspark.sql import functions as F

from pagewise.operators import metering as M
from pagewise.sources import requests as RQ
from pagewise.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def test_dedup_keeps_one_request_per_lifetime(spark):
    out = ST.run_available(ST.dedup_stream(ST.requests_stream(spark, SF, dense=True)), "t-dedup")
    kept = {r.request_id for r in out.collect()}
    last, want = {}, set()
    rows = M.with_request_key(RQ.requests(spark, SF, dense=True)).orderBy("ts", "request_id").collect()
    for r in rows:
        if r.request_digest not in last or (r.ts - last[r.request_digest]).total_seconds() >= 3600:
            last[r.request_digest] = r.ts
            want.add(r.request_id)
    assert kept == want and len(want) < len(rows)


def test_reuse_is_from_strictly_earlier_results(spark):
    rows = M.ttl_reuse(M.with_request_key(RQ.requests(spark, SF, dense=True))).collect()
    hits = [r for r in rows if r.cached]
    assert hits and all(0 < (r.ts - r.served_from).total_seconds() < 3600 for r in hits)


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    from pagewise.sources import tables as src
    src.pages(spark, SF).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    for limit in (None, 2):
        s = ST.run_available(ST.read_stream(spark, str(tmp_path), "pages", limit), "t-folder")
        assert s.count() == src.pages(spark, SF).count() > 0


def test_a_job_goes_on_from_its_folder(spark, tmp_path):
    from pagewise.sources import tables as src
    src.pages(spark, SF).limit(7).write.parquet(f"{tmp_path}/in/pages.parquet")
    job = f"{tmp_path}/job"
    assert ST.run_available(ST.read_stream(spark, f"{tmp_path}/in", "pages"), "t-job", job_dir=job).count() == 7
    src.pages(spark, SF).limit(3).write.mode("append").parquet(f"{tmp_path}/in/pages.parquet")
    assert ST.run_available(ST.read_stream(spark, f"{tmp_path}/in", "pages"), "t-job", job_dir=job).count() == 10


def test_metering_stream_equals_batch(spark):
    s = ST.run_available(ST.minute_metering(ST.requests_stream(spark, SF, dense=True)), "t-meter", "update",
                         keys=["window_start", "caller"])
    b = (RQ.requests(spark, SF, dense=True).groupBy(F.window("ts", "1 minute").start.alias("window_start"), "caller")
         .agg(F.count(F.lit(1)).alias("n_calls")))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_enrichment_stream_equals_batch(spark):
    from pagewise.sources import tables as src
    s = ST.run_available(ST.enrichment_stream(ST.read_stream(spark, SF, "pages")), "t-enrich")
    b = ST.enrichment_stream(src.pages(spark, SF))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
