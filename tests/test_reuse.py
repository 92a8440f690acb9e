"""Result reuse over a store and with a lifetime, exact percentiles: against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.operators import metering as M
from pagewise.operators import store as ST
from pagewise.session import shared_path

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)


def _scan(times, ttl):
    """(served_from or None) of requests in (time, id) order."""
    stored, out = None, []
    for t in times:
        if stored is None or t - stored >= ttl:
            stored = t
        out.append(stored if stored < t else None)
    return out


def test_pieces_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        ttl = rng.choice([1, 3, 10, 40])
        times = np.array(sorted(rng.randint(0, 120) for _ in range(rng.randint(1, 60))))
        cuts = sorted(rng.sample(range(1, len(times)), min(len(times) - 1, rng.randint(0, 5)))) if len(times) > 1 else []
        free, got = None, []
        held = None
        for piece in np.split(times, cuts):
            entries, exits = M._exits(piece, ttl)
            k = 0 if free is None else int(np.searchsorted(entries, free))
            misses = np.zeros(0, np.int64)
            if k < len(entries):
                misses = M._misses(piece, int(entries[k]), ttl)
                assert misses[-1] == exits[k]
            before = misses if held is None else np.append(held, misses)
            got += M._served(piece, before).tolist()
            if len(misses):
                held, free = misses[-1], misses[-1] + ttl
        assert got == _scan(times.tolist(), ttl)


def test_a_hot_digest_spans_partitions(spark):
    rng = random.Random(9)
    rows = []
    for i in range(4000):
        digest = "hot" if i % 3 else f"d{rng.randint(0, 300):03d}"
        rows.append((i, f"k{digest}", digest, "extract", T0 + timedelta(seconds=rng.randint(0, 40_000))))
    rows += [(9000 + i, "kburst", "zz", "seo", T0) for i in range(500)]
    df = spark.createDataFrame(rows, "request_id long, request_key string, request_digest string, endpoint string, ts timestamp")
    got = {r.request_id: (r.served_from, r.cached) for r in M.ttl_reuse(df.repartition(6), 3600).collect()}
    assert len(got) == len(rows)
    local = {r.request_id: r.ts for r in df.collect()}  # times as the session reads them
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((local[r[0]], r[0]))
    for requests in by.values():
        requests.sort()
        want = _scan([t for t, _ in requests], timedelta(seconds=3600))
        assert [got[i] for _, i in requests] == [(w, w is not None) for w in want]
    assert M.ttl_reuse(df.limit(0)).count() == 0


@pytest.mark.parametrize("accuracy", [20_000, 60])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(M, "SKETCH_ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    values = {"a": rng.lognormal(3, 1, 3000).round(2), "b": np.full(700, 7.5), "c": np.array([1.0, 2.0]),
              "d": np.array([4.0]), "e": rng.integers(0, 4, 2000).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "endpoint string, latency_ms double").repartition(7)
    got = {r.endpoint: r for r in M.latency_percentiles(df).collect()}
    assert got["a"].n_requests == 3001 and got["none"].n_requests == 1 and got["none"].p50_latency_ms is None
    assert got[None].p99_latency_ms == 3.0
    for k, vs in values.items():
        want = [float(np.quantile(vs, q)) for q in M.QUANTILES]
        assert np.allclose([got[k].p50_latency_ms, got[k].p95_latency_ms, got[k].p99_latency_ms], want, atol=6e-5), k


def test_store_computes_only_misses(spark):
    seen = []

    def compute(rows):
        done = rows.withColumn("result", F.concat(F.lit("r-"), "request_digest"))
        seen.append(sorted(r.request_digest for r in done.collect()))
        return done

    def batch(*rows):
        return spark.createDataFrame([(d, T0 + timedelta(minutes=m)) for d, m in rows], "request_digest string, ts timestamp")
    path = shared_path(spark, "test-results")
    first = ST.serve(batch(("a", 0), ("a", 5), ("b", 1), (None, 2)), path, "one", compute, 3600)
    assert sorted((str(r.request_digest), r.cached, str(r.result)) for r in first.collect()) == [
        ("None", False, "None"), ("a", False, "r-a"), ("a", True, "r-a"), ("b", False, "r-b")]
    second = batch(("a", 30), ("b", 70), ("c", 31), ("a", 100))
    for _ in range(2):  # run again: same rows, nothing twice
        out = ST.serve(second, path, "two", compute, 3600)
        assert sorted((r.request_digest, r.cached) for r in out.collect()) == [("a", False), ("a", True), ("b", False), ("c", False)]
        assert spark.read.parquet(path).count() == 2 + 3
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c"]]
    assert ST.serve(second.limit(0), path, "three", compute).count() == 0


def test_envelopes_of_a_batch_replace_each_other(spark):
    for fmt in ("parquet", "json"):
        path = shared_path(spark, f"test-envelopes-{fmt}")
        rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "n int, code string").selectExpr(
            "code IS NULL AS success", "struct(n) AS data", "struct(code) AS error", "DATE'2024-01-01' + n AS day", "'seo' AS endpoint")
        for batch, part in (("x", rows), ("y", rows.limit(1)), ("x", rows)):
            ST.write_envelopes(part, path, batch, fmt=fmt)
        back = ST.read_envelopes(spark, path, rows, fmt)
        assert back.groupBy("batch").count().orderBy("batch").collect() == [("x", 3), ("y", 1)]
        assert sorted(r.n for r in back.where("batch = 'x'").select("data.n").collect()) == [1, 2, 3]
