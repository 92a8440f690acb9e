"""Metric range join against all pairs in double precision."""

import numpy as np
import pytest

import __spark_entry__ as entry
from pagewise.llm import rangejoin

SF = "/root/testdata/sf0.01"


def plain(rows, cosine=0.95):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64) / max(map(abs, v))
            unit[k] = x / np.sqrt((x * x).sum())
    n = [0] * len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                parent[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i is None, i or 0, n[k], least.get(find(k)), i is not None and least[find(k)] == i)
                  for k, (i, _) in enumerate(rows))


def result(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_table_against_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = entry.queries()["op10_rangejoin"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = result(got)
    assert got == plain(rows)


def test_planted_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(10_000 + i, (np.array(rows[i // 3][1]) + rng.normal(size=64) * 0.03).tolist()) for i in range(300)]
    rows += [(20_000 + i, rows[7][1]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(rangejoin.near_duplicates(df, cell_vectors=100, block_vectors=60))
    assert got == plain(rows) and sum(r[2] > 0 for r in got) > 200


@pytest.mark.parametrize("cell,block", [(20, 4096), (15, 8), (4096, 10)])
def test_cells_and_blocks(spark, cell, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.25).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000 + i, rng.normal(size=6).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(rangejoin.near_duplicates(df, cell_vectors=cell, block_vectors=block)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (None, [1e300, 1e298]), (9, [1.0, 0.0, 0.0]),
            (None, [0.0, 5.0]), (10, [-1.0, 0.0]), (11, None)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<double>, rep string, size int")
    assert result(rangejoin.near_duplicates(df)) == plain(rows)
    assert rangejoin.near_duplicates(df.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.2, 0.4])], "vec_id long, embedding array<float>")
    assert [r.n_links for r in rangejoin.near_duplicates(floats).collect()] == [1, 1]
