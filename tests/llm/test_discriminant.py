"""Discriminant: densities against the formula, held-out ranking, odd rows."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewise.llm import quality

SF = "/root/testdata/sf0.1"


def test_scores_against_the_formula():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(80, 3)) * [1, 2, 0.5] + 1, 1: rng.normal(size=(300, 3))}
    model = quality.discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, 0.3, 0.1)
    pooled = (80 * np.cov(x[0].T, bias=True) + 300 * np.cov(x[1].T, bias=True)) / 380
    at = rng.normal(size=(20, 3))
    dens = []
    for k in (0, 1):
        c = 0.7 * np.cov(x[k].T, bias=True) + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(3)
        d = at - x[k].mean(axis=0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    want = 1 / (1 + np.exp(-(np.log(300.5 / 80.5) + dens[1] - dens[0])))
    assert np.allclose(model.score(at), want)


def test_held_out_ranking(spark):
    got = entry.queries()["op5_quality"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    assert got.count() == 10_000
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    rows = [(i, f"Plain words of number {i} stand here. And so on it goes.\nNext line {i * i}.", "k") for i in range(40)]
    rows += [(100 + i, "### %% $$ || ## " * (3 + i % 5), "k") for i in range(40)]
    rows += [(200, None, "k"), (201, "", "k"), (202, " \n", None), (None, "Plain words of number stand here.", "k"),
             (0, rows[0][1], "k"), (203, "word " * 100_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    marks = [(i, 1 if i < 100 else 0) for i, *_ in rows if i is not None and i < 200]
    marks += [(200, None), (201, 7), (None, 1), (5, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = quality.classify(docs, labels, F.lit(True)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert all(r.predicted == (r.doc_id < 100) for r in out if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in out if r.doc_id in (200, 201)}) == 1
    prior = quality.classify(docs, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in prior} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(True)).count() == 0
