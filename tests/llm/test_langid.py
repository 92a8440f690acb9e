"""Conditional random field: marginals by enumeration, held-out accuracy, odd rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewise.llm import langid

SF = "/root/testdata/sf0.01"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(3, 3))
    seqs = [rng.normal(size=(n, 3)) for n in (5, 3, 1)]
    pad = np.zeros((5, 3, 3))
    for c, s in enumerate(seqs):
        pad[:len(s), c] = s
    got = langid.marginals(pad, np.array([5, 3, 1]), moves)
    for c, s in enumerate(seqs):
        want = np.zeros_like(s)
        for path in itertools.product(range(3), repeat=len(s)):
            w = np.exp(sum(s[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += w
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(got[:len(s), c], want)
    assert np.allclose(langid.marginals(pad, np.array([5, 3, 1]), moves, keep=False), got.sum(axis=0))


def test_code_switched_words_are_labelled():
    it = "il gatto dorme sul divano e la notte è lunga come una canzone antica del mare".split()
    no = "katten sover på sofaen og natten er lang som en gammel vise fra havet her".split()
    model = langid.train({"it": it * 40, "no": no * 40})
    mixed = it[:6] + no[:6] + it[6:10]
    post = langid.marginals(model.word_scores(mixed)[:, None, :], np.array([len(mixed)]), model.moves)[:, 0]
    assert [model.labels[k] for k in post.argmax(axis=1)] == ["it"] * 6 + ["no"] * 6 + ["it"] * 4


def test_held_out_accuracy(spark):
    got = entry.queries()["op6_langid"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 350
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, "der die das und nicht " * 30, "de"), (2, "the of and to in that " * 30, "en"), (3, None, "en"),
            (4, "", None), (5, " 12 ² — !", "de"), (None, "the and of", "en"), (2, "the of and to in that " * 30, "en"),
            (6, "the in " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(docs, F.lit(True))
    out = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, model).collect()))
    assert out == [(0, "en"), (1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 6]
    none = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
