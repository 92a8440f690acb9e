"""Quality rules: counts against plain loops, training and scores against plain sums, held-out verdicts, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewise.llm import rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def texts():
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "漢", "😀", " ", " ", "\n", "\t", "#", " ", "\x1f"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    out += [" ".join(rng.choice("xyz") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    line = "one two three four five six seven eight"
    return out + [None, "", "\n", "\n\nword", line, f"{line} {line}", f"{line}\n{line}\n", "w " * 70_000, "x" * 100_000,
                  f"a {line} b {line} c {line}", "tail\n", "\r\n".join([line] * 3)]


def test_counts_against_plain_loops():
    rows = texts()
    for size in (1, 300, 1 << 20):
        got = []
        for s in rules.slices(pa.array(rows), size):
            c = s.counts()
            got += list(zip(*[c[k].tolist() for k in rules.COUNTS], strict=True))
        assert got == [plain(t)[:5] for t in rows]
    assert list(rules.slices(pa.array([], pa.string()))) == []
    sliced = pa.array(["x", "one two", None, "three"]).slice(1)
    assert [s.counts()["n_words"].tolist() for s in rules.slices(sliced)] == [[2, 0, 1]]


def test_margins_and_vectors_against_plain_sums():
    weights = np.random.default_rng(1).normal(size=1 << rules.BITS)
    text = "Ab cé 漢字 Ab 😀!"
    slot = lambda h: int(rules._mix(np.array([h % 2**64], np.uint64))[0])
    m = [int(x) for x in rules._MULTIPLIERS]
    words = [zlib.crc32(w.encode()) for w in text.split()]
    kinds = [[slot((w + 1) * m[0]) for w in words],
             [slot((a + 2) * m[1] + b * m[2]) for a, b in zip(words, words[1:], strict=False)],
             [slot(rules.SEED + sum(int.from_bytes(c.encode(), "little") * k for c, k in zip(text[i:i + 4], m, strict=True)))
              for i in range(len(text) - 3)]]
    want = sum(rules.SCALE * np.mean(weights[k]) for k in kinds)
    column = pa.array(["left", text, "right side here"])
    for size in (1, 1 << 20):
        margins = np.concatenate([s.margins(weights) for s in rules.slices(column, size)])
        assert np.isclose(margins[1], want)
        sums = []
        for s in rules.slices(column, size):
            doc, slots, values = s.vectors()
            sums += [values[doc == i] @ weights[slots[doc == i]] for i in range(s.n)]
        assert np.allclose(sums, margins)


def test_calibration_is_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * x - 0.4)))).astype(float)
    slope, shift = rules.platt(x, y)
    assert abs(slope - 0.7) < 0.08 and abs(shift + 0.4) < 0.15


def test_table(spark):
    got = entry.queries()["op13_rules"](spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert tuple(rows[d.doc_id])[1:7] == plain(d.text), d.doc_id
    assert not any(r.kept and r.base_failed for r in rows.values())


def test_held_out_verdicts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 3
    model = rules.fit(docs, labels, ~held_out)
    seen = rules.judge(docs.join(labels, "doc_id").where(held_out), model).join(labels, "doc_id").collect()
    good, bad = [r for r in seen if r.quality == 1], [r for r in seen if r.quality == 0]
    # verdicts that the trained part alone reaches, on rows that no counted rule has failed
    assert np.mean([r.verdict == "poor" for r in bad if not r.base_failed]) > 0.95
    assert np.mean([r.verdict != "poor" for r in good]) > 0.99
    assert np.mean([r.kept == (r.quality == 1) for r in seen if not (r.quality == 1 and r.base_failed)]) > 0.99
    p, y = np.array([r.probability for r in seen]), np.array([r.quality for r in seen])
    assert np.mean((p - y) ** 2) < 0.04


def test_odd_rows(spark):
    good = "Plain words of number {} stand here and so on it goes, with a line that is long enough to count {} times over."
    rows = [(i, good.format(i, i * i), "k") for i in range(60)]
    rows += [(100 + i, "### %% $$ || ## " * (3 + i % 5) + str(i), "k") for i in range(60)]
    rows += [(300, None, "k"), (301, "", "k"), (None, good.format(1, 1), "k"), (0, rows[0][1], "k"),
             (302, "word " * 100_000, "k"), (303, good.format("x", "y"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, probability string")
    marks = [(i, 1 if i < 100 else 0) for i, *_ in rows if i is not None and i < 300]
    marks += [(200, None), (201, 7), (None, 1), (5, 1), (6, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = rules.fit(docs, labels)
    out = rules.judge(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    assert all((r.verdict != "poor") == (r.doc_id < 100) for r in out if r.doc_id is not None and r.doc_id < 300)
    assert [r.kept for r in out if r.doc_id in (300, 301, 302)] == [False] * 3
    assert [r.kept for r in out if r.doc_id == 303] == [True]
    none = rules.fit(docs, labels.limit(0))
    assert none.weights is None and {r.probability for r in rules.judge(docs, none).collect()} == {0.5}
    assert rules.judge(docs.limit(0), model).count() == 0
    few = rules.labelled(docs, labels, max_rows=40).count()
    assert 10 < few < 80
