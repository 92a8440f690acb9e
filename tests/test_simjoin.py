"""Similarity join against all pairs of random vectors."""

import math
import random

import pytest

from pagewise.operators import simjoin


def _vectors(seed):
    rng = random.Random(seed)
    out = {}
    for i in range(70):
        base = rng.choice([None, *range(max(0, i - 4), i)])
        v = dict(out[base]) if base is not None and base in out else {f"t{rng.randint(0, 60)}": rng.randint(1, 9) for _ in range(rng.randint(1, 14))}
        for _ in range(rng.randint(0, 2)):
            v[f"t{rng.randint(0, 60)}"] = rng.randint(1, 3)
        if rng.random() < 0.5:
            v["the"] = rng.randint(1, 30)
        out[i] = v
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95, 1.0])
def test_links_against_all_pairs(spark, threshold):
    vectors = _vectors(int(threshold * 100))
    tf = spark.createDataFrame([(i, t, n) for i, v in vectors.items() for t, n in v.items()], "text_id long, term string, tf long")

    def linked(a, b):
        dot = sum(n * vectors[b].get(t, 0) for t, n in vectors[a].items())
        square = [sum(n * n for n in vectors[x].values()) for x in (a, b)]
        return dot >= threshold * math.sqrt(square[0]) * math.sqrt(square[1])
    members, links = simjoin.similarity_classes(tf, threshold)
    cls = {r.text_id: r.class_id for r in members.collect()}
    for i, v in vectors.items():
        assert cls[i] == min(j for j, w in vectors.items() if w == v)
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and linked(a, b)}
    assert {(r.a, r.b) for r in links.collect()} == want
    got = {r.text_id: r.n_links for r in simjoin.similarity_join(tf, threshold).collect()}
    same = {i: sum(cls[j] == cls[i] for j in vectors) - 1 for i in vectors}
    assert got == {i: same[i] + sum(cls[j] != cls[i] and linked(cls[i], cls[j]) for j in vectors) for i in vectors}


def test_no_rows(spark):
    none = spark.createDataFrame([], "text_id long, term string, tf long")
    assert simjoin.similarity_join(none).count() == 0


def test_many_cells_and_no_row_per_pair(spark, monkeypatch):
    """Small groups: each pair meets in one of many cells; all texts share a frequent term."""
    for name, value in (("GROUP_ROWS", 9), ("STRIP", 4), ("CHECKED_TERMS", 12), ("OWN_TERMS", 3), ("SHARED", 5)):
        monkeypatch.setattr(simjoin, name, value)
    vectors = {i: {"the": 40 + i % 7, f"t{i % 11}": 1 + i % 5, f"u{i}": 1} for i in range(60)}
    tf = spark.createDataFrame([(i, t, n) for i, v in vectors.items() for t, n in v.items()], "text_id long, term string, tf long")

    def linked(a, b):
        dot = sum(n * vectors[b].get(t, 0) for t, n in vectors[a].items())
        square = [sum(n * n for n in vectors[x].values()) for x in (a, b)]
        return dot >= 0.995 * math.sqrt(square[0]) * math.sqrt(square[1])
    want = {(a, b) for a in vectors for b in vectors if a < b and linked(a, b)}
    assert 0 < len(want) < 1770
    assert {(r.a, r.b) for r in simjoin.links(tf, 0.995).collect()} == want
    got = {r.text_id: r.n_links for r in simjoin.similarity_join(tf, 0.995).collect()}
    assert got == {i: sum(i in p for p in want) for i in vectors}


def test_each_vector_is_kept_once_and_cells_are_not_shuffled(spark, monkeypatch):
    """Cells read the blocks where they lie: before, every vector was shuffled once for each group."""
    monkeypatch.setattr(simjoin, "GROUP_ROWS", 5)
    kept, cut = {}, simjoin.cut_lineage
    monkeypatch.setattr(simjoin, "cut_lineage", lambda df, name: kept.setdefault(name, cut(df, name)))
    tf = spark.createDataFrame([(i, t, 1 + i % 3) for i in range(60) for t in ("the", f"u{i}", f"v{i % 9}")],
                               "text_id long, term string, tf long")
    found = simjoin.links(tf, 0.6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    blocks = [simjoin.Vectors(r.data) for r in kept["blocks"].collect()]
    assert len(blocks) >= 12 and max(len(v.ids) for v in blocks) <= 5
    assert sorted(i for v in blocks for i in v.ids.tolist()) == list(range(60))
    ids = sorted(r.block for r in kept["blocks"].select("block").collect())
    cells = [(r.a, r.b) for r in simjoin._cells(kept["blocks"]).select("a", "b").collect()]
    assert sorted((min(c), max(c)) for c in cells) == [(a, b) for a in ids for b in ids if a <= b]


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_bounds_lose_no_link(spark, monkeypatch, threshold):
    """Few dimensions, so that many terms share one: what is left out is no link, what is sure is one."""
    for name, value in (("COARSE", ((1, 2), (2, 1))), ("OWN_TERMS", 4), ("SHARED", 6), ("STRIP", 7), ("CHECKED_TERMS", 20), ("GROUP_ROWS", 24)):
        monkeypatch.setattr(simjoin, name, value)
    vectors = _vectors(7)
    tf = spark.createDataFrame([(i, t, n) for i, v in vectors.items() for t, n in v.items()], "text_id long, term string, tf long")
    packed = simjoin._packed(tf, threshold, "text_id")
    blocks = [simjoin.Vectors(r.data) for r in simjoin._blocks(packed, simjoin._representatives(simjoin._members(packed))).collect()]
    assert len(blocks) > 2
    got, sure, every = set(), set(), sorted(i for v in blocks for i in v.ids.tolist())
    for k, x in enumerate(blocks):
        for y in blocks[k:]:
            for i, j, known in simjoin.near_pairs(x, y, threshold, simjoin._levels()):
                pairs = [(i, j)] if known else [p[:2] for p in simjoin.Checker(x, y).links(i, j, threshold)]
                for p, q in pairs:
                    found = [(min(a, b), max(a, b)) for a, b in zip(x.ids[p].tolist(), y.ids[q].tolist())]
                    assert not got & set(found)
                    got |= set(found)
                    sure |= set(found) if known else set()

    def linked(a, b):
        dot = sum(n * vectors[b].get(t, 0) for t, n in vectors[a].items())
        square = [sum(n * n for n in vectors[x].values()) for x in (a, b)]
        return dot >= threshold * math.sqrt(square[0]) * math.sqrt(square[1])
    assert got == {(a, b) for a in every for b in every if a < b and linked(a, b)}
    assert sure <= got


def test_copies_null_id_and_terms_that_join_alike(spark):
    """Copies fold into one class wherever they lie; a term that others make up is another."""
    rows = [(i, t, n) for i in range(40) for t, n in (("a", 2), ("bc", 1))] + [(50, "ab", 2), (50, "c", 1), (None, "a", 2), (None, "bc", 1)]
    tf = spark.createDataFrame(rows, "text_id long, term string, tf long").repartition(6)
    got = sorted((-1 if r.text_id is None else r.text_id, r.class_id, r.class_size, r.n_links) for r in simjoin.similarity_join(tf).collect())
    assert got == [(-1, 0, 41, 40), *((i, 0, 41, 40) for i in range(40)), (50, 50, 1, 0)]
