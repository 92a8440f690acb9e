"""Pfair mixing against a slot-by-slot simulation."""

from fractions import Fraction

import pytest

from pagewise.llm import mixing

SF = "/root/testdata/sf0.01"


def simulate(blocks, units):
    """Plain EDF over single blocks, phases included: list of (source, block)."""
    done, out = {s: 0 for s in blocks}, []
    while any(done[s] < blocks[s] for s in blocks):
        active = sorted(s for s in blocks if done[s] < blocks[s])
        total, taken, t = sum(units[s] for s in active), {s: 0 for s in active}, 0
        while all(done[s] < blocks[s] for s in active):
            free = [(-(-(taken[s] + 1) * total // units[s]), s) for s in active if taken[s] * total // units[s] <= t]
            s = min(free)[1]
            out.append((s, done[s]))
            taken[s] += 1
            done[s] += 1
            t += 1
    return out


@pytest.mark.parametrize("blocks,units", [
    ({"a": 9, "b": 4, "c": 1}, {"a": 3, "b": 2, "c": 1}),
    ({"a": 1}, {"a": 7}),
    ({"a": 50, "b": 50, "c": 50}, {"a": 5, "b": 1, "c": 13}),
    ({f"s{i}": 5 + 3 * i for i in range(9)}, {f"s{i}": 1 + i * i % 7 for i in range(9)}),
])
def test_schedule(blocks, units):
    got = {}
    for s, phases in mixing.schedule(blocks, units).items():
        for k in range(blocks[s]):
            p = [p for p in phases if p.first_block <= k][-1]
            j = k - p.first_block
            got[p.start + j // p.units * p.total + p.slots[j % p.units]] = (s, k)
    assert [got[t] for t in range(sum(blocks.values()))] == simulate(blocks, units)


@pytest.mark.parametrize("units", [[1, 1], [3, 2, 1], [100, 37, 1, 64, 8], [7] * 11 + [1]])
def test_deviation_below_one_block(units):
    total = sum(units)
    slots = mixing.earliest_deadline_first(units)
    assert sorted(x for own in slots for x in own) == list(range(total))
    order = sorted((x, s) for s, own in enumerate(slots) for x in own)
    given = [0] * len(units)
    for t, (_, s) in enumerate(order):
        given[s] += 1
        assert all(abs(given[k] - Fraction(units[k] * (t + 1), total)) < 1 for k in range(len(units)))


def check(rows, block_rows):
    place = {}
    for r in rows:
        place.setdefault((r.mix_slot, r.mix_pos), []).append(r)
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert all(len(v) == 1 for v in place.values())
    owner = {}
    for r in rows:
        assert owner.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
        assert 0 <= r.mix_pos < block_rows
    return [owner[t] for t in sorted(owner)]


@pytest.mark.parametrize("group_rows", [1000, 7])
def test_table(spark, group_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    rows = mixing.mix(docs, group_rows=group_rows).collect()
    counts = {}
    for r in docs.collect():
        counts[r.source] = counts.get(r.source, 0) + 1
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    units = mixing.tempered_units(counts)
    assert check(rows, mixing.BLOCK_ROWS) == simulate({s: -(-n // 16) for s, n in counts.items()}, units)


def test_odd_rows(spark):
    rows = [(i, "a", i) for i in range(10)] + [(3, "a", 3)] * 4 + [(None, None, 1)] * 3 + [(50, None, 2), (60, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot long")
    out = mixing.mix(docs, {"a": 2, None: 3}, block_rows=2).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in out) == sorted((d or -1, s or "") for d, s, _ in rows)
    check(out, 2)
    assert mixing.mix(docs.limit(0)).count() == 0
    laid = mixing.interleaved(docs, block_rows=2).collect()
    assert [(r.mix_slot, r.mix_pos) for r in laid] == sorted((r.mix_slot, r.mix_pos) for r in laid)


def test_too_many_sources(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "cast(id as string) as source")
    with pytest.raises(ValueError):
        mixing.mix(docs)
