"""SimHash near-duplicates against a direct computation."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewise.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        low = low.replace(b, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (doc_id, fp) -> {doc_id: component}"""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i:] ^ arr[i]) <= 4) + i:
            parent[find(fps[j])] = find(f)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted((d is None, d or 0, f"{f:016x}", least.get(find(f))) for d, f in rows)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in df.collect())


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == plain_components(rows)


@pytest.mark.parametrize("cell_rows_max", [200_000, 3])
def test_links_are_complete_and_true(spark, cell_rows_max):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        for _ in range(6):
            g = f
            for k in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << k
            fps.add(g)
    fps.add(0)
    fps.add(15)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = simhash.links(df, cell_rows_max=cell_rows_max, variants_per_cell=1 << 12).collect()
    pairs = {tuple(sorted((int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))))) for r in got}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        root[find(a)] = find(b)
    want = {f: f for f in fps}

    def find2(x):
        while want[x] != x:
            x = want[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= 4:
                want[find2(a)] = find2(b)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            assert (find(a) == find(b)) == (find2(a) == find2(b))


def test_slices_find_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**62, 300, dtype=np.uint64)
    fps = np.unique(np.r_[fps, fps ^ np.uint64(0b1010), fps ^ np.uint64(1 << 63)])
    whole = simhash._span(fps, 0, 0, 2, 4)
    monkeypatch.setattr(simhash, "SLICE_VARIANTS", 1000)
    sliced = simhash._span(fps, 0, 0, 2, 4)

    def groups(pair):
        parent = {int(f): int(f) for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in zip(*pair):
            parent[find(int(a))] = find(int(b))
        out = {}
        for f in parent:
            out.setdefault(find(f), set()).add(f)
        return sorted(sorted(g) for g in out.values())
    assert groups(whole) == groups(sliced)


ODD = [(5, None, "x"), (4, "", "y"), (9, " \t\n", None), (3, "One two three", "x"), (2, "one TWO three", None),
       (7, "one two three four five six seven", "x"), (7, "one two three four five six seven", "x"),
       (None, "alone here in the world tonight", None), (None, "alone here in the world tonight", "z"),
       (1, "ß Ä é " * 4000, "x")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, fp string")
    got = result(simhash.near_duplicates(df))
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t, _ in ODD])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    named = simhash.keep_one(df.withColumn("fingerprint", F.lit("mine")).withColumn("root", F.lit(1)))
    assert {r.fingerprint for r in named.collect()} == {"mine"}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 2), (False, 4), (False, 7), (True, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_hash_equals_the_engine(spark):
    r = spark.sql("select xxhash64('de la') h").select(F.hex("h").alias("h")).first()
    assert r.h.lower().rjust(16, "0") == f"{xxhash.xxh64_intdigest(b'de la', 42):016x}"
