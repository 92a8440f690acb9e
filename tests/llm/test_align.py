"""Alignment against plain loops, both encoders of A against each other, odd texts and large groups."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewise.llm import align

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def both():
    return align.load(align.TOKENIZERS, align.FILE_A, align.FILE_B)


def plain_tokens(both, text):
    if not text:
        return [], []
    a = both.slow.encode(" " + text, add_special_tokens=False).ids
    b = both.pieces.encode(text)
    whole = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != whole or b"".join(both.bytes_b[i] for i in b) != whole:
        return [], []
    return a, b


def plain(both, texts):
    """The contract's columns, group by group."""
    grouped = []
    for t in texts:
        a, b = plain_tokens(both, t)
        ends_a = np.cumsum([len(both.bytes_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(both.bytes_b[i]) for i in b]).tolist()
        cuts, groups = sorted(set(ends_a) & set(ends_b)), []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if low < e <= high],
                           [i for i, e in zip(b, ends_b, strict=True) if low < e <= high]))
        grouped.append((a, b, groups))
    count = Counter()
    for _, _, groups in grouped:
        count.update({(x, y) for p, q in groups for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups in grouped:
        links = [(x, y) for p, q in groups for x in p for y in q]
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links),
                    sum(count[x] for x in links), written))
    return out


def test_both_encoders_agree(both):
    assert both.fast is not None
    rng = random.Random(5)
    signs = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301]]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 30)))
        assert both.encode_a(text) == both.slow.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("<|endoftext|> <s></s>", "a" * 9000, " " * 5000 + "x", "\n" * 300, "1234567890 " * 50, "x" * 50_000):
        assert both.encode_a(text) == both.slow.encode(text, add_special_tokens=False).ids


def test_bytes_of_entries(both):
    for text in ("Ünïcode ☃ and\tblanks\n", "plain"):
        assert b"".join(both.bytes_a[i] for i in both.slow.encode(text).ids) == text.encode()
        assert b"".join(both.bytes_b[i] for i in both.pieces.encode(text)) == b" " + text.encode()


TEXTS = ["Hello wörld, this is it.", "Hello wörld, this is it.", None, "", " ", "\n", "a▁b", "<|endoftext|> and <s>",
         "漢字かな交じり文 😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 40, "x\x00y", "ﬁ ligature Å", "tab\ttab  two   three",
         "the the the cat", " odd\u0085", "".join(chr(0x4E00 + i * 7 % 900) for i in range(400))]


@pytest.mark.parametrize("common", [align.COMMON_PAIRS, 5, 0])
def test_odd_rows_against_plain_loops(spark, both, common, monkeypatch):
    docs = spark.createDataFrame([(i if i % 5 else 5, t, "k") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, groups string").unionByName(
        spark.createDataFrame([(None, "Hello wörld", None)], "doc_id long, text string, groups string"))
    texts = [*TEXTS, "Hello wörld"]
    ids = [*[i if i % 5 else 5 for i in range(len(TEXTS))], None]
    out = align.align(docs, common_pairs=common)
    assert out.columns == ["doc_id", *COLUMNS, "groups"]
    want = [(i, *row) for i, row in zip(ids, plain(both, texts), strict=True)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert align.align(docs.limit(0), common_pairs=common).count() == 0


def test_large_groups(both, monkeypatch):
    # A: one token of 5 bytes, then 4 each, one of 3; B: 2 each: their ends first meet at the end of the text
    rng = np.random.default_rng(7)
    len_a, len_b = np.full(50, 4), np.full(50, 2)
    len_a[45], len_a[46] = 5, 3
    a = [np.array([45, *rng.integers(0, 40, k), 46], "<u2") for k in (0, 30, 400)]
    b = [rng.integers(0, 40, 2 * k + 4).astype("<u2") for k in (0, 30, 400)]
    rows = [x.tobytes() for x in a], [y.tobytes() for y in b]
    for big, at_once in ((align.BIG_GROUP, align.PAIRS_AT_ONCE), (0, 100), (3, 7)):
        monkeypatch.setattr(align, "BIG_GROUP", big)
        monkeypatch.setattr(align, "PAIRS_AT_ONCE", at_once)
        s = align.Aligned(*rows, len_a, len_b)
        keys, links = s.pairs()
        want = Counter()
        for doc, (x, y) in enumerate(zip(a, b, strict=True)):
            want.update(doc << 32 | int(i) << 16 | int(j) for i in x for j in y)
        assert dict(zip(keys.tolist(), links.tolist(), strict=True)) == dict(want)
        assert s.links.sum() == links.sum()


def test_table_against_plain_loops(spark, both):
    got = entry.queries()["op11_align"](spark, SF)
    assert got.columns == ["doc_id", *COLUMNS, "groups_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "")
                  for d, row in zip(docs, plain(both, [d.text for d in docs]), strict=True))
    assert sorted(map(tuple, got.collect())) == want


def test_slices_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 3000)
    whole = sorted(map(tuple, align.align(docs, digest=True).collect()))
    assert whole == sorted(map(tuple, align.align(docs.repartition(5), digest=True, common_pairs=300).collect()))
