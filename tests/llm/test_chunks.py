"""Content-defined chunks against a byte-by-byte version, and planted passages."""

import random

import numpy as np

import __spark_entry__ as entry
from pagewise.llm import chunks

SF = "/root/testdata/sf0.001"


def plain_cuts(data):
    out, last, h, hashes = [], 0, 0, []
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFF
        hashes.append(h)
    w = chunks.REACH
    ends = [i + 1 for i, x in enumerate(hashes)
            if x < min(hashes[max(0, i - w):i] + [0xFFFF]) and x <= min(hashes[i + 1:i + 1 + w] + [0xFFFF])]
    inner = [b & 0xC0 == 0x80 for b in data] + [False]
    for end in ends + [len(data)]:
        while inner[end]:
            end += 1
        while end - last > chunks.MAX_BYTES:
            last += chunks.MAX_BYTES
            while inner[last]:
                last += 1
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def plain_repeats(rows, min_chars=chunks.MIN_CHARS):
    """rows: (doc_id, text), unique ids."""
    pieces, holders = {}, {}
    for d, text in rows:
        data, at, own = (text or "").encode(), 0, []
        for end in plain_cuts(data):
            own.append((len(data[:at].decode()), len(data[:end].decode()), data[at:end]))
            holders.setdefault(data[at:end], set()).add(d)
            at = end
        pieces[d] = own
    out = {}
    for d, own in pieces.items():
        got = []
        for wanted in (lambda x: min(holders[x]) < d, lambda x: len(holders[x]) > 1):
            spans = []
            for s, e, x in own:
                if wanted(x):
                    if spans and spans[-1][1] == s:
                        spans[-1][1] = e
                    else:
                        spans.append([s, e])
            got.append([s for s in spans if s[1] - s[0] >= min_chars])
        ids = sorted({min(holders[x]) for s, e, x in own if any(a <= s < b for a, b in got[0])})
        out[d] = tuple(",".join(f"{s}:{e}" for s, e in g) for g in got) + (ids,)
    return out


def test_cuts(monkeypatch):
    rng = random.Random(0)
    texts = ["", "a", "é" * 500, "x" * 5000, "".join(rng.choice("abcdeé ßツ\n") for _ in range(20_000))]
    for step in (chunks.SLICE_BYTES, 777, 50):
        monkeypatch.setattr(chunks, "SLICE_BYTES", step)
        for t in texts:
            data = t.encode()
            got = chunks.cuts(data)
            assert got == plain_cuts(data)
            assert all(data[a:b].decode() for a, b in zip([0, *got], got)) and (not data or got[-1] == len(data))


def test_insertion_moves_few_chunks():
    rng = random.Random(1)
    data = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    moved = data[:9000] + b"inserted words" + data[9000:]

    def pieces(x):
        c = chunks.cuts(x)
        return {x[a:b] for a, b in zip([0, *c], c)}
    assert len(pieces(moved) - pieces(data)) < 12


def test_table_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.repeat_spans, r.shared_spans, r.first_ids) for r in
           entry.queries()["op8_chunks"](spark, SF).collect()}
    want = plain_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and any(a for a, _, _ in got.values())


def test_planted_passages(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passages = [prose(52) for _ in range(60)]
    rows = [(i, f"{prose(rng.randint(0, 90))} {passages[i % 60]} {prose(rng.randint(0, 90))}") for i in range(180)]
    rows += [(1000 + i, prose(150)) for i in range(60)]
    got = {r.doc_id: r for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i].repeat_chars > 0 and i % 60 in got[i].first_ids for i in range(60, 180)]) > 0.98
    assert np.mean([got[i].shared_chars > 0 for i in range(180)]) > 0.98
    assert all(got[1000 + i].shared_chars == 0 for i in range(60))


def test_odd_rows(spark):
    text = "a passage that is long enough to be cut into several chunks by the rolling hash, we hope, " * 3
    rows = [(3, text), (3, text), (None, text), (None, text), (1, None), (2, ""), (5, " "), (4, text + "é"), (9, "x" * 300_000)]
    docs = spark.createDataFrame([(d, t, "k", True) for d, t in rows], "doc_id long, text string, row_key string, head boolean")
    got = sorted(((r.doc_id or 99, r.repeat_chars > 0, r.first_ids, r.n_chars) for r in chunks.repeats(docs).collect()))
    n = len(text)
    assert got == [(1, False, [], 0), (2, False, [], 0), (3, False, [], n), (3, False, [], n), (4, True, [3], n + 1),
                   (5, False, [], 1), (9, False, [], 300_000), (99, True, [3], n), (99, True, [3], n)]
    assert chunks.repeats(docs.limit(0)).count() == 0
