"""Personal data: patterns against direct matching, disclosures against plain counts."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import __spark_entry__ as entry

from pagewise.llm import pii

SF = "/root/testdata/sf0.001"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_patterns_against_direct_matching():
    rng = random.Random(3)
    for alphabet in ("a.@-_1", "0123. 5", "0 1-2+()", "4111 -+.@éx\n", "+1 (5).-2"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text
            assert re.search(pii.MAYBE, text) or not plain_spans(text)
    for text in ("4111 1111-1111 1111", "x 4111111111111111y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (132) 555-1352",
                 "000255.1.2.3", "ü.34@mail7.example.com"):
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    t = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 400_000, "a@" * 200_000, "+1" * 200_000,
                 "+" + "1 " * 200_000, "a@a." * 100_000, "1 " * 200_000):
        pii.base_spans(text)
    assert time.time() - t < 20


def plain_disclosures(texts):
    total, df_t, df_c, df_e, te, ce = len(texts), Counter(), Counter(), Counter(), Counter(), Counter()
    for text in texts:
        spans = plain_spans(text)
        words = {w.strip(pii.EDGES) for w in (text or "").lower().split()} - {""}
        df_t.update(words)
        df_c.update({w[:3] for w in words})
        df_e.update({f"{pii.KINDS[k]}:{text[s:e].lower()}" for k, s, e in spans})
        near = set()
        tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text or "")]
        tokens = [(a, b, w) for a, b, w in tokens if not any(a < e and s < b for _, s, e in spans)]
        tokens = [(a + len(w) - len(w.lstrip(pii.EDGES)), w.strip(pii.EDGES).lower()) for a, b, w in tokens
                  if w.strip(pii.EDGES)]
        for k, s, e in spans:
            ent = f"{pii.KINDS[k]}:{text[s:e].lower()}"
            for _, w in [x for x in tokens if x[0] < s][-8:] + [x for x in tokens if x[0] >= e][:8]:
                near.add((ent, w))
        te.update(near)
        ce.update({(e, w[:3]) for e, w in near})

    def value(n, t, e):
        return math.log2(total * n / (t * e)) / math.log2(total / e) if e < total else 0.0
    out = {}
    for (e, w), n in te.items():
        if n >= 3 and value(n, df_t[w], df_e[e]) >= 0.8:
            c = value(ce[e, w[:3]], df_c[w[:3]], df_e[e])
            out[e, w] = "generalised" if c < 0.8 and len(w) > 3 else "removed"
    return out


def scanned(spark, docs):
    rows = docs.selectExpr("doc_id", "xxhash64(text) k", "text")
    return rows.mapInArrow(pii._scan(8, 3), pii._SCAN_DDL)


def test_corpus_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = [(10_000 + i, f"the river {w} stood by jane.roe@corp.example ask zanzibar{'abc'[i % 3]} x{i} now")
            for i, w in enumerate(["quokka", "quokka", "quokka", "quokka", "the", "and"])]
    made += [(11_000 + i, f"zanzibarian {i}") for i in range(6)]
    docs = docs.unionByName(spark.createDataFrame(made, docs.schema)).repartition(3)
    want = plain_disclosures([r.text for r in docs.collect()])
    got = {(r.entity, r.term): r.action for r in pii.disclosures(scanned(spark, docs).cache()).collect()}
    assert got == want
    assert got["email:jane.roe@corp.example", "quokka"] == "removed"
    rows = {r.doc_id: r for r in pii.inspect(docs).collect()}
    assert "removed:10:16" in rows[10_000].spans and rows[10_000].n_removed >= 1
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "quokka" not in clean[10_000] and "jane.roe" not in clean[10_000] and "[EMAIL]" in clean[10_000]


def test_query_columns(spark):
    got = entry.queries()["op1_pii"](spark, SF)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in range(4)]


def test_odd_rows(spark):
    rows = [(1, None, "a", None), (2, "", "a", 0), (None, "mail a.b@c.de", "a", 1), (3, "x " * 100_000 + "1.2.3.4", "b", 9),
            (4, "same a@b.cd", "b", 7), (4, "same a@b.cd", "b", 7), (5, "plain words", "c", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    out = pii.inspect(docs).collect()
    assert sorted((r.doc_id or 0, r.base) for r in out) == [
        (0, "email:5:13"), (1, ""), (2, ""), (3, "ip:200000:200007"), (4, "email:5:11"), (4, "email:5:11"), (5, "")]
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in clean.collect() if r.doc_id not in (1, 3)) == [
        (0, "mail [EMAIL]", 12), (2, "", 0), (4, "same [EMAIL]", 12), (4, "same [EMAIL]", 12), (5, "plain words", 11)]
    assert pii.inspect(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_groups_and_whole_documents(spark):
    """No value is in two documents; the terms stand far from the mention."""
    far = " and the river ran on" * 4
    rows = [(i, f"quokka{far} write to p{i}@corp.example now{far} zanzibar") for i in range(5)]
    rows += [(10 + i, f"wombat{far} host 10.7.3.{i} is up") for i in range(4)]
    rows += [(20 + i, f"plain prose{far} number {i} zan{i} wom{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.entity, r.term) for r in pii.wide_disclosures(scanned(spark, docs).cache()).collect()}
    total, texts = len(rows), dict(rows)
    want, held = set(), {}
    for d, text in rows:
        for e in {pii.entity_of(text, s) for s in plain_spans(text)}:
            for g in {e, *pii.groups_of(e)}:
                held.setdefault(g, set()).add(d)
    holds = {}
    for d, text in rows:
        for _, _, w in pii.outside(text, plain_spans(text)):
            holds.setdefault(w, set()).add(d)
    df_t = Counter(w for _, text in rows for w in pii.terms(text))
    for g, ds in held.items():
        for w, ws in holds.items():
            n = len(ds & ws)
            if n >= 3 and math.log2(total * n / (df_t[w] * len(ds))) >= 0.8 * math.log2(total / len(ds)):
                want.add((g, w))
    assert found == want
    assert {("domain:corp.example", "quokka"), ("kind:email", "zanzibar"), ("net:10.7.3", "wombat")} <= found
    assert not {w for _, w in found} & {"river", "prose"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i in range(5):
        assert "quokka" not in clean[i] and "zanzibar" not in clean[i] and "river" in clean[i]
    assert all("wombat" not in clean[10 + i] for i in range(4))
    assert all(clean[d] == texts[d] for d in texts if d >= 20)
