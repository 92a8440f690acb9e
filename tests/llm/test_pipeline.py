"""The pipeline against a plain version of its stages."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pagewise.llm import langid, mixing, pii
from pagewise.llm.common import is_held_out
from test_mixing import check, simulate
from test_pii import plain_disclosures, plain_spans
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def grams(text):
    words = text.lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_clean(text, actions):
    spans = plain_spans(text)
    marks = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans]
    extra = {}
    for (entity, term), places in (pii.near_terms(text, spans) if spans else {}).items():
        for place in places if (entity, term) in actions else ():
            extra[place] = max(extra.get(place, ""), actions[entity, term])
    marks += [f"{a}:{s}:{e}" for (s, e), a in extra.items()]
    return pii.cleaned(text, ",".join(marks)) if marks else text


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = langid.fit(docs, ~is_held_out(F.col("doc_id"), 4, 2))
    names, share = langid.identify(model, [r.text for r in rows], {}, [])
    rows = [r for r, n, s in zip(rows, names, share) if n != "und" and s >= langid.MIN_SHARE]
    roots = {d: c for _, d, _, c in plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])}
    rows = [r for r in rows if roots[r.doc_id] == r.doc_id]
    items = [g for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (g := grams(r.text))]
    rows = [r for r in rows if not any(10 * len(g & grams(r.text)) >= 8 * len(g) for g in items)]
    actions = plain_disclosures([r.text for r in rows])
    want = {r.doc_id: plain_clean(r.text, actions) for r in rows}

    out = entry.queries()["pipeline"](spark, SF).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert len(out) == len(want) < docs.count()
    assert all(r.n_chars == len(r.text) for r in out if r.text != {x.doc_id: x.text for x in rows}[r.doc_id])
    counts = Counter(r.source for r in out)
    blocks = {s: -(-n // mixing.BLOCK_ROWS) for s, n in counts.items()}
    assert check(out, mixing.BLOCK_ROWS) == simulate(blocks, mixing.tempered_units(counts))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "sanitisation", "mixture"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, SF)
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
