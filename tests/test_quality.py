"""Quality score boundaries against an independent plain-Python formula."""

import itertools

from pyspark.sql import functions as F

from pagewise.functions import quality as Q


def py_quality(wc, sc, fre, h1, h2, imgs, no_alt, desc, canon, og, schema):
    depth = 30 if wc >= 2000 else 25 if wc >= 1000 else 20 if wc >= 500 else 15 if wc >= 300 else 8 if wc >= 100 else 3
    read = 20 if 50 <= fre <= 80 else 15 if 40 <= fre <= 90 else 10 if fre >= 30 else 5
    if fre > 90:
        read = 12
    struct = (8 if h1 == 1 else 4 if h1 > 1 else 0) + (8 if h2 >= 2 else 5 if h2 == 1 else 0) + (4 if sc >= 5 else 2)
    media = 8 + round(7 * ((imgs - no_alt) / imgs)) if imgs > 0 else 0
    seo = 5 * desc + 3 * canon + 4 * og + 3 * schema
    total = depth + read + struct + media + seo
    grade = "A+" if total >= 90 else "A" if total >= 80 else "B" if total >= 70 else "C" if total >= 60 else "D" if total >= 50 else "F"
    recs = []
    if wc < 100:
        recs.append("THIN_CONTENT")
    if wc < 300:
        recs.append("SHORT_CONTENT")
    if fre < 30:
        recs.append("HARD_TO_READ")
    if fre > 90:
        recs.append("TOO_SIMPLE")
    if h1 > 1:
        recs.append("MULTIPLE_H1")
    if h1 == 0:
        recs.append("MISSING_H1")
    if h2 == 0:
        recs.append("MISSING_H2")
    if imgs > 0 and no_alt > 0:
        recs.append(f"IMAGES_WITHOUT_ALT:{no_alt}")
    if imgs == 0:
        recs.append("NO_IMAGES")
    if not desc:
        recs.append("NO_META_DESCRIPTION")
    if not og:
        recs.append("NO_OPEN_GRAPH")
    if not schema:
        recs.append("NO_SCHEMA")
    return total, grade, recs[:8], dict(content_depth=depth, readability=read, structure=struct, media=media,
                                        seo_signals=seo)


def test_boundaries(spark):
    wcs = [99, 100, 299, 300, 499, 500, 999, 1000, 1999, 2000]
    fres = [29.9, 30.0, 39.9, 40.0, 49.9, 50.0, 80.0, 80.1, 90.0, 90.1]
    heads = [(0, 0), (1, 1), (2, 2)]
    sents = [4, 5]
    imgs = [(0, 0), (1, 0), (1, 1), (2, 1), (14, 9)]
    flags = [(False, False, False, False), (True, False, False, False), (False, True, False, False),
             (False, False, True, False), (False, False, False, True), (True, True, True, True)]
    rows = []
    for i, (wc, fre) in enumerate(zip(wcs, fres)):
        for j, ((h1, h2), sc, (ti, na), fl) in enumerate(itertools.product(heads, sents, imgs, flags)):
            if (i + j) % 3:
                continue
            rows.append((wc, sc, fre, h1, h2, ti, na, *fl))
    schema = ("wc BIGINT, sc BIGINT, fre DOUBLE, h1 INT, h2 INT, ti INT, na INT, "
              "d BOOLEAN, c BOOLEAN, o BOOLEAN, s BOOLEAN")
    df = spark.createDataFrame(rows, schema)
    cols = Q.quality_columns(*[F.col(c) for c in ("wc", "sc", "fre", "h1", "h2", "ti", "na", "d", "c", "o", "s")])
    out = df.select("*", *[v.alias(k) for k, v in cols.items()]).collect()
    assert len(out) == len(rows)
    for r in out:
        total, grade, recs, parts = py_quality(r.wc, r.sc, r.fre, r.h1, r.h2, r.ti, r.na, r.d, r.c, r.o, r.s)
        assert r.total_score == total and r.grade == grade and r.recommendations == recs
        assert sum(r[f"score_{k}"] for k in parts) == r.total_score
        for k, v in parts.items():
            assert r[f"score_{k}"] == v
