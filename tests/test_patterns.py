"""Pattern table: required literals by hand, hits against trying every pattern."""

import random
import re

from pyspark.sql import functions as F

from pagewise.operators import patterns as PT

LITERALS = {r"\.net/": ".net/", "utm_source=": "utm_source=", "ab?cd": "cd", "ab*": "a", "ab+cde": "cde", "a{2}bc": "bc", "(abc)": "",
            "abc|def": "", "x[abc]def": "def", r"\d+abc": "abc", r"a\.b.c": "a.b", "^start$": "start", r"\x41bc": "", "[|(]long": "long",
            r"a\|bc": "a|bc", "ABC": "abc", "[0-9]+": "", r"foo\[bar": "foo[bar", "colou??rs": "colo", r"a\\b": "a\\b", "": ""}


def test_required_literals(spark):
    df = spark.createDataFrame([(p,) for p in LITERALS], "p string")
    got = {r.p: r.x for r in df.select("p", PT.required_literal(F.col("p")).alias("x")).collect()}
    assert got == LITERALS


def test_hits_against_every_pattern(spark):
    rng = random.Random(2)
    urls = ["http://" + "".join(rng.choice("ab.c/x?=1A") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None, "short"]
    patterns = [re.escape("".join(rng.choice("ab.c/x") for _ in range(rng.randint(1, 5)))) for _ in range(150)]
    patterns += ["a.b", "ab?c", "[ab]{3}", "(a|b)c/", "x=1", " a/b ", "  ", "^http://a", "1$", "http", "A{2,}", r"\.c\b"]
    got = {tuple(r) for r in PT.pattern_hits(spark.createDataFrame([(u,) for u in urls], "url string"),
                                             spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    want = {(u, p.strip()) for u in urls if u is not None for p in patterns if p.strip() and re.search(p.strip(), u, re.I)}
    assert got == want and len(want) > 500
