"""WARC round trip against SQL, and lookups by hand."""

import base64
import hashlib

import __spark_entry__ as entry
from tools.check_oracles import compare, duck

from pagewise.llm import warc

SF = "/root/testdata/sf0.01"


def test_table_against_sql(spark):
    got = entry.queries()["op9_warc"](spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = duck(SF).execute(entry.oracle_sql()["op9_warc"]).df()
    ok, msg = compare("op9", got.toPandas(), want)
    assert ok, msg


def test_records():
    body = "é <html>\r\n\r\n".encode()
    fields, payload = warc.parse(warc.record(7, "http://a.b/x y\r\nEvil: 1", body, "D", None, False))
    assert payload == body and fields["WARC-Type"] == "response" and "Evil" not in fields
    fields, payload = warc.parse(warc.record(-3, None, body, "D", 9, True))
    assert payload == b"" and warc._page_of(fields["WARC-Refers-To"]) == 9 and warc._page_of(fields["WARC-Record-ID"]) == -3


def test_keys():
    assert warc.url_key("HTTP://User@WWW.Example.COM:8080/A?b=1#c") == "com,example,www:8080)/A?b=1"
    assert warc.url_key("https://example.org") == "org,example)/"
    assert warc.url_key(None) == "" and " " not in warc.url_key("not a url\n")


ODD = [(1, "http://a.com/1", "same", "x"), (2, "http://a.com/2", "same", None), (3, "http://b.com/", None, "x"),
       (4, None, "", "x"), (4, None, "", "x"), (None, "http://a.com/1", "same", "x"), (None, "http://c.d/", "lone", "x"),
       (6, "http://a.com/1", "ü" * 300_000, "x"), (-5, "http://a.com/\n weird", "one", "x")]


def test_odd_rows(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string, sha string")
    tops = {}
    for i, _, h, _ in ODD:
        if i is not None:
            tops[h or ""] = max(i, tops.get(h or "", i))
    want = []
    for i, _, h, _ in ODD:
        body, top = (h or "").encode(), tops.get(h or "")
        revisit = top is not None and i != top
        want.append((i is None, i or 0, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "revisit" if revisit else "response", top if revisit else None))
    for options in ({}, {"block_lines": 2, "file_bytes": 100}):
        got = [(r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
               for r in warc.round_trip(spark, pages, **options).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_lookup_of_single_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    held = warc.archive(spark, pages, block_lines=7)
    some = pages.where("page_id % 50 = 3").collect()
    keys = spark.createDataFrame([(warc.url_key(r.url), r.page_id) for r in some] + [("zz)/none", 1), ("", 0)],
                                 "surt string, place long")
    assert sorted(r.page_id for r in warc.lookup(held, keys, read_ahead=0).collect()) == sorted(r.page_id for r in some)
