"""Containment search against the SQL form and by hand."""

import __spark_entry__ as entry
from tools.check_oracles import compare, duck

from pagewise.llm import decontaminate

SF = "/root/testdata/sf0.01"


def test_table_against_sql(spark):
    got = entry.queries()["op2_decontaminate"](spark, SF).toPandas()
    want = duck(SF).execute(entry.oracle_sql()["op2_decontaminate"]).df()
    assert len(want) > 0
    ok, msg = compare("op2", got, want)
    assert ok, msg


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_by_hand(spark):
    items = spark.createDataFrame([
        (1, words(0, 14)),  # 10 shingles, 8 needed
        (2, "Tiny item"), (3, None), (4, " \n"), (None, words(100, 120)), (5, words(300, 305))], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, words(500, 5000) + "\t" + words(0, 12).upper() + "\n" + words(6000, 9000), "a", "k"),  # 8 of 10
        (2, words(0, 11), "b", "k"),  # 7 of 10
        (3, "tiny\nITEM", "c", "k"), (4, "a tiny item", "c", "k"), (5, None, "d", "k"), (6, "", "d", "k"),
        (7, words(90, 130), None, "k"), (7, words(90, 130), None, "k"), (None, words(299, 310), None, None),
        (8, words(300, 304), "e", "k")], "doc_id long, text string, text_key string, item string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.n_shared, r.n_item) for r in
                  decontaminate.contained(docs, items).collect()))
    assert got == [(0, 5, 1, 1), (1, 1, 8, 10), (3, 2, 1, 1), (7, 0, 16, 16), (7, 0, 16, 16)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contained(none, items).count() == 0
    assert decontaminate.contained(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 1


def test_no_python_in_the_plan(spark):
    plan = entry.queries()["op2_decontaminate"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
