from datetime import datetime as dt

from paperloom.llm import url_filter as uf

CAPTURES = [
    (1, "https://a.example.com/en/1", dt(2024, 1, 5)), (2, "https://a.example.com/en/1", dt(2024, 1, 15)),
    (3, "http://user:pw@WWW.A.example.com.:80/fr?x", dt(2024, 1, 15)), (4, "https://b.example.com/", dt(2024, 1, 15)),
    (5, None, dt(2024, 1, 15)), (6, "not a url", dt(2024, 1, 15)), (7, "https://a.example.com/", None),
    (8, "https://a.example.com/x", dt(2024, 1, 10)), (9, "https://a.example.com/x", dt(2024, 1, 20)), (9, "https://a.example.com/x", dt(2024, 1, 20)),
    (10, "https://tie.org/", dt(2024, 1, 2)),
]
ENTRIES = [
    ("a.example.com", "block", dt(2024, 1, 10)), ("a.example.com", "remove", dt(2024, 1, 20)), ("a.example.com/en", "allow", dt(2024, 1, 12)),
    ("example.com", "block", dt(2024, 1, 14)), ("example.com", "allow", dt(2024, 1, 16)), (None, "block", dt(2024, 1, 1)),
    ("b.example.com", "block", None), ("b.example.com", "odd", dt(2024, 1, 1)), ("tie.org", "allow", dt(2024, 1, 1)), ("tie.org", "block", dt(2024, 1, 1)),
]


def judged(spark, captures=CAPTURES, entries=ENTRIES):
    c = spark.createDataFrame([(*r, "clash") for r in captures], "page_id long, url string, fetched_at timestamp, pattern string")
    e = spark.createDataFrame([(*r, 0) for r in entries], "pattern string, action string, listed_at timestamp, url int")
    return uf.judge(c, e).collect()


def test_verdicts(spark):
    rows = judged(spark)
    assert len(rows) == len(CAPTURES)
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in rows}
    assert got == {
        1: ("allow", None), 2: ("allow", "a.example.com/en"), 3: ("block", "a.example.com"), 4: ("block", "example.com"),
        5: ("allow", None), 6: ("allow", None), 7: ("allow", None), 8: ("block", "a.example.com"), 9: ("allow", "example.com"),
        10: ("allow", "tie.org"),
    }


def test_empty_tables(spark):
    assert judged(spark, captures=[]) == []
    assert {r["verdict"] for r in judged(spark, entries=[])} == {"allow"}


def test_plan_has_no_python(spark):
    c = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame(ENTRIES, "pattern string, action string, listed_at timestamp")
    plan = uf.judge(c, e)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
