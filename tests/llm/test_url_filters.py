from datetime import datetime

from noticeflow.llm import url_filters

DAY = lambda m, d=1: datetime(2024, m, d)


def test_as_of(spark):
    entries = spark.createDataFrame([
        ("domain", "bad.example", "add", DAY(2)), ("domain", "bad.example", "add", DAY(3)),
        ("domain", "bad.example", "remove", DAY(6)), ("domain", "bad.example", "add", DAY(11)),
        ("domain", "bad.example", "remove", DAY(11)), ("prefix", "ok.example/x/y", "add", DAY(1)),
        ("domain", "gone.example", "remove", DAY(1)), ("domain", None, "add", DAY(1)), ("domain", "n.example", "add", None)],
        "kind string, pattern string, action string, listed_at timestamp")
    rows = [(1, "http://a.Bad.example:80/p?q#f", DAY(1, 31)), (2, "http://a.Bad.example:80/p?q#f", DAY(2)),
            (3, "https://u@bad.example", DAY(5, 31)), (4, "https://bad.example/", DAY(6)), (5, "ftp://bad.example./", DAY(12)),
            (6, "http://notbad.example/", DAY(3)), (7, "http://ok.example/x/y/z", DAY(4)), (8, "http://ok.example/x/yy", DAY(4)),
            (9, None, DAY(4)), (10, "no url", DAY(4)), (11, "http://bad.example", None), (12, "http://gone.example", DAY(5)),
            (2, "http://a.Bad.example:80/p?q#f", DAY(2))]
    captures = spark.createDataFrame([(*r, "k") for r in rows],
                                     "page_id long, url string, fetched_at timestamp, kind string")
    got = url_filters.active(captures, entries).collect()
    assert len(got) == len(rows)
    assert {r["page_id"] for r in got if r["rules"]} == {2, 3, 5, 7}
    assert [tuple(x) for x in next(r for r in got if r["page_id"] == 7)["rules"]] == [("prefix", "ok.example/x/y")]


def test_plan_is_native_and_joins_by_key(spark):
    entries = spark.createDataFrame([("domain", "a.b", "add", DAY(1))],
                                    "kind string, pattern string, action string, listed_at timestamp")
    captures = spark.createDataFrame([(1, "http://a.b/", DAY(2))], "page_id long, url string, fetched_at timestamp")
    plan = url_filters.active(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    none = url_filters.active(captures, entries.where("false")).collect()
    assert [r["rules"] for r in none] == [[]]
    assert url_filters.active(captures.where("false"), entries).collect() == []
