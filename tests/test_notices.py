import random
from datetime import date

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from noticeflow.operators import cursor, dedupe, notices, sizing
from noticeflow.plans.search import Kind, SearchParams, search_notices

COLUMNS = "id long, title string, content string, url string, publish_date string, source string, ingest_seq long"
ROWS = [
    (1, "货物公开招标公告", "北京", "u1", "2024-01-05 10:00:00", "s1", 1),
    (2, "工程中标结果", None, "u2", "2024-01-05 23:59:59", "s2", 2),
    (3, "服务竞争性谈判", "abc", "u3", "2024-1-5", "s1", 3),
    (4, "成交结果更正", "ABC", "u4", None, None, 4),
    (5, "询价", "100%", "u5", "2023-11-01", "s2", 5),
]


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search(a):
    assert ids(notices.search(a)) == [1, 2, 3, 4, 5]
    assert ids(notices.search(a, q="ABC")) == [3, 4]
    assert ids(notices.search(a, q="结果")) == [2, 4]
    assert ids(notices.search(a, q="0%")) == [5]
    assert ids(notices.search(a, province="北京", goods="goods")) == [1]
    assert ids(notices.search(a, start="2024-01-01", end="2024-01-05")) == [1, 2]      # text order
    assert ids(notices.search(a, kind="1")) == [1] and ids(notices.search(a, kind="7")) == [2, 4]
    assert ids(notices.search(a, kind="9", source="s2")) == [2, 5]


def test_gate_and_age(a):
    assert ids(a.filter(notices.title_gate())) == [2]
    assert ids(a.filter(notices.not_older("2024-02-04 00:00:00"))) == [1, 2, 3, 4]
    assert ids(a.filter(notices.not_older("2024-02-05 00:00:00"))) == [4]


def test_page_and_counts(a):
    assert [r.id for r in notices.page(a, 2, 1).collect()] == [2, 1]
    assert notices.page(a).columns == ["id", "title", "url", "publish_date", "source"]
    assert notices.total(a).first().total == 5
    assert {(r.source, r["count"]) for r in notices.count_by_source(a).collect()} == {("s1", 2), ("s2", 2), (None, 1)}
    assert {(r.day, r["count"]) for r in notices.count_by_day(a).collect()} == {
        ("2024-01-05", 2), ("2024-1-5", 1), ("Unknown", 1), ("2023-11-01", 1)}
    assert {(r.province, r["count"]) for r in notices.count_by_province(a).collect()} == {("北京", 1), ("其他", 4)}


def test_newest_and_lookup(a):
    assert [r.id for r in notices.newest(a, 2).collect()] == [5, 4]
    assert [r.id for r in notices.newest(a, 5, source="s1").collect()] == [3, 1]
    assert notices.by_key(a, url="u3").first().id == 3


def test_capped_per_source(spark):
    df = spark.createDataFrame([("s", i) for i in range(300)] + [("t", 7)], "source string, item_pos int")
    got = notices.capped_per_source(df.repartition(7)).collect()
    assert got and set(got[0].asDict()) == {"source", "item_pos"}
    assert len(got) == 251 and max(r.item_pos for r in got if r.source == "s") == 249


def test_keywords(a):
    hits = notices.keyword_hits(a, ["结果", "中标", "招标"])
    assert {(r.id, r.keyword, r.kw_pos) for r in hits.collect()} == {(1, "招标", 2), (2, "结果", 0), (4, "结果", 0)}
    every = notices.keyword_hits(a, ["结果", "中标"], all_hits=True)
    assert {(r.id, r.keyword, r.is_first) for r in every.collect()} == {
        (2, "结果", True), (2, "中标", False), (4, "结果", True)}


def test_search_params(a):
    typed = a.withColumn("publish_day", F.to_date(F.lit("2024-01-05")))
    assert ids(search_notices(typed, SearchParams("结果", time_type="today"), date(2024, 1, 5))) == [2, 4]
    assert ids(search_notices(typed, SearchParams("", time_type="3days"), "2024-01-08")) == []
    assert ids(search_notices(typed, SearchParams("", time_type="1", bid_type="成交公告"), "2024-01-07")) == [4]
    assert ids(search_notices(typed, SearchParams("abc", search_type="title", time_type="1month"), "2024-02-05")) == []
    custom = SearchParams("", time_type="custom", start_date="2024:01:05", end_date="2024-01-05", pin_mu=2)
    assert ids(search_notices(typed, custom, "2020-01-01")) == [2]
    for bad in (SearchParams("x", time_type="custom"), SearchParams("x", bid_type="nope"), SearchParams("x", pin_mu=" "),
                SearchParams("x", bid_type=99), SearchParams("x", time_type="7"), SearchParams("x", search_type=3)):
        with pytest.raises(ValueError):
            bad.predicate("2024-01-01")
    assert Kind.of("11") is Kind.of(11) is Kind.of("成交公告") is Kind.DEAL
    other = a.filter(Kind.of("其他公告").holds())
    assert set(ids(other)).isdisjoint(i for k in range(1, 13) if k != 9 for i in ids(a.filter(Kind.of(k).holds())))


# ------------------------------------------------------------------- dedupe

def test_dedupe_first_and_insert_or_ignore(spark):
    new = spark.createDataFrame([("u1", "b", 2), ("u1", "a", 1), ("u2", "c", 3), (None, "d", 4), (None, "e", 5)],
                                "url string, x string, seq long")
    assert sorted(r.x for r in dedupe.dedupe_first(new, ["url"], "seq").collect()) == ["a", "c", "d"]
    old = spark.createDataFrame([("u2",)], "url string")
    first = dedupe.insert_or_ignore(old, new.filter("url is not null"), ["url"], "seq")
    assert [r.x for r in first.collect()] == ["a"]
    again = dedupe.insert_or_ignore(old.union(first.select("url")), new.filter("url is not null"), ["url"], "seq")
    assert again.count() == 0


def test_unseen(spark):
    both = spark.createDataFrame([("b", 5), ("b", 4), ("d", 6), ("d", 7)], "url string, x int")
    old = spark.createDataFrame([("b",)], "url string")
    assert [r.x for r in dedupe.insert_or_ignore(old, both, ["url"], "x").collect()] == [6]
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "url string, x int")
    stored = spark.createDataFrame([("b",), ("b",), ("z",)], "url string")
    assert sorted(r.x for r in dedupe.unseen(df, stored, ["url"]).collect()) == [1, 4]


def keep(rows):
    titles, urls, out = set(), set(), []
    for seq, t, u in rows:
        if t not in titles and u not in urls:
            titles.add(t)
            urls.add(u)
            out.append(seq)
    return out


def chain(n):
    """Each row shares its title with one neighbour and its url with the other."""
    return [(i, f"t{(i + 1) // 2}", f"u{i // 2}") for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_either_equals_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abcdefgh") if rng.random() < .9 else "", str(rng.randint(0, 8))) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, title string, url string")
    assert sorted(r.seq for r in dedupe.dedupe_either(df, "seq").collect()) == keep(rows)


def test_dedupe_either_on_a_chain(spark):
    rows = chain(16)
    df = spark.createDataFrame(rows, "seq long, title string, url string")
    assert sorted(r.seq for r in dedupe.dedupe_either(df, "seq").collect()) == keep(rows)
    with pytest.raises(RuntimeError):
        dedupe.dedupe_either(df, "seq", max_rounds=2)


def test_a_long_chain_takes_few_rounds(spark):
    rows = chain(3000)
    df = spark.createDataFrame(rows, "seq long, title string, url string")
    assert sorted(r.seq for r in dedupe.dedupe_either(df, "seq", max_rounds=3).collect()) == list(range(0, 3000, 2))


@pytest.mark.parametrize("seed", range(3))
def test_chains_that_meet_equal_the_loop(spark, seed):
    """Sparse graphs: long chains, forks and rings in any order."""
    rng = random.Random(seed)
    order = rng.sample(range(300), 300)
    rows = sorted((o, f"t{(i + 1) // 2}" if rng.random() < .95 else f"t{rng.randint(0, 150)}", f"u{i // 2}") for i, o in enumerate(order))
    rows += [(300 + i, t, "u" + str(i)) for i, (_, t, _) in enumerate(rows[::7])]
    df = spark.createDataFrame(rows, "seq long, title string, url string")
    assert sorted(r.seq for r in dedupe.dedupe_either(df, "seq").collect()) == keep(rows)


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_pages_behind_cursors_equal_the_whole_order(spark, limit):
    rows = [(i, f"t{i}", f"u{i // 3}", None if i % 5 == 0 else f"2024-01-0{i % 4 + 1}", "s") for i in range(20)]
    rows += [(99, "x", None, None, "s"), (98, "y", None, "2024-01-01", "s")]
    a = spark.createDataFrame(rows, "id long, title string, url string, publish_date string, source string")
    got, at = [], None
    while part := notices.page_after(a, at, limit).collect():
        got += [r.id for r in part]
        at = cursor.cursor_of(part[-1], notices.PAGE_ORDER)
    assert got == [r.id for r in a.orderBy(*cursor.ordering(notices.PAGE_ORDER)).collect()] and len(got) == 22
    with pytest.raises(ValueError):
        notices.page_after(a, ("x",))


def test_a_cursor_reaches_the_scan(spark, tmp_path):
    a = spark.createDataFrame([(1, "t", "u", "2024-01-01", "s")], "id long, title string, url string, publish_date string, source string")
    a.write.parquet(str(tmp_path / "a"))
    text = plan_of(notices.page_after(spark.read.parquet(str(tmp_path / "a")), ("2024-01-02", "u", 5)))
    assert "TakeOrderedAndProject" in text and "LessThan(publish_date,2024-01-02)" in text


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "x int, y string")
    assert dedupe.distinct_rows(df, ["x", "z"]).count() == 1
