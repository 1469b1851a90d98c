from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeflow.operators.contacts import contacts_in_text
from noticeflow.schema import ANNOUNCEMENTS, CARDS, CONTACTS, MENTIONS
from noticeflow.sources import exports, keywords, pages, search_json
from noticeflow.sources.state import State

T1 = datetime(2024, 1, 1)


def test_read_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.htm").write_text("<p>甲\n乙</p>", encoding="utf-8")
    for fmt in ("text", "binary"):
        row = pages.read_pages(spark, str(tmp_path / "in"), fmt).first()
        assert row.html == "<p>甲\n乙</p>" and row.url.endswith("a.htm")
    spark.createDataFrame([("u", "h")], "url string, html string").write.parquet(str(tmp_path / "p"))
    assert tuple(pages.read_pages(spark, str(tmp_path / "p")).first()) == ("u", "h")
    with pytest.raises(ValueError):
        pages.read_pages(spark, "x", "pdf")


def test_spread_leaves_many_files_alone(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(8).repartition(8).write.parquet(path)
    many = spark.read.parquet(path)
    assert pages.spread(many) is many
    spark.range(8).coalesce(1).write.parquet(path + "1")
    assert pages.spread(spark.read.parquet(path + "1")).rdd.getNumPartitions() == 4


def test_search_json(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{\n"data": [{"title": "甲", "url": "u", "publishDate": "d", "x": 1}, {"url": "v"}]}',
                                      encoding="utf-8")
    (tmp_path / "r2.json").write_text('{"data": {"title": "no list"}}')
    (tmp_path / "r3.json").write_text('{"error": 1}')
    rows = search_json.read_search_json(spark, str(tmp_path)).collect()
    assert sorted((r.title, r.url, r.publish_date) for r in rows) == [("", "v", ""), ("甲", "u", "d")]
    df = spark.createDataFrame([('{"data": [{"title": "t"}]}',), ("oops",), (None,)], "body string")
    assert [tuple(r)[:3] for r in search_json.parse_search_json(df, "body").collect()] == [("t", "", "")]


def test_keywords(spark, tmp_path):
    path = tmp_path / "kw.txt"
    path.write_text("  # 说明,不要\n智能， 机房 ,\n\n智能,云#x\r\n数据\n", encoding="utf-8")
    got = [r.keyword for r in keywords.read_keywords(spark, ["机房,安防", " "], str(path)).collect()]
    assert got == ["机房", "安防", "智能", "云#x", "数据"]
    assert [r.keyword for r in keywords.read_keywords(spark, ["b", "a"]).collect()] == ["b", "a"]


def test_uploaded_keywords(values):
    assert values(keywords.uploaded_keywords, ["a,b；a\r\n#c\n d ;;，", ""]) == [["a", "b", "a", "d"], []]


def test_keyword_set(spark, tmp_path):
    path = str(tmp_path / "set")
    empty = keywords.load_keyword_set(spark, path).first()
    assert (empty.keywords, empty.filename) == ([], None)
    assert keywords.save_keyword_set(spark, path, ["甲", "乙"], "f.txt") == 2
    keywords.save_keyword_set(spark, path, ["丙"])
    row = keywords.load_keyword_set(spark, path).first()
    assert (row.keywords, row.filename) == (["丙"], None)


def note(i, title="t", content="c", date="2024-01-05 10:00", source="s"):
    return (i, title, f"u{i}", content, date, None, source, T1, T1, i)


def test_state_shows_committed_batches_only(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    assert state.committed() == -1 and state.announcements().count() == 0 and state.cards().count() == 0
    state.stage("announcements", 0, spark.createDataFrame([note(1)], ANNOUNCEMENTS))
    state.stage("mentions", 0, spark.createDataFrame([], MENTIONS))
    assert state.announcements().count() == 0
    state.commit(0)
    # A batch that died half-way leaves files nobody reads; its next run replaces them.
    state.stage("announcements", 1, spark.createDataFrame([note(2), note(3)], ANNOUNCEMENTS))
    assert [r.id for r in state.announcements().collect()] == [1] and state.committed() == 0
    state.stage("announcements", 1, spark.createDataFrame([note(4)], ANNOUNCEMENTS))
    state.commit(1)
    assert sorted(r.id for r in state.announcements().collect()) == [1, 4]


def test_append_contacts(spark, tmp_path):
    state = State(spark, str(tmp_path))
    found = contacts_in_text(spark.createDataFrame([(7, "联系人：李雷 电话：010-12345678 a@b.cn")], "id long, t string"),
                             "t", "id")
    state.append_contacts(0, found)
    assert state.contacts().count() == 0
    state.commit(0)
    assert [tuple(r) for r in state.contacts().collect()] == [(7, "", "李雷", "010-12345678", "a@b.cn")]


@pytest.mark.parametrize("every", [1, 2, 3, 100])
def test_cards_do_not_depend_on_when_the_table_is_rewritten(spark, tmp_path, every):
    state = State(spark, str(tmp_path))
    for n, rows in enumerate([[card("甲", ["1"], 1)], [card("甲", ["2"], 2), card("乙", [], 2)], [card("乙", ["3"], 3)],
                              [card("甲", ["1"], 4)]]):
        state.commit(n, state.add_cards(n, spark.createDataFrame(rows, CARDS), state.view(), every))
        # Changes of a batch that is not committed are not seen.
        state.add_cards(n + 1, spark.createDataFrame([card("丙", ["9"], 9)], CARDS), state.view(), every)
    got = sorted((r.company, r.phones, r.created_at.day, r.updated_at.day) for r in state.cards().collect())
    assert got == [("乙", ["3"], 2, 3), ("甲", ["1", "2"], 1, 4)]


def card(company, phones, day):
    return (None, company, "李", phones, [], datetime(2024, 1, day), datetime(2024, 1, day))


# ------------------------------------------------------------------ exports

def csv(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def test_export_announcements_and_contacts(spark, tmp_path):
    a = spark.createDataFrame([note(1, 'a "q", b\nc')], ANNOUNCEMENTS)
    assert exports.export_announcements(a, str(tmp_path / "a"))
    row = csv(spark, str(tmp_path / "a")).first()
    assert row.asDict().keys() == {"title", "url", "publish_date", "source", "scraped_at"}
    assert row.title == 'a "q", b\nc'
    assert not exports.export_announcements(a.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    k = spark.createDataFrame([(1, "甲", "李", "1", ""), (2, "甲", "李", "1", "")], CONTACTS)
    assert exports.export_contacts(k, str(tmp_path / "k"), "parquet")
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1


def test_csv_files_open_with_the_mark_and_come_back_whole(spark, tmp_path):
    texts = ["plain", ' spaced ', 'a "q", b', "two\nlines", "a\r\nb", "c\rd", "", None, "\\", '"', ",", "\t北京"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "`标题` string, n int").repartition(3)
    exports.write(df, str(tmp_path / "c"))
    files = sorted((tmp_path / "c").glob("part-*"))
    assert len(files) == 3
    for f in files:
        assert f.read_bytes().startswith("\ufeff标题,n\n".encode())
    back = exports.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["标题", "n"]
    assert [r["标题"] for r in back.orderBy(F.col("n").cast("int")).collect()] == texts
    exports.write(df.withColumn("day", F.lit("d")).select("day", "标题", "n"), str(tmp_path / "by"), by="day")
    part, = {f.read_bytes()[:3] for f in (tmp_path / "by" / "day=d").glob("part-*")}
    assert part == b"\xef\xbb\xbf"


def test_export_all(spark, tmp_path):
    a = spark.createDataFrame([note(1), note(2, source="t")], ANNOUNCEMENTS)
    k = spark.createDataFrame([(1, "甲", "李", "1", ""), (2, "", "王", "2", "")], CONTACTS).withColumn("ingest_seq", F.lit(1))
    exports.export_all(a, k, str(tmp_path / "csv"))
    assert {p.name for p in (tmp_path / "csv" / "summary").iterdir()} == {"总览"}
    exports.export_all(a, k, str(tmp_path / "pq"), "parquet")
    assert {p.name for p in (tmp_path / "pq" / "summary").iterdir()} == {"总览", "按数据源", "热门公司"}
    totals = csv(spark, str(tmp_path / "csv" / "summary" / "总览")).collect()
    assert {tuple(r) for r in totals} == {("公告总数", "2"), ("联系人总数", "2")}


def test_export_notices(spark, tmp_path):
    a = spark.createDataFrame([note(1, "北京甲"), note(2, "乙", "x" * 32_001, "2024-02-01"), note(3, "丙", None, "")],
                              ANNOUNCEMENTS)
    exports.export_notices(a, str(tmp_path / "all"), include_details=True, fmt="parquet")
    rows = spark.read.parquet(str(tmp_path / "all")).collect()
    assert [r["标题"] for r in rows] == ["乙", "北京甲", "丙"]
    assert rows[0]["详情"] == "x" * 32_000 + "..." and rows[2]["详情"] == ""
    exports.export_notices(a, str(tmp_path / "prov"), split="province")
    assert {p.name for p in (tmp_path / "prov").iterdir() if p.is_dir()} == {"province=北京", "province=其他"}
    exports.export_notices(a, str(tmp_path / "day"), split="day", include_details=True)
    assert {p.name for p in (tmp_path / "day").iterdir() if p.is_dir()} == {
        "day=2024-01-05", "day=2024-02-01", "day=Unknown"}
    with pytest.raises(ValueError):
        exports.export_notices(a.limit(0), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        exports.export_notices(a, str(tmp_path / "x"), split="month")


def test_export_cards(spark, tmp_path):
    c = spark.createDataFrame([(1, "甲", "李", ["1", "2"], ["a@b"], T1, T1)], CARDS)
    m = spark.createDataFrame([(1, 5, "buyer")], MENTIONS)
    exports.export_cards(c, m, str(tmp_path / "c"))
    row = csv(spark, str(tmp_path / "c")).first()
    assert (row["公司名称"], row["电话"], row["邮箱"], row["关联项目数"]) == ("甲", "1, 2", "a@b", "1")
    assert len(row) == 7
