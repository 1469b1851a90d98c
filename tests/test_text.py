from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from noticeflow.functions import chars, text


def test_strip_knows_unicode_spaces(values):
    assert values(chars.strip, ["　 a b\x1c", " \t\n", None]) == ["a b", "", None]


def test_clean_title(values):
    long = "字" * 501
    got = values(text.clean_title, [None, "", " a　\n b\x7fc ", "字" * 500, long])
    assert got == ["未知标题", "未知标题", "a bc", "字" * 500, "字" * 500 + "..."]


def test_clean_title_twice_changes_nothing(values):
    once = values(text.clean_title, ["  x 　 y ", "", "a\x00b"])
    assert values(text.clean_title, once) == once


def test_clean_url(values):
    assert values(text.clean_url, [None, " //h/x ", "http://h/x", "　/x"]) == [
        "", "http://h/x", "http://h/x", "/x"]


def test_clean_content(values):
    got = values(text.clean_content, [None, "a\n \n　\nb   c ", "x" * 50_001, "x" * 50_000])
    assert got == ["", "a\n\nb c", "x" * 50_000 + "\n...(内容过长，已截断)", "x" * 50_000]


def test_clean_date(values):
    dates = [None, "2024年1月5日", "2024.01.05 10:00:00", " 2024/1/5 ", "soon"]
    assert values(text.clean_date, dates) == ["", "2024-1-5", "2024-01-05 10:00:00", "2024-1-5", "soon"]
    assert values(text.publish_day, dates) == [None, date(2024, 1, 5), date(2024, 1, 5),
                                               date(2024, 1, 5), None]


def test_day_of(values):
    assert values(text.day_of, [None, "", "2024-01-05 10:00", "x"]) == [
        "Unknown", "Unknown", "2024-01-05", "x"]


def test_clean_announcement_falls_back_to_list_date(spark):
    df = spark.createDataFrame([(None, "//h", "c", "", "2024.1.2", "s")],
                               "title string, url string, content string, publish_date string,"
                               "list_date string, source string")
    row = text.clean_announcement(df).first()
    assert (row.title, row.url, row.publish_date, row.source) == ("未知标题", "http://h", "2024-1-2", "s")


def test_province_is_first_in_list_order(values):
    got = values(lambda c: text.province_of(F.lit("广"), c), ["东上海北京", "x", None])
    # '广' + '东上海北京' holds 北京, 上海 and 广东; the list starts with 北京.
    assert got == ["北京", "其他", "其他"]


def test_after_last_colon(values):
    assert values(text.after_last_colon, ["a：b:c　", "a:b：c", "abc", "a："]) == ["c", "c", "abc", ""]


def test_parse_amount(values):
    got = values(text.parse_amount, ["￥1,234.5万元", "12元整", "无", "共,个", "3.7"])
    assert [(g["amount"], g["unit"], g["yuan"]) for g in got] == [
        (Decimal("1234.50"), "万元", Decimal("12345000.00")), (Decimal("12.00"), "元", Decimal("12.00")),
        (None, "", None), (Decimal("0.00"), "", Decimal("0.00")), (Decimal("3.70"), "", Decimal("3.70"))]


def test_find_date_prefers_shape_over_position(values):
    assert values(text.find_date, ["2024年1月5日 2023-01-01", "x2024/01/05", "2024-1-5", None]) == [
        "2023-01-01", "2024/01/05", None, None]


def test_json_list_join(values):
    assert values(text.json_list_join, ['["a","b"]', "[]", "oops", None]) == ["a, b", "", "", ""]


def test_parse_list_info(values):
    got = values(text.parse_list_info, [" 2024.1.5 || 采购人： 甲 | 代理机构：乙 | 采购人：丙", "", None])
    assert [tuple(g.values()) for g in got] == [("2024.1.5", "丙", "乙"), ("", "", ""), ("", "", "")]


def test_truncation(values):
    assert values(text.truncate_detail, ["x" * 32_001, None])[0] == "x" * 32_000 + "..."
    assert values(text.short_title, ["x" * 50, "x" * 51]) == ["x" * 50, "x" * 50 + "..."]


def test_like_text(spark):
    rows = [("a%b",), ("A_x",), ("c\\d",), ("招标",), ("zz",)]
    df = spark.createDataFrame(rows, "t string")

    def hits(q):
        return sorted(r.t for r in df.filter(chars.like_text(F.col("t"), q)).collect())

    assert hits("a_") == ["A_x", "a%b"]          # wildcards of the search text act as such
    assert hits("A%B") == ["a%b"]
    assert hits("\\") == ["c\\d"]
    assert hits("标") == ["招标"]


def test_search_text_with_wildcards_is_linear(spark):
    import time

    from noticeflow.functions.chars import like_text
    rows = ["", "ab", "aXb", "a\nb", "b a", "A%b", "a.b", "x_y", "ÄB c", "ab ab c\\d", "😀b", None, "[a](b)*"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    for q in ("%", "_", "__", "a%b", "a_b", "%b%a", "%%a%%b%%", "._", "_b", "ä%C", "\\_", "c\\%", "(_)*", "[a]%*", "a%b%a%c", "_ab"):
        want = df.select(F.col("s").ilike("%" + q.replace("\\", "\\\\") + "%").alias("m")).collect()
        assert df.select(like_text(F.col("s"), q).alias("m")).collect() == want, q
    long = spark.range(1).select(F.repeat(F.lit("license d"), 40_000).alias("s")).cache()
    t = time.time()
    assert long.filter(like_text(F.col("s"), "%licens%zz%")).count() == 0 and time.time() - t < 20
