"""Cleaning and labelling of notice fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .chars import (WS, first, first_filled, last, split_filled,
                    strip, text_or_empty, truncate)

# Fixed values.
NO_TITLE = "未知标题"
TITLE_LIMIT = 500
CONTENT_LIMIT = 50_000
CONTENT_CUT_NOTE = "\n...(内容过长，已截断)"
DETAIL_LIMIT = 32_000
PROVINCES = (
    "北京", "上海", "广东", "江苏", "浙江", "山东", "河南", "四川", "湖北", "湖南", "福建",
    "安徽", "河北", "陕西", "江西", "重庆", "辽宁", "云南", "广西", "山西", "贵州", "天津",
    "新疆", "内蒙古", "黑龙江", "吉林", "甘肃", "海南", "宁夏", "青海", "西藏",
)
OTHER_PROVINCE = "其他"
UNKNOWN_DAY = "Unknown"
# Tried in this order, not by position in the text.
DATE_SHAPES = (
    r"[\p{Nd}]{4}-[\p{Nd}]{2}-[\p{Nd}]{2}",
    r"[\p{Nd}]{4}\.[\p{Nd}]{2}\.[\p{Nd}]{2}",
    r"[\p{Nd}]{4}/[\p{Nd}]{2}/[\p{Nd}]{2}",
    r"[\p{Nd}]{4}年[\p{Nd}]{1,2}月[\p{Nd}]{1,2}日",
)


def clean_title(title: Column, limit: int | None = TITLE_LIMIT) -> Column:
    flat = strip(F.regexp_replace(title, f"{WS}+", " "))
    bare = F.regexp_replace(flat, r"[\x00-\x1f\x7f-\x9f]", "")
    return (F.when(title.isNull() | (title == ""), F.lit(NO_TITLE))
            .otherwise(truncate(bare, limit) if limit else bare))


def clean_url(url: Column) -> Column:
    bare = strip(text_or_empty(url))
    return F.when(bare.startswith("//"), F.concat(F.lit("http:"), bare)).otherwise(bare)


def clean_content(content: Column, limit: int | None = CONTENT_LIMIT) -> Column:
    one_gap = F.regexp_replace(text_or_empty(content), f"\\n{WS}*\\n", "\n\n")
    one_space = F.regexp_replace(one_gap, " +", " ")
    return strip(truncate(one_space, limit, CONTENT_CUT_NOTE) if limit else one_space)


def clean_date(date: Column) -> Column:
    # translate() drops the last character, which has no counterpart.
    return F.translate(strip(text_or_empty(date)), "年月./日", "----")


def clean_announcement(df: DataFrame, title_limit: int | None = TITLE_LIMIT,
                       content_limit: int | None = CONTENT_LIMIT) -> DataFrame:
    """Clean title, url, content and publish_date; other columns pass through.

    A limit of None keeps the whole text.
    """
    date = F.col("publish_date")
    if "list_date" in df.columns:
        date = first_filled(date, F.col("list_date"))
    return df.withColumns({
        "title": clean_title(F.col("title"), title_limit),
        "url": clean_url(F.col("url")),
        "content": clean_content(F.col("content"), content_limit),
        "publish_date": clean_date(date),
    })


def day_of(date: Column) -> Column:
    """Text before the first space; a fixed label when there is no date."""
    return (F.when(date.isNull() | (date == ""), F.lit(UNKNOWN_DAY))
            .otherwise(F.substring_index(date, " ", 1)))


def publish_day(date: Column) -> Column:
    """Typed day of a date string in any of the accepted spellings, or null."""
    day = F.substring_index(clean_date(date), " ", 1)
    shaped = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day)
    return shaped.try_cast("date")


def label_first_match(text: Column, labels: Sequence[str], default: str) -> Column:
    """First label, in list order, that occurs in the text."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in labels], F.lit(default))


def province_of(title: Column, content: Column) -> Column:
    return label_first_match(F.concat(text_or_empty(title), text_or_empty(content)),
                             PROVINCES, OTHER_PROVINCE)


def find_date(text: Column, shapes: Sequence[str] = DATE_SHAPES) -> Column:
    """First match of the first date shape that occurs at all, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in shapes])


def after_last_colon(text: Column) -> Column:
    return strip(F.substring_index(F.substring_index(text, "：", -1), ":", -1))


def parse_amount(text: Column) -> Column:
    """struct(amount, unit, yuan, original); amount is null when no number occurs."""
    number = F.regexp_extract(text, r"[\p{Nd},]+\.?[\p{Nd}]*", 0)
    bare = F.translate(number, ",", "")
    amount = F.when(number != "",
                    F.coalesce(bare.try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")))
    unit = (F.when(number == "", F.lit(""))
            .when(text.contains("万元"), F.lit("万元"))
            .when(text.contains("元"), F.lit("元"))
            .otherwise(F.lit("")))
    yuan = F.when(unit == "万元",
                  (bare.try_cast("decimal(24,6)") * F.lit(10000)).cast("decimal(20,2)")
                  ).otherwise(amount)
    return F.struct(amount.alias("amount"), unit.alias("unit"), yuan.alias("yuan"),
                    text.alias("original"))


def json_list_join(json_text: Column) -> Column:
    """'["a","b"]' -> 'a, b'; anything that is not such a list gives ''."""
    return text_or_empty(F.array_join(F.from_json(json_text, "array<string>"), ", "))


def truncate_detail(content: Column, limit: int | None = DETAIL_LIMIT) -> Column:
    whole = text_or_empty(content)
    return truncate(whole, limit) if limit else whole


def short_title(title: Column) -> Column:
    return truncate(title, 50)


def parse_list_info(info: Column) -> Column:
    """'date | 采购人：x | 代理机构：y' -> struct(publish_date, buyer_name, agent_name)."""
    parts = split_filled(info, r"\|")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def labelled(prefix: str) -> Column:
        hits = F.filter(rest, lambda p: p.startswith(prefix))
        return text_or_empty(strip(F.regexp_replace(last(hits), f"^{prefix}", "")))

    return F.struct(
        text_or_empty(first(parts)).alias("publish_date"),
        labelled("采购人：").alias("buyer_name"),
        labelled("代理机构：").alias("agent_name"),
    )


