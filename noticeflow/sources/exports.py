"""Exports as partitioned files.

Every CSV file begins with a byte-order mark and a header, so that a spreadsheet opens any of
them alone. Spreadsheets and archives are replaced by folders of CSV or parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import day_of, province_of, truncate_detail
from ..operators.cards import exported_cards
from ..operators.contacts import top_contact_companies
from ..operators.dedupe import distinct_rows
from ..operators.notices import count_by_source, newest, totals

BYTE_ORDER_MARK = "\ufeff"

# Column headings of the exported sheets.
NOTICE_HEADINGS = {"publish_date": "发布时间", "title": "标题", "source": "来源", "url": "链接"}
DETAIL_HEADINGS = {"publish_date": "发布时间", "title": "标题", "content": "详情"}
CARD_HEADINGS = {"company": "公司名称", "contact_name": "联系人", "phones": "电话", "emails": "邮箱",
                 "projects_count": "关联项目数", "created_at": "创建时间", "updated_at": "更新时间"}
TOTAL_LABELS = {"announcements": "公告总数", "contacts": "联系人总数"}
ANNOUNCEMENT_COLUMNS = ("title", "url", "publish_date", "source", "scraped_at")
CONTACT_COLUMNS = ("company", "contact_name", "phone", "email")


def write(df: DataFrame, path: str, fmt: str = "csv", by: str | None = None) -> None:
    """A folder of files, with a folder for each value of ``by``.

    The mark is the first character of the first heading: Spark writes a header at the head of
    each file, and quotes only what needs it. Null is written as nothing, '' as two quotes.
    """
    if fmt == "csv":
        first = next(c for c in df.columns if c != by)
        df = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        writer.format(fmt).save(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """An export read back; all columns are text unless a schema is given.

    Only a cell without quotes is null: what stands for null here can be in no file by itself.
    """
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n").option("nullValue", "\0")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    return (reader if schema is None else reader.schema(schema)).csv(path)


def announcement_rows(a: DataFrame) -> DataFrame:
    return a.select(*[c for c in ANNOUNCEMENT_COLUMNS if c in a.columns])


def export_announcements(a: DataFrame, path: str, fmt: str = "csv") -> bool:
    """S10; an empty table writes nothing."""
    if a.isEmpty():
        return False
    write(announcement_rows(a), path, fmt)
    return True


def export_contacts(contacts: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Distinct contact rows."""
    if contacts.isEmpty():
        return False
    write(distinct_rows(contacts, CONTACT_COLUMNS), path, fmt)
    return True


def summary_tables(a: DataFrame, contacts: DataFrame) -> dict[str, DataFrame]:
    """Totals, per source, top companies (A1-A3)."""
    label = F.create_map(*[F.lit(x) for kv in TOTAL_LABELS.items() for x in kv])[F.col("table")]
    return {
        "总览": totals(announcements=a, contacts=contacts)
        .select(label.alias("项目"), F.col("count").alias("数量")),
        "按数据源": count_by_source(a).select(F.col("source").alias("数据源"),
                                          F.col("count").alias("数量")),
        "热门公司": top_contact_companies(contacts).select(F.col("company").alias("公司"),
                                                        F.col("count").alias("数量")),
    }


def export_summary(a: DataFrame, contacts: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per table; the CSV form keeps the totals only."""
    for name, df in summary_tables(a, contacts).items():
        if fmt != "csv" or name == "总览":
            write(df.coalesce(1), f"{path}/{name}", fmt)


def export_all(a: DataFrame, contacts: DataFrame, path: str, fmt: str = "csv",
               seq: str = "ingest_seq", rows: int | None = None) -> None:
    """Announcements and contacts, and the summary; all rows, or the newest ``rows``."""
    def recent(df: DataFrame) -> DataFrame:
        return df if rows is None else newest(df, rows, seq)

    export_announcements(recent(a), f"{path}/announcements", fmt)
    export_contacts(recent(contacts), f"{path}/contacts", fmt)
    export_summary(a, contacts, f"{path}/summary", fmt)


def notice_rows(a: DataFrame, include_details: bool = False) -> DataFrame:
    """Exported columns of filtered notices, newest first."""
    content = [truncate_detail(F.col("content")).alias("content")] if include_details else [
        "source", "url"]
    # The url makes the order total and splits a date with very many notices.
    return (a.orderBy(F.desc_nulls_last("publish_date"), "title", "url")
            .select("publish_date", "title", *content))


def _headed(df: DataFrame, headings: dict[str, str], *extra: str) -> DataFrame:
    return df.select(*[F.col(c).alias(h) for c, h in headings.items()], *extra)


def export_notices(a: DataFrame, path: str, include_details: bool = False, fmt: str = "csv",
                   split: str = "all") -> None:
    """All notices, or one folder per province or day.

    No rows is an error. A split export is rebalanced on its label: Spark
    cuts a hot label into several files and joins the small ones, so neither
    one task nor thousands of tiny files carry a label.
    """
    if split not in ("all", "province", "day"):
        raise ValueError("Invalid export type")
    if a.isEmpty():
        raise ValueError("No data to export")
    headings = DETAIL_HEADINGS if include_details else NOTICE_HEADINGS
    if split == "all":
        write(_headed(notice_rows(a, include_details), headings), path, fmt)
        return
    label = split_label(split)
    if include_details:
        a = a.withColumn("content", truncate_detail(F.col("content")))
    labelled = a.withColumn(split, label).hint("rebalance", split)
    ordered = labelled.sortWithinPartitions(split, F.desc_nulls_last("publish_date"))
    write(_headed(ordered, headings, split), path, fmt, by=split)


def split_label(split: str) -> Column:
    if split == "province":
        return province_of(F.col("title"), F.col("content"))
    return day_of(F.col("publish_date"))


def export_cards(c: DataFrame, m: DataFrame, path: str, q: str = "", fmt: str = "csv") -> None:
    """S17."""
    write(_headed(exported_cards(c, m, q), CARD_HEADINGS), path, fmt)
