"""Sinks written and read back, pages by cursor, and the state as it is laid out."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F, types as T

from noticeflow.functions.text import publish_day
from noticeflow.operators import cards, cursor, notices
from noticeflow.schema import ANNOUNCEMENTS, CONTACTS
from noticeflow.session import shared_dir
from noticeflow.sources import exports, keywords
from noticeflow.sources.pages import read_pages
from noticeflow.sources.state import State

from .registry import query
from .roles import A, C, D, K, M, announcements, contacts, seconds, table, texts
from .roles import cards as card_table
from .roles import mentions as mention_table


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/noticeflow-{name}-{uuid4().hex}"


def _renamed(df: DataFrame, headings: dict[str, str], *extra: str) -> DataFrame:
    return df.select(*[F.col(h).alias(c) for c, h in headings.items()], *extra)


# --------------------------------------------------------------------- CSV

@query("csv_announcements", f"WITH {A} SELECT title, url, publish_date, source FROM a")
def csv_announcements(spark, sf):
    path = _folder(spark, "csv")
    exports.export_announcements(announcements(spark, sf), path)
    return exports.read_csv(spark, path)


@query("csv_contacts", f"WITH {K} SELECT DISTINCT company, contact_name, phone, email FROM k")
def csv_contacts(spark, sf):
    path = _folder(spark, "csv")
    exports.export_contacts(contacts(spark, sf), path)
    return exports.read_csv(spark, path)


@query("csv_summary", f"""WITH {A}, {K} SELECT '公告总数' AS "项目", CAST(count(*) AS VARCHAR) AS "数量" FROM a
UNION ALL SELECT '联系人总数', CAST(count(*) AS VARCHAR) FROM k""")
def csv_summary(spark, sf):
    path = _folder(spark, "csv")
    exports.export_summary(announcements(spark, sf), contacts(spark, sf), path)
    return exports.read_csv(spark, f"{path}/总览")


@query("csv_notices", f"""WITH {D} SELECT source AS publish_date, title, CASE WHEN length(content) > 32000
  THEN substr(content, 1, 32000) || '...' ELSE content END AS content FROM d""")
def csv_notices(spark, sf):
    """Texts with quotes, commas and line breaks."""
    path = _folder(spark, "csv")
    exports.export_notices(texts(spark, sf).withColumn("publish_date", F.col("source")), path, include_details=True)
    return _renamed(exports.read_csv(spark, path), exports.DETAIL_HEADINGS)


@query("csv_by_day", f"""WITH {A} SELECT publish_date, title, source, url, split_part(publish_date, ' ', 1) AS day
FROM (SELECT * REPLACE (publish_date[1:7] || ' x' AS publish_date) FROM a)""")
def csv_by_day(spark, sf):
    """A folder for each month: dates are cut, so that files do not get tiny."""
    path = _folder(spark, "csv")
    a = announcements(spark, sf).withColumn("publish_date", F.concat(F.substring("publish_date", 1, 7), F.lit(" x")))
    exports.export_notices(a, path, split="day")
    return _renamed(exports.read_csv(spark, path), exports.NOTICE_HEADINGS, F.col("day").cast("string").alias("day"))


CARD_FILE = T.StructType([T.StructField(h, {"projects_count": T.LongType(), "created_at": T.TimestampType(),
                                            "updated_at": T.TimestampType()}.get(c, T.StringType()))
                          for c, h in exports.CARD_HEADINGS.items()])


@query("csv_cards", f"""WITH {C}, {M}
SELECT company, contact_name, phones, emails, count(DISTINCT announcement_id) AS projects_count,
  created_s, updated_s FROM c LEFT JOIN m ON m.business_card_id = c.id
WHERE company ILIKE '%nation_1%' OR contact_name ILIKE '%nation_1%'
GROUP BY c.id, company, contact_name, phones, emails, created_s, updated_s""")
def csv_cards(spark, sf):
    """Cards that a search text finds."""
    path = _folder(spark, "csv")
    exports.export_cards(card_table(spark, sf), mention_table(spark, sf), path, q="nation_1")
    return _renamed(exports.read_csv(spark, path, CARD_FILE), exports.CARD_HEADINGS).select(
        "company", "contact_name", "phones", "emails", "projects_count", seconds("created_at"), seconds("updated_at"))


# ------------------------------------------------------------------ cursors

@query("notice_pages_by_cursor", f"""WITH {A}, r AS (SELECT id, title, url, publish_date, source,
  row_number() OVER (ORDER BY publish_date DESC, url, id) - 1 AS n FROM a WHERE title ILIKE '%h%')
SELECT id, title, url, publish_date, source, n // 50 AS page FROM r WHERE n < 200""")
def notice_pages_by_cursor(spark, sf):
    """Four pages one after the other, each behind the last row of the one before."""
    found = notices.search(announcements(spark, sf), q="h")
    pages, at = [], None
    for n in range(4):
        part = notices.page_after(found, at, 50).checkpoint()
        pages.append(part.withColumn("page", F.lit(n).cast("long")))
        rows = part.orderBy(*cursor.ordering(notices.PAGE_ORDER)).collect()  # one page
        if len(rows) < 50:
            break
        at = cursor.cursor_of(rows[-1], notices.PAGE_ORDER)
    return reduce(DataFrame.unionByName, pages)


@query("card_list_after", f"""WITH {C}, {M} SELECT max(c.id) AS id, company, contact_name, max(phones) AS phones,
  max(emails) AS emails, max(created_s) AS created_s, max(updated_s) AS updated_s,
  count(DISTINCT announcement_id) AS projects_count
FROM c LEFT JOIN m ON m.business_card_id = c.id WHERE company ILIKE '%nation_1%' OR contact_name ILIKE '%nation_1%'
GROUP BY company, contact_name ORDER BY updated_s DESC, company, contact_name LIMIT 20 OFFSET 10""")
def card_list_after(spark, sf):
    """The page of cards behind the tenth."""
    c, m = card_table(spark, sf), mention_table(spark, sf)
    head = cards.card_list(c, m, q="nation_1", limit=10).collect()
    at = cursor.cursor_of(head[-1], cards.CARD_PAGE_ORDER) if head else None
    return cards.card_list(c, m, q="nation_1", limit=20, cursor=at).select(
        "id", "company", "contact_name", "phones", "emails", seconds("created_at"), seconds("updated_at"), "projects_count")


# -------------------------------------------------------------------- state

def _as_stored(a: DataFrame) -> DataFrame:
    known = {**{c: F.col(c) for c in a.columns}, "publish_day": publish_day(F.col("publish_date"))}
    return a.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANNOUNCEMENTS.fields])


@query("laid_out_announcements", f"""WITH {A} SELECT id, title, url, content, publish_date, source FROM a
WHERE source = 'F' AND publish_date >= '1995-03-10' AND publish_date < '1997-02-06'""")
def laid_out_announcements(spark, sf):
    """One source and a range of days after three batches, two of them compacted: only the
    folders of that source and those months are read."""
    state = State(spark, _folder(spark, "state"))
    rows = _as_stored(announcements(spark, sf))
    for n in range(3):
        batch = state.claim()
        state.stage("announcements", batch, rows.filter(F.pmod(F.col("id"), F.lit(3)) == n))
        state.commit(batch)
        if n == 1:
            state.compact()
    return state.announcements("F", "1995-03-10", "1997-02-05").select("id", "title", "url", "content", "publish_date", "source")


@query("stored_contacts", f"WITH {K} SELECT announcement_id, company, contact_name, phone, email FROM k")
def stored_contacts(spark, sf):
    """Contact rows of two batches, compacted between them."""
    state = State(spark, _folder(spark, "state"))
    rows = contacts(spark, sf).select(*CONTACTS.fieldNames())
    for building in (True, False):
        batch = state.claim()
        state.append_contacts(batch, rows.filter((F.col("contact_name") == "BUILDING") == building))
        state.commit(batch)
        if building:
            state.compact()
    return state.contacts()


@query("stored_pages", "SELECT page_id, url, html FROM pages")
def stored_pages(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", "html")


@query("keyword_set", "SELECT DISTINCT o_orderpriority AS keyword, 'priorities.txt' AS filename FROM orders")
def keyword_set(spark, sf):
    """A keyword set of the few priorities, stored and loaded."""
    path = _folder(spark, "keywords")
    words = [r[0] for r in table(spark, sf, "orders").select("o_orderpriority").distinct().collect()]
    keywords.save_keyword_set(spark, path, words, "priorities.txt")
    return keywords.load_keyword_set(spark, path).select(F.explode("keywords").alias("keyword"), "filename")
