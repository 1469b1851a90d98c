"""Card, mention and contact queries."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from noticeflow.operators import cards, contacts
from noticeflow.operators.text_index import TextIndex
from noticeflow.session import shared_dir
from noticeflow.sources import exports

from .registry import query
from .roles import A, C, K, M, announcements, seconds
from .roles import cards as card_table
from .roles import contacts as contact_table
from .roles import mentions as mention_table
from .roles import table


@query("top_companies", f"""WITH {C}, {M}
SELECT company, count(DISTINCT announcement_id) AS count
FROM c JOIN m ON m.business_card_id = c.id
WHERE company NOT LIKE '%详见%正文%' AND company NOT LIKE '%见公告%'
  AND company NOT LIKE '%见附件%' AND length(company) > 2
GROUP BY company ORDER BY count DESC, company LIMIT 5""")
def top_companies(spark, sf):
    return cards.top_companies(card_table(spark, sf), mention_table(spark, sf))


@query("role_distribution", f"WITH {M} SELECT role, count(*) AS count FROM m GROUP BY role")
def role_distribution(spark, sf):
    return cards.role_distribution(mention_table(spark, sf))


LIST_SQL = """SELECT max(c.id) AS id, company, contact_name, max(phones) AS phones,
  max(emails) AS emails, max(created_s) AS created_s, max(updated_s) AS updated_s,
  count(DISTINCT announcement_id) AS projects_count"""


def _list(df):
    return df.select("id", "company", "contact_name", "phones", "emails", seconds("created_at"),
                     seconds("updated_at"), "projects_count")


@query("card_list", f"""WITH {C}, {M} {LIST_SQL}
FROM c LEFT JOIN m ON m.business_card_id = c.id GROUP BY company, contact_name
ORDER BY updated_s DESC, company, contact_name LIMIT 50 OFFSET 10""")
def card_list(spark, sf):
    return _list(cards.card_list(card_table(spark, sf), mention_table(spark, sf),
                                 limit=50, offset=10))


@query("card_list_search", f"""WITH {C}, {M} {LIST_SQL}
FROM c LEFT JOIN m ON m.business_card_id = c.id
WHERE company ILIKE '%nation_1%' OR contact_name ILIKE '%nation_1%'
GROUP BY company, contact_name ORDER BY updated_s DESC, company, contact_name LIMIT 50""")
def card_list_search(spark, sf):
    return _list(cards.card_list(card_table(spark, sf), mention_table(spark, sf), q="nation_1"))


@query("card_list_role", f"""WITH {C}, {M} {LIST_SQL}
FROM c JOIN m ON m.business_card_id = c.id WHERE role = 'R'
GROUP BY company, contact_name ORDER BY updated_s DESC, company, contact_name LIMIT 50""")
def card_list_role(spark, sf):
    return _list(cards.card_list(card_table(spark, sf), mention_table(spark, sf), role="R"))


@query("card_list_region", f"""WITH {C}, {M}, {A} {LIST_SQL}
FROM c JOIN m ON m.business_card_id = c.id JOIN a ON a.id = m.announcement_id
WHERE role = 'N' AND (a.title ILIKE '%urgent%' OR a.content ILIKE '%urgent%')
GROUP BY company, contact_name ORDER BY updated_s DESC, company, contact_name LIMIT 50""")
def card_list_region(spark, sf):
    return _list(cards.card_list(card_table(spark, sf), mention_table(spark, sf),
                                 announcements(spark, sf), role="N", province="urgent"))


@query("card_group_count", f"""WITH {C}, {M} SELECT count(*) AS total FROM (
SELECT 1 FROM c LEFT JOIN m ON m.business_card_id = c.id
WHERE company ILIKE '%nation_1%' OR contact_name ILIKE '%nation_1%'
GROUP BY company, contact_name)""")
def card_group_count(spark, sf):
    return cards.card_group_count(card_table(spark, sf), mention_table(spark, sf), q="nation_1")


@query("card_group_count_region", f"""WITH {C}, {M}, {A} SELECT count(*) AS total FROM (
SELECT 1 FROM c JOIN m ON m.business_card_id = c.id JOIN a ON a.id = m.announcement_id
WHERE role = 'A' AND (a.title ILIKE '%high%' OR a.content ILIKE '%high%')
GROUP BY company, contact_name)""")
def card_group_count_region(spark, sf):
    return cards.card_group_count(card_table(spark, sf), mention_table(spark, sf),
                                  announcements(spark, sf), role="A", province="high")


def _company(df):
    return df.select("id", "company", "contact_name", F.array_join("phones", ", ").alias("phones"),
                     F.array_join("emails", ", ").alias("emails"), "projects_count",
                     seconds("updated_at"))


COMPANY_SQL = f"""WITH {C}, {M}
SELECT c.id, company, contact_name, phones, emails, count(DISTINCT announcement_id) AS projects_count,
  updated_s FROM c LEFT JOIN m ON m.business_card_id = c.id"""
COMPANY_ORDER = """GROUP BY c.id, company, contact_name, phones, emails, updated_s
ORDER BY projects_count DESC, updated_s DESC, c.id LIMIT 200"""


@query("cards_by_company", f"{COMPANY_SQL} WHERE company = 'NATION_2' {COMPANY_ORDER}")
def cards_by_company(spark, sf):
    return _company(cards.cards_of_company(card_table(spark, sf), mention_table(spark, sf),
                                           "NATION_2"))


@query("cards_by_company_like", f"{COMPANY_SQL} WHERE company ILIKE '%tion%' {COMPANY_ORDER}")
def cards_by_company_like(spark, sf):
    return _company(cards.cards_of_company(card_table(spark, sf), mention_table(spark, sf),
                                           "tion", like=True))


CARD_SEARCHED = ("tion_1", "01", "ler#0", "zz", "%nation%7")


@query("card_search_indexed", f"""WITH {C} """ + " UNION ALL ".join(
    f"SELECT '{q}' AS q, id FROM c WHERE company ILIKE '%{q}%' OR contact_name ILIKE '%{q}%'" for q in CARD_SEARCHED))
def card_search_indexed(spark, sf):
    """Cards by company or contact through a stored index, for several search texts."""
    index = TextIndex(spark, f"{shared_dir(spark)}/noticeflow-index-{uuid4().hex}", ("company", "contact_name"), blocks=16, buckets=8)
    index.add(card_table(spark, sf).select("id", "company", "contact_name"))
    return reduce(DataFrame.unionByName, [index.search(q).select(F.lit(q).alias("q"), "id") for q in CARD_SEARCHED])


@query("cards_export", f"""WITH {C}, {M}
SELECT company, contact_name, phones, emails, count(DISTINCT announcement_id) AS projects_count,
  created_s, updated_s FROM c LEFT JOIN m ON m.business_card_id = c.id
GROUP BY c.id, company, contact_name, phones, emails, created_s, updated_s
ORDER BY company, contact_name""")
def cards_export(spark, sf):
    return cards.exported_cards(card_table(spark, sf), mention_table(spark, sf)).select(
        "company", "contact_name", "phones", "emails", "projects_count", seconds("created_at"),
        seconds("updated_at"))


HISTORY_SQL = "SELECT a.id, a.title, a.url, a.source, a.publish_date, m.role"


@query("card_mentions", f"""WITH {M}, {A} {HISTORY_SQL} FROM m JOIN a ON m.announcement_id = a.id
WHERE m.business_card_id = 4""")
def card_mentions(spark, sf):
    return cards.mentions_of_card(mention_table(spark, sf), announcements(spark, sf), 4)


def _by_nation(spark, sf):
    """Cards whose (company, contact) pair is shared by several ids."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("COMPANY").alias("company"),
        F.col("s_nationkey").cast("string").alias("contact_name"))


@query("card_history", f"""WITH c AS (SELECT s_suppkey AS id, 'COMPANY' AS company,
  CAST(s_nationkey AS VARCHAR) AS contact_name FROM supplier), {M}, {A}
{HISTORY_SQL} FROM m JOIN c ON m.business_card_id = c.id JOIN a ON m.announcement_id = a.id
WHERE (c.company, c.contact_name) = (SELECT (company, contact_name) FROM c WHERE id = 4)""")
def card_history(spark, sf):
    return cards.card_history(_by_nation(spark, sf), mention_table(spark, sf),
                              announcements(spark, sf), 4)


@query("same_identity", """SELECT s_suppkey AS id FROM supplier WHERE s_nationkey =
(SELECT s_nationkey FROM supplier WHERE s_suppkey = 4)""")
def same_identity(spark, sf):
    return cards.same_identity(_by_nation(spark, sf), 4).select("id")


@query("top_contact_companies", f"""WITH {K} SELECT company, count(*) AS count FROM k
WHERE company IS NOT NULL AND company != '' GROUP BY company
ORDER BY count DESC, company LIMIT 20""")
def top_contact_companies(spark, sf):
    return contacts.top_contact_companies(contact_table(spark, sf))


@query("export_contacts", f"WITH {K} SELECT DISTINCT company, contact_name, phone, email FROM k")
def export_contacts(spark, sf):
    from noticeflow.operators.dedupe import distinct_rows
    return distinct_rows(contact_table(spark, sf), exports.CONTACT_COLUMNS)


@query("card_merge", """WITH rows AS (
  SELECT 'NATION_' || s_nationkey AS company, CAST(s_suppkey % 10 AS VARCHAR) AS contact_name,
    '010-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS phone,
    's' || s_suppkey || '@mail.example' AS email, 1700000000 AS created_s, 1700000000 AS updated_s
  FROM supplier
  UNION ALL
  SELECT 'NATION_' || c_nationkey, CAST(c_custkey % 10 AS VARCHAR),
    '010-' || lpad(CAST(c_custkey // 7 AS VARCHAR), 8, '0'),
    lower(c_mktsegment) || '@mail.example', 1800000000, 1800000000
  FROM customer)
SELECT company, contact_name,
  array_to_string(list_sort(list(DISTINCT phone)), ',') AS phones,
  array_to_string(list_sort(list(DISTINCT email)), ',') AS emails,
  min(created_s) AS created_s, max(updated_s) AS updated_s
FROM rows GROUP BY company, contact_name""")
def card_merge(spark, sf):
    """Candidates from customer merged into cards from supplier."""
    def rows(df, key, nation, number, mail, at, *at_names):
        return df.select(
            F.concat(F.lit("NATION_"), F.col(nation).cast("string")).alias("company"),
            F.concat(F.lit(" "), (F.col(key) % 10).cast("string")).alias("contact_name"),
            F.array(F.concat(F.lit("010-"), F.lpad(number.cast("string"), 8, "0"))).alias("phones"),
            F.array(mail).alias("emails"),
            *[F.timestamp_seconds(F.lit(at)).alias(n) for n in at_names])

    old = rows(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", F.col("s_suppkey"),
               F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@mail.example")),
               1_700_000_000, "created_at", "updated_at")
    new = rows(table(spark, sf, "customer"), "c_custkey", "c_nationkey",
               F.floor(F.col("c_custkey") / 7),
               F.concat(F.col("c_mktsegment"), F.lit("@MAIL.example ")), 1_800_000_000, "seen_at")
    return cards.merge_cards(old, new).select(
        "company", "contact_name", F.array_join("phones", ",").alias("phones"),
        F.array_join("emails", ",").alias("emails"), seconds("created_at"), seconds("updated_at"))


@query("mention_merge", """SELECT DISTINCT l_suppkey AS business_card_id,
  l_orderkey AS announcement_id, l_returnflag AS role FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_linestatus = 'F' AND o.l_suppkey = l.l_suppkey
  AND o.l_orderkey = l.l_orderkey AND o.l_returnflag = l.l_returnflag)""")
def mention_merge(spark, sf):
    """All mentions against those already stored, the finished lines."""
    stored = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(
        F.col("l_suppkey").alias("business_card_id"), F.col("l_orderkey").alias("announcement_id"),
        F.col("l_returnflag").alias("role"))
    return cards.new_mentions(stored, mention_table(spark, sf))


@query("export_summary", f"""WITH {A}, {K},
top AS (SELECT company, count(*) AS n FROM k WHERE company != '' GROUP BY company
  ORDER BY n DESC, company LIMIT 20)
SELECT '总览' AS sheet, '公告总数' AS item, count(*) AS number FROM a
UNION ALL SELECT '总览', '联系人总数', count(*) FROM k
UNION ALL SELECT '按数据源', source, count(*) FROM a GROUP BY source
UNION ALL SELECT '热门公司', company, n FROM top""")
def export_summary(spark, sf):
    sheets = exports.summary_tables(announcements(spark, sf), contact_table(spark, sf))
    out = None
    for name, df in sheets.items():
        rows = df.select(F.lit(name).alias("sheet"), F.col(df.columns[0]).alias("item"),
                         F.col(df.columns[1]).alias("number"))
        out = rows if out is None else out.unionByName(rows)
    return out
