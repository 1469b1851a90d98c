"""Cleaning, extraction and attribution over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import contact, text, urls
from noticeflow.operators import contacts
from noticeflow.sources import keywords, search_json

from .registry import query
from .roles import long_texts, table, texts

# The SQL side has its own patterns: RE2 syntax, ASCII digits.
MOBILE = r"1[3-9][0-9]{9}"
LANDLINE = r"0[0-9]{2,3}-?[0-9]{7,8}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAILS_SQL = f"""list_distinct(list_transform(list_filter(regexp_extract_all(text, '{EMAIL}'),
  lambda e: length(e) BETWEEN 5 AND 100 AND e[1] NOT IN ('@', '.', '-') AND e[-1] NOT IN ('@', '.', '-')),
  lambda e: lower(e)))"""
PHONES_SQL = rf"""list_distinct(list_filter(list_transform(list_concat(
  regexp_extract_all(text, '(?:电话|手机|联系方式|联系人).*?[:：]?\s*([0-9\-]{{7,15}})', 1),
  regexp_extract_all(text, '{MOBILE}'), regexp_extract_all(text, '{LANDLINE}'),
  regexp_extract_all(text, '0[0-9]{{2,3}}[0-9]{{7,8}}'),
  regexp_extract_all(text, '[0-9]{{3,4}}-[0-9]{{7,8}}')),
  lambda p: regexp_replace(p, '[^0-9\-]', '', 'g')), lambda p: length(p) BETWEEN 7 AND 15))"""


def _joined(col):
    return F.array_join(F.array_sort(col), ",")


# ----------------------------------------------------------------- cleaning

@query("clean_text", r"""WITH x AS (SELECT doc_id AS id, text,
  regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\x00-\x1f\x7f-\x{9f}]', '', 'g') AS t,
  regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g') AS c
  FROM documents)
SELECT id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS title,
  trim(CASE WHEN length(c) > 50000 THEN substr(c, 1, 50000) || chr(10) || '...(内容过长，已截断)' ELSE c END,
    ' ' || chr(10)) AS content,
  CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short,
  CASE WHEN length(text) > 32000 THEN substr(text, 1, 32000) || '...' ELSE text END AS detail
FROM x""")
def clean_text(spark, sf):
    raw = F.col("text")
    return long_texts(spark, sf).select(
        F.col("doc_id").alias("id"), text.clean_title(raw).alias("title"),
        text.clean_content(raw).alias("content"), text.short_title(raw).alias("short"),
        text.truncate_detail(raw).alias("detail"))


@query("clean_urls", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http:' || u ELSE u END AS url
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '//' || split_part(url, '://', 2) ELSE url END AS u
  FROM pages)""")
def clean_urls(spark, sf):
    raw = F.when(F.col("page_id") % 2 == 0,
                 F.concat(F.lit("　//"), F.element_at(F.split("url", "://"), 2), F.lit(" \n"))
                 ).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", text.clean_url(raw).alias("url"))


@query("clean_dates", """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%-m-%-d') || ' 10:00-5' AS publish_date,
  CAST(o_orderdate AS DATE)::VARCHAR AS publish_day FROM orders""")
def clean_dates(spark, sf):
    """Three spellings of a date, by order status; '.' in the time part changes, too."""
    status = F.col("o_orderstatus")
    raw = (F.when(status == "F", F.date_format("o_orderdate", "yyyy年M月d日 10:00.5"))
           .when(status == "O", F.date_format("o_orderdate", "yyyy.M.d 10:00.5"))
           .otherwise(F.date_format("o_orderdate", "yyyy/M/d 10:00/5")))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), text.clean_date(raw).alias("publish_date"),
        text.publish_day(raw).cast("string").alias("publish_day"))


@query("clean_announcements", r"""WITH x AS (SELECT *,
  regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g') AS c,
  trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id AS id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS title,
  'http://text.example/' || lang || '/' || n_chars AS url,
  trim(CASE WHEN length(c) > 50000 THEN substr(c, 1, 50000) || chr(10) || '...(内容过长，已截断)' ELSE c END,
    ' ' || chr(10)) AS content, '2024-1-5' AS publish_date, source FROM x""")
def clean_announcements(spark, sf):
    a = texts(spark, sf).withColumns({"publish_date": F.lit(""), "list_date": F.lit("2024年1月5日")})
    return text.clean_announcement(a).select("id", "title", "url", "content", "publish_date", "source")


@query("clean_contacts", """SELECT c_custkey AS id,
  '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ',010-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phones,
  lower(c_mktsegment) || c_custkey || '@mail.example' AS emails, 'NATION_' || c_nationkey || '公司' AS company,
  CASE WHEN c_nationkey < 10 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS contacts FROM customer""")
def clean_contacts(spark, sf):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    mobile = F.concat(F.lit("138 "), F.lpad(key, 8, "0"))
    mail = F.concat(F.lit(" "), F.col("c_mktsegment"), key, F.lit("@Mail.Example"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array_join(contact.clean_phones(F.array(
            mobile, F.concat(F.lit("电话010-"), F.lpad(key, 8, "0")), F.lit("12-34"), mobile,
            F.lit("1234567890123456"))), ",").alias("phones"),
        F.array_join(contact.clean_emails(F.array(mail, F.lit("a@b"), F.upper(mail), F.lit("@.x"))),
                     ",").alias("emails"),
        contact.clean_company(F.concat(F.lit("　NATION、_"), nation, F.lit("，公司;"))).alias("company"),
        F.array_join(contact.clean_contact_names(F.array(
            F.concat(nation, F.lit(" ")), F.lit("x"), F.repeat(F.lit("x"), 21), nation)), ","
        ).alias("contacts"))


# --------------------------------------------------------------- extraction

@query("extract_emails", f"""SELECT doc_id, array_to_string(list_sort({EMAILS_SQL}), ',') AS emails
FROM documents""")
def extract_emails(spark, sf):
    return long_texts(spark, sf).select(
        "doc_id", _joined(contact.extract_emails(F.col("text"))).alias("emails"))


@query("extract_phones", f"""SELECT doc_id, array_to_string(list_sort({PHONES_SQL}), ',') AS phones
FROM documents""")
def extract_phones(spark, sf):
    return long_texts(spark, sf).select(
        "doc_id", _joined(contact.extract_phones(F.col("text"))).alias("phones"))


@query("contact_rows", f"""WITH x AS (SELECT doc_id, {EMAILS_SQL} AS emails, {PHONES_SQL} AS phones
  FROM documents)
SELECT doc_id AS announcement_id, '' AS company, '' AS contact_name, phone, email FROM (
  SELECT doc_id, unnest(CASE WHEN len(phones) = 0 THEN [''] ELSE phones END) AS phone, emails FROM x),
  LATERAL (SELECT unnest(CASE WHEN len(emails) = 0 THEN [''] ELSE emails END) AS email)
WHERE phone != '' OR email != ''""")
def contact_rows(spark, sf):
    """Names and companies are Chinese labels the test texts do not hold."""
    return contacts.contacts_in_text(long_texts(spark, sf), "text", "doc_id")


NOTES = """n AS (SELECT c_custkey AS id, CASE c_mktsegment
  WHEN 'BUILDING' THEN '采购人：' || c_name || '有限公司、地址' || chr(10) || '联系人：李雷、电话'
  WHEN 'FURNITURE' THEN '采购人：某处' || chr(10) || '供应商:' || c_name || '集团' || chr(10) || '项目联系：HanMei 见附件'
  WHEN 'HOUSEHOLD' THEN '代理机构：' || c_name || '代理公司'
  ELSE '联系人：详见公告' END AS note, c_mktsegment AS seg, c_name FROM customer)"""


def _notes(spark, sf):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (
        F.when(seg == "BUILDING", F.concat(F.lit("采购人："), name, F.lit("有限公司、地址\n联系人：李雷、电话")))
        .when(seg == "FURNITURE", F.concat(F.lit("采购人：某处\n供应商:"), name, F.lit("集团\n项目联系：HanMei 见附件")))
        .when(seg == "HOUSEHOLD", F.concat(F.lit("代理机构："), name, F.lit("代理公司")))
        .otherwise(F.lit("联系人：详见公告"))).alias("note"))


@query("extract_names", f"""WITH {NOTES} SELECT id, CASE seg WHEN 'BUILDING' THEN c_name || '有限公司'
  WHEN 'FURNITURE' THEN c_name || '集团' WHEN 'HOUSEHOLD' THEN c_name || '代理公司' ELSE '' END AS company,
  CASE seg WHEN 'BUILDING' THEN '李雷' WHEN 'FURNITURE' THEN 'HanMei' ELSE '' END AS contacts FROM n""")
def extract_names(spark, sf):
    return _notes(spark, sf).select(
        "id", contact.extract_company(F.col("note")).alias("company"),
        F.array_join(contact.extract_contact_names(F.col("note")), ",").alias("contacts"))


# ------------------------------------------------------------ contact cells

@query("split_contact", """SELECT c_custkey AS id, '李' || c_mktsegment AS name,
  CASE WHEN c_nationkey < 12 THEN '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
       ELSE '010-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone,
  'u' || c_custkey || '@mail.example' AS email FROM customer""")
def split_contact(spark, sf):
    key = F.col("c_custkey").cast("string")
    phone = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("138"), F.lpad(key, 8, "0"))).otherwise(
        F.concat(F.lit("010-"), F.lpad(key, 7, "0")))
    cell = F.concat(F.lit(" 李"), F.col("c_mktsegment"), F.lit("："), phone, F.lit("，u"), key,
                    F.lit("@mail.example"))
    return (table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                contact.split_contact(cell).alias("c"))
            .select("id", "c.*"))


@query("expand_phones", """WITH x AS (SELECT c_custkey AS id, '010-6' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS land,
  '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cell, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS tail
  FROM customer)
SELECT id, land || ', ' || CASE WHEN right(land, 4) = tail THEN '' ELSE left(land, 8) || tail || ', ' END
    || left(land, 7) || '98765, ' || cell AS expanded,
  cell || ', ' || land AS formatted, cell AS first FROM x""")
def expand_phones(spark, sf):
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("电话：010-6"), F.lpad(key, 7, "0"), F.lit("/"),
                    F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"),
                    F.lit("、98765 或 138"), F.lpad(key, 8, "0"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array_join(contact.expand_phones(line), ", ").alias("expanded"),
        contact.format_phones(line).alias("formatted"), contact.first_phone(line).alias("first"))


@query("phone_owner", """WITH x AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 8, '6') AS p8,
  c_mktsegment AS seg, 'B' || c_nationkey AS buyer, CASE WHEN c_nationkey < 20 THEN 'A' || c_nationkey ELSE '' END AS agent
  FROM customer), y AS (SELECT *,
  CASE WHEN seg IN ('BUILDING', 'MACHINERY') AND agent != '' THEN agent
       WHEN seg IN ('FURNITURE', 'MACHINERY') THEN buyer
       WHEN agent != '' THEN agent ELSE buyer END AS owner FROM x)
SELECT id, owner, CASE WHEN owner = agent THEN 'agent' ELSE 'buyer' END AS role FROM y""")
def phone_owner(spark, sf):
    """Project phone shared with the agent, the buyer, both or neither, by segment."""
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    p8 = F.lpad(F.col("c_custkey").cast("string"), 8, "6")
    other = F.array(F.lit("021-50000000"), F.lit(""))
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("B"), nation).alias("buyer"),
        F.when(F.col("c_nationkey") < 20, F.concat(F.lit("A"), nation)).otherwise("").alias("agent"),
        F.array(F.concat(F.lit("(010) "), p8)).alias("project_phones"),
        F.when(seg.isin("BUILDING", "MACHINERY"), F.array(F.concat(F.lit("0108"), p8)))
        .otherwise(other).alias("agent_phones"),
        F.when(seg.isin("FURNITURE", "MACHINERY"), F.array(F.lit(""), p8))
        .otherwise(other).alias("buyer_phones"))
    owner = F.coalesce(
        contact.project_owner(F.col("project_phones"), F.col("agent"), F.col("agent_phones"),
                              F.col("buyer"), F.col("buyer_phones")),
        F.when(F.col("agent") != "", F.col("agent")).otherwise(F.col("buyer")))
    return (rows.withColumn("owner", owner)
            .select("id", "owner", contact.contact_role(F.col("owner"), F.col("agent"), F.col("buyer"))
                    .alias("role")))


# ------------------------------------------------------------ other scalars

@query("parse_amount", """SELECT o_orderkey AS id, CAST(n * 100 + 25 AS DOUBLE) / 100 AS amount,
  CASE o_orderstatus WHEN 'F' THEN '万元' WHEN 'O' THEN '元' ELSE '' END AS unit,
  (CAST(n * 100 + 25 AS DOUBLE) / 100) * CASE o_orderstatus WHEN 'F' THEN 10000 ELSE 1 END AS yuan
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def parse_amount(spark, sf):
    n = F.floor("o_totalprice").cast("long")
    tail = F.when(F.col("o_orderstatus") == "F", "万元").when(F.col("o_orderstatus") == "O", "元").otherwise("")
    shown = F.concat(F.lit("中标金额：￥"), F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{3})+$)", "$1,"),
                     F.lit(".25"), tail, F.lit("（含税3%）"))
    return (table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                              text.parse_amount(shown).alias("a"))
            .select("id", F.col("a.amount").cast("double").alias("amount"), "a.unit",
                    F.col("a.yuan").cast("double").alias("yuan")))


@query("find_date", """SELECT o_orderkey AS id, CASE o_orderstatus
  WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%Y.%m.%d')
  ELSE strftime(o_orderdate, '%Y年%-m月%-d日') END AS found FROM orders""")
def find_date(spark, sf):
    """The hyphen form wins over an earlier date in another form."""
    d = F.col("o_orderdate")
    shown = (F.when(F.col("o_orderstatus") == "F", F.concat(
                F.lit("2001年1月1日 至 "), F.date_format(d, "yyyy-MM-dd"), F.lit(" 2009-09-09")))
             .when(F.col("o_orderstatus") == "O", F.date_format(d, "'x1'yyyy.MM.dd'1999/01/01'"))
             .otherwise(F.date_format(d, "yyyy年M月d日")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                             text.find_date(shown).alias("found"))


@query("list_info", """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS publish_date,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'B' || c_nationkey END AS buyer_name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'A' || c_nationkey ELSE '' END AS agent_name FROM customer""")
def list_info(spark, sf):
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    info = F.when(seg == "BUILDING", F.lit(" | ")).otherwise(F.concat(
        F.lit(" "), F.col("c_name"), F.lit(" | 采购人： B"), nation, F.lit(" || "),
        F.when(seg == "MACHINERY", F.concat(F.lit("代理机构：A"), nation)).otherwise("其他：x")))
    return (table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                text.parse_list_info(info).alias("i"))
            .select("id", "i.*"))


@query("scalars", """SELECT event_id AS id, event_type || ', ' || user_id AS joined, '' AS broken,
  event_type AS tail, CAST(user_id AS VARCHAR) AS digits, event_type || ',b' AS parts FROM events""")
def scalars(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), text.json_list_join(F.to_json(F.array(kind, user))).alias("joined"),
        text.json_list_join(F.concat(F.lit("["), kind)).alias("broken"),
        text.after_last_colon(F.concat(F.lit("名称：x:："), kind, F.lit("　"))).alias("tail"),
        contact.digits_only(F.concat(F.lit("("), user, F.lit(")-"))).alias("digits"),
        F.array_join(contact.split_phone_list(F.concat(kind, F.lit(" , ,b,"))), ",").alias("parts"))


@query("absolute_urls", """SELECT page_id, url,
  regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/p' || page_id AS rooted,
  regexp_extract(url, '^[a-z]+://[^?#]*/', 0) || 'x.html' AS relative,
  'http://other.example/' AS complete, true AS foreign_dropped,
  CASE page_id % 3 WHEN 0 THEN 'ccgp' WHEN 1 THEN 'ccgp' ELSE 'other' END AS kind FROM pages""")
def absolute_urls(spark, sf):
    base = urls.url_parts(F.col("url"))
    rooted = F.concat(F.lit("/a/../p"), F.col("page_id").cast("string"))
    sites = F.array(*map(F.lit, ("http://www.ccgp.gov.cn/?", "http://www.ccgp-a.gov.cn/?", "http://x.example/?")))
    return table(spark, sf, "pages").select(
        "page_id", "url", urls.absolute_url(rooted, base).alias("rooted"),
        urls.absolute_url(F.lit("./x.html"), base).alias("relative"),
        urls.absolute_url(F.lit("http://other.example/"), base).alias("complete"),
        urls.absolute_url(F.lit("//other.example/"), base).isNull().alias("foreign_dropped"),
        urls.site_type(F.concat(F.element_at(sites, (F.col("page_id") % 3 + 1).cast("int")), F.col("url")), "other")
        .alias("kind"))


# ------------------------------------------------------------------ sources

@query("keyword_lines", """WITH x AS (SELECT p_partkey AS n, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS keyword,
  unnest([0, 1]) AS p FROM part WHERE p_type != 'PROMO')
SELECT keyword, min(n * 2 + p) // 2 AS line, min(n * 2 + p) % 2 AS place FROM x GROUP BY keyword""")
def keyword_lines(spark, sf):
    """Keyword lines from part names, promo parts commented out; first places."""
    lines = table(spark, sf, "part").select("p_partkey", F.concat(
        F.when(F.col("p_type") == "PROMO", "#").otherwise(" "),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(" ，,"))).alias("line"))
    return keywords.keywords_in_column(lines, "line", "p_partkey").select(
        "keyword", F.col("at.n").alias("line"), F.col("at.p").alias("place"))


@query("keyword_upload", """SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 2)
  ELSE split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 2) END AS keywords
FROM part""")
def keyword_upload(spark, sf):
    a, b = (F.element_at(F.split("p_name", " "), i) for i in (1, 2))
    upload = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("#"), a, F.lit("；\n"), b)).otherwise(
        F.concat(a, F.lit("\r\n;"), b, F.lit("，"), b, F.lit(", ")))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(keywords.uploaded_keywords(upload), "|").alias("keywords"))


@query("search_response", """SELECT c_name AS title, 'http://x/' || c_custkey AS url,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS publish_date, '中国公共资源交易网' AS source
FROM customer WHERE c_nationkey != 3""")
def search_response(spark, sf):
    item = F.struct(
        F.col("c_name").alias("title"),
        F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")).alias("url"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("publishDate"))
    body = F.when(F.col("c_nationkey") == 3, F.lit('{"data": "none"}')).otherwise(
        F.to_json(F.struct(F.array(item).alias("data"))))
    return search_json.parse_search_json(table(spark, sf, "customer").select(body.alias("body")), "body")
