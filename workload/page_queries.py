"""Page parsing, over the stored pages and over pages derived from customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.operators import cards, generic_pages, notice_pages, notice_tables
from noticeflow.operators.html_blocks import html_blocks
from noticeflow.operators.refused import refused
from noticeflow.plans import ingest, notice
from noticeflow.session import shared_dir
from noticeflow.sources.pages import spread

from .derived import N
from .derived import notice_pages as derived_notices
from .derived import result_pages
from .notice_queries import TITLED, titled
from .registry import query
from .roles import pages, table

# ------------------------------------------------------------- stored pages

@query("page_blocks", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(
  regexp_replace(html, '<script>.*</script>', '<script>', 'g'), '<([a-z0-9]+)', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""")
def page_blocks(spark, sf):
    """Elements per page and tag."""
    b = html_blocks(pages(spark, sf).select("page_id", "html"))
    return (b.select("page_id", F.explode("els.tag").alias("tag")).filter("tag != '#root'")
            .groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n")))


# The four escapes the pages use; as in HTML, the closing semicolon may be missing.
UNESCAPE = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), "
            "'&quot;?', '\"', 'g'), '&amp;?', '&', 'g')")
H1 = UNESCAPE.format("trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'))")
HEAD = UNESCAPE.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")


@query("page_titles", f"""SELECT page_id, CASE WHEN length({H1}) > 5 THEN {H1}
  WHEN length({HEAD}) > 5 THEN {HEAD} ELSE '未知标题' END AS title FROM pages""")
def page_titles(spark, sf):
    b = html_blocks(pages(spark, sf).select("page_id", "html"))
    return b.select("page_id", generic_pages.page_title().alias("title"))


ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"


@query("page_details", f"""WITH r AS (SELECT page_id, html,
  list_filter(list_transform(regexp_split_to_array({ARTICLE}, '<[^>]*>'),
    lambda s: trim({UNESCAPE.format('s')}, ' ' || chr(10) || chr(9))), lambda s: s != '') AS runs FROM pages)
SELECT page_id, array_to_string(runs, chr(10)) AS content FROM r""")
def page_details(spark, sf):
    """Main text of every page; each holds one article."""
    b = html_blocks(pages(spark, sf).select("page_id", "html"))
    return generic_pages.generic_detail(b).select("page_id", "content")


@query("page_links", f"""WITH l AS (SELECT page_id, url, generate_subscripts(a, 1) AS n, unnest(a) AS item
  FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS a FROM pages)),
h AS (SELECT page_id, n, {UNESCAPE.format("trim(regexp_extract(item, '>([^<>]*)</a>', 1))")} AS link_title,
  regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || {UNESCAPE.format("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS link_url FROM l)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS link_pos, link_title, link_url
FROM h WHERE length(link_title) >= 10""")
def page_links(spark, sf):
    """Links of list items; no other selector finds any on these pages."""
    b = html_blocks(pages(spark, sf))
    return generic_pages.page_links(b).select("page_id", F.col("link_pos").cast("long").alias("link_pos"),
                                              "link_title", "link_url")


@query("page_contacts", r"""SELECT page_id, nullif(regexp_extract(html, '1[3-9][0-9]{9}', 0), '') AS phone,
  nullif(regexp_extract(html, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0), '') AS email FROM pages""")
def page_contacts(spark, sf):
    b = html_blocks(pages(spark, sf).select("page_id", "html"))
    return generic_pages.generic_contact(b).select("page_id", "phone", "email")


@query("titled_links", """SELECT c_custkey AS page_id, 0 AS link_pos, '公告中标' || c_custkey AS link_title,
  'https://www.ccgp.gov.cn/cggg/' || c_custkey || '.htm' AS link_url FROM customer""")
def titled_links(spark, sf):
    b = html_blocks(result_pages(spark, sf))
    return generic_pages.titled_links(b, "中标").select(
        "page_id", "link_pos", "link_title", "link_url")


@query("refusal_pages", """SELECT page_id FROM pages
WHERE contains(lower(html), 'captcha') OR contains(html, '访问过于频繁') OR contains(html, '稍后再试')
  OR page_id % 7 = 0""")
def refusal_pages(spark, sf):
    """Every seventh page gets a refusal line in its text, every fifth one in a script."""
    p = pages(spark, sf).select("page_id", F.concat(
        F.when(F.col("page_id") % 5 == 0, "<script>captcha</script>").otherwise(""),
        F.when(F.col("page_id") % 7 == 0, "<p>请输入<b>Captcha</b></p>").otherwise(""), "html").alias("html"))
    b = html_blocks(p)
    return b.filter(refused(generic_pages.page_text("", all_text=True), wide=True)).select("page_id")


@query("result_items", """SELECT c_custkey AS page_id, 0 AS item_pos, '公告 中标 ' || c_custkey AS title,
  'https://www.ccgp.gov.cn/cggg/' || c_custkey || '.htm' AS item_url, '2024.01.05 10:00:00' AS publish_date,
  '大学' || c_nationkey AS buyer_name, '招标' || c_nationkey || ' 类' AS agent_name, 'ccgp-bxsearch' AS source FROM customer
UNION ALL SELECT c_custkey, 2, '第二条 ' || c_custkey, 'http://other.example/' || c_custkey, '', '', '', 'ccgp-bxsearch'
FROM customer""")
def result_items(spark, sf):
    b = html_blocks(result_pages(spark, sf))
    return generic_pages.result_items(b)


@query("listed_notices", f"""WITH {TITLED}, x AS (SELECT p_partkey AS page_id, title || '公告' AS link_title,
  'http://list.example/n/' || p_partkey || '.html' AS link_url, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS day
  FROM part JOIN t ON t.id = p_partkey
  WHERE (title LIKE '%中标%' OR title LIKE '%成交%' OR title LIKE '%结果%') AND title NOT LIKE '%更正%')
SELECT page_id, 0 AS link_pos, link_title, link_url, CAST(NULL AS VARCHAR) AS link_date FROM x
UNION ALL SELECT page_id, 1, link_title, link_url, day FROM x WHERE day >= '2024-01-16'""")
def listed_notices(spark, sf):
    """One link per page, found as a link (without date) and as a list item (with one)."""
    key = F.col("p_partkey").cast("string")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    p = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("page_id"), F.lit("http://list.example/index.htm").alias("url"),
        F.concat(F.lit("<ul><li><a href='n/"), key, F.lit(".html'>"), titled(F.col("p_type")),
                 F.lit("公告</a><span>"), day, F.lit("</span></ul>")).alias("html"))
    return generic_pages.listed_notices(html_blocks(p), "2024-02-15 00:00:00").drop("url")


# ------------------------------------------------------------ derived notices

def _blocks(spark, sf):
    return html_blocks(derived_notices(spark, sf).drop("ingest_seq"))


@query("notice_meta", f"""WITH {N} SELECT page_id, '公告 ' || k AS title, '2024年1月' || n || '日 09:00' AS publish_date FROM n""")
def notice_meta(spark, sf):
    return (_blocks(spark, sf).select("page_id", notice_pages.notice_meta().alias("m"))
            .select("page_id", "m.*"))


SPANNED = ((9, 9, 0, "中标单位", True), (9, 9, 1, "乙方", False), (9, 9, 2, "备注", False), (9, 9, 3, "一", False),
           (10, 9, 0, "中标单位", True), (10, 9, 1, "乙方", False), (10, 10, 2, "备注", False),
           (10, 10, 3, "二", False))
SPANNED_VALUES = ", ".join(f"({r}, {s}, {c}, '{t}', {h})" for r, s, c, t, h in SPANNED)


@query("table_cells", f"""WITH {N}, w(r, s, c, t, h) AS (VALUES {SPANNED_VALUES})
SELECT page_id, 0 AS "row", 0 AS src_row, 0 AS col, 1 AS width, '采购项目名称：' AS text, true AS is_header FROM n WHERE has_table
UNION ALL SELECT page_id, 0, 0, 1, 3, '项目 ' || k, false FROM n WHERE has_table
UNION ALL SELECT page_id, r, s, c, 1, t, h FROM n, w WHERE seg = 'MACHINERY'""")
def table_cells(spark, sf):
    """The first row of every table, and the cells of the rows with row spans."""
    cells = notice_tables.table_cells(_blocks(spark, sf))
    spanned = [t for _, _, _, t, _ in SPANNED]
    return cells.filter((F.col("row") == 0) | F.col("text").isin(*spanned)).select(
        "page_id", "row", "src_row", "col", "width", "text", "is_header")


@query("table_profile", f"""WITH {N} SELECT page_id, CASE seg WHEN 'AUTOMOBILE' THEN 11 WHEN 'BUILDING' THEN 9 ELSE 12 END AS total_rows,
  3 AS max_cols, true AS has_colspan, seg = 'MACHINERY' AS has_rowspan,
  CASE seg WHEN 'AUTOMOBILE' THEN 11 WHEN 'BUILDING' THEN 9 ELSE 11 END AS header_rows,
  CASE seg WHEN 'MACHINERY' THEN 'high' ELSE 'medium' END AS complexity FROM n WHERE has_table""")
def table_profile(spark, sf):
    return notice_tables.table_profile(_blocks(spark, sf)).drop("table_no", "url")


@query("table_fields", f"""WITH {N} SELECT page_id, '项目 ' || k AS name, '货物' AS category, '省' || n AS region,
  '大学' || n AS buyer, '校园' || k || '号' AS buyer_address, CASE seg WHEN 'BUILDING' THEN '' ELSE '李雷 ' || bp END AS buyer_contact,
  '招标' || n AS agent, CASE seg WHEN 'AUTOMOBILE' THEN '赵敏' || mp || '、钱进 ' || ap ELSE '' END AS agent_contact,
  '孙丽、周涛' AS project_names, CASE seg WHEN 'AUTOMOBILE' THEN right(bp, 8) WHEN 'MACHINERY' THEN mp ELSE bp END AS project_phone,
  CASE seg WHEN 'MACHINERY' THEN '乙方' ELSE '' END AS supplier, '￥' || amount || '.50万元' AS total FROM n WHERE has_table""")
def table_fields(spark, sf):
    fields = {"name": "project_info.name", "category": "project_info.category",
              "region": "project_info.region", "buyer": "buyer.name", "buyer_address": "buyer.address",
              "buyer_contact": "buyer.contact", "agent": "agent.name", "agent_contact": "agent.contact",
              "project_names": "contacts.name", "project_phone": "contacts.phone",
              "supplier": "supplier.name", "total": "amount.total"}
    return (_blocks(spark, sf).select("page_id", notice_tables.key_values().alias("p"))
            .filter(F.size("p") > 0)
            .select("page_id", notice_tables.summary_fields(F.col("p")).alias("s"))
            .select("page_id", *[F.col(f"s.{path}").alias(name) for name, path in fields.items()]))


@query("notice_sections", f"""WITH {N} SELECT page_id, 'TC-' || k AS project_no, '采购 ' || k AS project_name, c_name AS supplier,
  n || '路1号' AS supplier_address, amount || '万元' AS amount, '王强|刘洋' AS experts, '按标准' || chr(10) || '另计' || chr(10) AS agency_fee,
  '1个工作日' AS period, '无' || chr(10) AS supplement,
  '电话：' || CASE seg WHEN 'FURNITURE' THEN ap ELSE bp END AS contacts_raw FROM n WHERE has_text""")
def notice_sections(spark, sf):
    fields = {"project_no": "project_no", "project_name": "project_name", "supplier": "bid_info.supplier",
              "supplier_address": "bid_info.supplier_address", "amount": "bid_info.amount",
              "agency_fee": "agency_fee", "period": "announcement_period", "supplement": "supplement",
              "contacts_raw": "contacts_raw"}
    return (_blocks(spark, sf).filter(notice_pages.detail_div().isNotNull())
            .select("page_id", notice_pages.notice_sections().alias("s"))
            .select("page_id", F.array_join("s.experts", "|").alias("experts"),
                    *[F.col(f"s.{path}").alias(name) for name, path in fields.items()]))


def _people(col):
    return F.array_join(F.transform(col, lambda c: F.concat_ws("/", c["name"], c["phone"])), "|")


def _sides(df):
    fields = {"buyer": "buyer.name", "buyer_contact": "buyer.contact_name", "buyer_phone": "buyer.phone",
              "agent": "agent.name", "agent_contact": "agent.contact_name", "agent_phone": "agent.phone",
              "project_phone": "project.phone"}
    return df.select("page_id", _people(F.col("contacts.agent.contacts_list")).alias("agent_people"),
                     _people(F.col("contacts.project.details")).alias("project_people"),
                     *[F.col(f"contacts.{path}").alias(name) for name, path in fields.items()])


TABLE_SIDES = """SELECT page_id, '大学' || n AS buyer, CASE seg WHEN 'BUILDING' THEN '' ELSE '李雷' END AS buyer_contact,
  CASE seg WHEN 'BUILDING' THEN '' ELSE bp END AS buyer_phone, '招标' || n AS agent,
  CASE seg WHEN 'AUTOMOBILE' THEN '赵敏' ELSE '' END AS agent_contact,
  CASE seg WHEN 'AUTOMOBILE' THEN mp ELSE '' END AS agent_phone,
  CASE seg WHEN 'AUTOMOBILE' THEN '赵敏/' || mp || '|钱进/' || ap ELSE '' END AS agent_people,
  '孙丽/|周涛/' AS project_people,
  CASE seg WHEN 'AUTOMOBILE' THEN right(bp, 8) WHEN 'MACHINERY' THEN mp ELSE bp END AS project_phone"""
TEXT_SIDES = """SELECT page_id, '大学' || n AS buyer, '李雷' AS buyer_contact, bp AS buyer_phone,
  CASE seg WHEN 'HOUSEHOLD' THEN '' ELSE '招标' || n END AS agent,
  CASE seg WHEN 'HOUSEHOLD' THEN '' WHEN 'MACHINERY' THEN {panel} ELSE '赵敏' END AS agent_contact,
  CASE seg WHEN 'HOUSEHOLD' THEN '' ELSE {phones} END AS agent_phone,
  CASE seg WHEN 'HOUSEHOLD' THEN '' WHEN 'MACHINERY' THEN {panel_people} ELSE '赵敏/' || {phones} || '|' END
    || CASE seg WHEN 'HOUSEHOLD' THEN '' ELSE '陈明/' || {phones} END AS agent_people,
  '孙丽/|周涛/' AS project_people, CASE seg WHEN 'FURNITURE' THEN ap ELSE bp END AS project_phone"""
AGENT_PHONES = "(CASE WHEN ap = ap2 THEN ap ELSE ap || ', ' || ap2 END)"
RAW_TEXT_SIDES = TEXT_SIDES.format(phones=AGENT_PHONES, panel="'王强'",
                                   panel_people="'王强/' || " + AGENT_PHONES + " || '|'")
CLEAN_TEXT_SIDES = TEXT_SIDES.format(phones=AGENT_PHONES, panel="''", panel_people="''")


@query("table_contacts", f"WITH {N} {TABLE_SIDES} FROM n WHERE has_table")
def table_contacts(spark, sf):
    b = _blocks(spark, sf).filter(notice_tables.summary_table().isNotNull())
    return _sides(b.select("page_id", notice_pages.table_contacts().alias("contacts")))


@query("text_contacts", f"WITH {N} {RAW_TEXT_SIDES} FROM n WHERE has_text")
def text_contacts(spark, sf):
    b = _blocks(spark, sf).filter(notice_pages.detail_div().isNotNull())
    return _sides(b.select("page_id", notice_pages.text_contacts().alias("contacts")))


@query("notice_contacts", f"WITH {N} {TABLE_SIDES} FROM n WHERE NOT has_text UNION ALL {CLEAN_TEXT_SIDES} FROM n WHERE has_text")
def notice_contacts(spark, sf):
    """Text over table, panel members removed."""
    return _sides(notice_pages.parsed_notices(_blocks(spark, sf)))


CONTENT = """array_to_string(list_concat(
  ['一、项目编号：TC-' || k, '二、项目名称：采购 ' || k, '三、中标（成交）信息', '供应商名称：' || c_name, '供应商地址：' || n || '路1号',
   '中标金额：' || amount || '万元', '五、评审专家名单：', '王强、刘洋', '六、代理服务费', '按标准', '另计', '七、公告期限', '1个工作日',
   '八、其他补充事宜', '无', '九、凡对本次公告内容提出询问，请联系', '1.采购人信息', '名称：大学' || n, '地址：校园' || k, '联系方式：李雷，' || bp],
  CASE WHEN seg = 'HOUSEHOLD' THEN [] ELSE ['2.采购代理机构信息', '名 称：招标' || n, '地址：' || n || '路2号',
   '联系方式：' || CASE seg WHEN 'MACHINERY' THEN '王强' ELSE '赵敏' END || '、陈明 ' || ap || '/1234'] END,
  ['3.项目联系方式', '项目联系人：孙丽、周涛', '电话：' || CASE seg WHEN 'FURNITURE' THEN ap ELSE bp END]), chr(10))"""


@query("notice_text", f"WITH {N} SELECT page_id, CASE WHEN has_text THEN {CONTENT} ELSE '' END AS text FROM n")
def notice_text(spark, sf):
    return _blocks(spark, sf).select("page_id", notice_pages.full_text().alias("text"))


FLAT_SQL = f"""WITH {N} SELECT page_id, '公告 ' || k AS title, CASE WHEN has_text THEN 'TC-' || k ELSE '' END AS project_no,
  CASE WHEN has_table THEN '项目 ' || k ELSE '采购 ' || k END AS project_name,
  CASE WHEN has_table THEN '省' || n ELSE '' END AS region,
  CASE WHEN has_text THEN c_name ELSE '' END AS supplier,
  CAST(amount AS DOUBLE) * 10000 + CASE WHEN has_text THEN 0 ELSE 5000 END AS bid_yuan, '大学' || n AS buyer_name,
  CASE WHEN seg IN ('AUTOMOBILE', 'MACHINERY') THEN '李雷 ' || bp ELSE '李雷' END AS buyer_contact, bp AS buyer_phone,
  CASE seg WHEN 'HOUSEHOLD' THEN '' ELSE '招标' || n END AS agent_name,
  CASE seg WHEN 'AUTOMOBILE' THEN '赵敏' || mp || '、钱进 ' || ap WHEN 'HOUSEHOLD' THEN '' WHEN 'MACHINERY' THEN '' ELSE '赵敏' END AS agent_contact,
  CASE seg WHEN 'AUTOMOBILE' THEN mp WHEN 'HOUSEHOLD' THEN '' ELSE {AGENT_PHONES} END AS agent_phone,
  '孙丽/|周涛/' AS project_contacts,
  CASE seg WHEN 'AUTOMOBILE' THEN right(bp, 8) WHEN 'MACHINERY' THEN mp WHEN 'FURNITURE' THEN ap ELSE bp END AS project_phone,
  CASE WHEN has_text THEN '王强, 刘洋' ELSE '' END AS experts, '2024年1月' || n || '日 09:00' AS publish_date,
  '中国公共资源交易网' AS source, CASE WHEN has_table THEN '货物' ELSE '' END AS category,
  CASE WHEN has_text THEN n || '路1号' ELSE '' END AS supplier_address,
  CASE WHEN has_text THEN amount || '万元' ELSE '￥' || amount || '.50万元' END AS bid_amount,
  '校园' || k || CASE WHEN has_table THEN '号' ELSE '' END AS buyer_address, '' AS buyer_email,
  CASE WHEN seg IN ('AUTOMOBILE', 'HOUSEHOLD') THEN '' ELSE n || '路2号' END AS agent_address, '' AS agent_email,
  CASE seg WHEN 'AUTOMOBILE' THEN '赵敏/' || mp || '|钱进/' || ap WHEN 'HOUSEHOLD' THEN ''
    WHEN 'MACHINERY' THEN '陈明/' || {AGENT_PHONES}
    ELSE '赵敏/' || {AGENT_PHONES} || '|陈明/' || {AGENT_PHONES} END AS agent_people, url,
  CASE WHEN has_text THEN {CONTENT} ELSE '' END AS content FROM n"""


@query("flat_notices", FLAT_SQL)
def flat_notices(spark, sf):
    """Every stored field."""
    return notice.notices(_blocks(spark, sf)).select(
        "page_id", "title", "project_no", "project_name", "region", "supplier",
        F.col("bid_yuan").cast("double").alias("bid_yuan"), "buyer_name", "buyer_contact", "buyer_phone",
        "agent_name", "agent_contact", "agent_phone", _people(F.col("project_contacts")).alias("project_contacts"),
        "project_phone", "experts", "publish_date", "source", "category", "supplier_address", "bid_amount",
        "buyer_address", "buyer_email", "agent_address", "agent_email",
        _people(F.col("agent_contacts_list")).alias("agent_people"), "url", "content")


CANDIDATES_SQL = f"""cand AS (
  SELECT page_id, '大学' || n AS company, CASE WHEN seg IN ('AUTOMOBILE', 'MACHINERY') THEN '李雷 ' || bp ELSE '李雷' END AS contact_name,
    bp AS phones, 'buyer' AS role FROM n
  UNION ALL SELECT page_id, c_name, '', '', 'supplier' FROM n WHERE has_text
  UNION ALL SELECT page_id, '招标' || n, '赵敏', mp, 'agent' FROM n WHERE seg = 'AUTOMOBILE'
  UNION ALL SELECT page_id, '招标' || n, '钱进', ap, 'agent' FROM n WHERE seg = 'AUTOMOBILE'
  UNION ALL SELECT page_id, '招标' || n, '', mp, 'agent' FROM n WHERE seg = 'AUTOMOBILE'
  UNION ALL SELECT page_id, '招标' || n, '赵敏', replace({AGENT_PHONES}, ', ', ','), 'agent' FROM n WHERE seg IN ('BUILDING', 'FURNITURE')
  UNION ALL SELECT page_id, '招标' || n, '陈明', replace({AGENT_PHONES}, ', ', ','), 'agent' FROM n WHERE seg IN ('BUILDING', 'FURNITURE', 'MACHINERY')
  UNION ALL SELECT page_id, CASE WHEN seg IN ('MACHINERY', 'FURNITURE') THEN '招标' || n ELSE '大学' || n END, who,
    CASE seg WHEN 'AUTOMOBILE' THEN right(bp, 8) WHEN 'MACHINERY' THEN mp WHEN 'FURNITURE' THEN ap ELSE bp END,
    CASE WHEN seg IN ('MACHINERY', 'FURNITURE') THEN 'agent' ELSE 'buyer' END FROM n, (VALUES ('孙丽'), ('周涛')) w(who))"""


@query("notice_candidates", f"WITH {N}, {CANDIDATES_SQL} SELECT * FROM cand")
def notice_candidates(spark, sf):
    flat = notice.notices(_blocks(spark, sf))
    return notice.card_candidates(flat, ["page_id"]).select(
        "page_id", "company", "contact_name", F.array_join("phones", ",").alias("phones"), "role")


@query("notice_cards", f"""WITH {N}, {CANDIDATES_SQL}, one AS (SELECT company, contact_name, page_id, role,
    unnest(string_split(phones, ',')) AS phone FROM cand WHERE contact_name != '')
SELECT company, contact_name, array_to_string(list_sort(list(DISTINCT phone)), ',') AS phones,
  count(DISTINCT page_id) AS projects, count(DISTINCT (page_id, role)) AS mentions
FROM one GROUP BY company, contact_name""")
def notice_cards(spark, sf):
    """Candidates of all notices merged into cards, with their mentions."""
    candidates = notice.card_candidates(notice.notices(_blocks(spark, sf)), ["page_id"])
    shared_dir(spark)
    # Read twice below: written once, so that pages are parsed once.
    kept = ingest.kept_candidates(
        candidates.withColumnRenamed("page_id", "announcement_id")).checkpoint()
    merged = cards.combine_cards(cards.seen_cards(kept, F.current_timestamp()))
    m = cards.distinct_mentions(ingest.mentions_of(kept))
    per_card = m.groupBy("business_card_id").agg(
        F.countDistinct("announcement_id").alias("projects"), F.count(F.lit(1)).alias("mentions"))
    return (merged.join(per_card, merged["id"] == per_card["business_card_id"])
            .select("company", "contact_name", F.array_join("phones", ",").alias("phones"), "projects",
                    "mentions"))


@query("notice_winners", f"WITH {N} SELECT page_id AS announcement_id, c_name AS company FROM n WHERE has_text")
def notice_winners(spark, sf):
    candidates = notice.card_candidates(notice.notices(_blocks(spark, sf)), ["page_id"])
    return ingest.winners_of(candidates.withColumnRenamed("page_id", "announcement_id"))
