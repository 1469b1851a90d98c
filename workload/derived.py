"""Notice pages that Spark derives from the customer table.

One page per customer. The market segment decides the shape of the page:

* AUTOMOBILE  summary table only
* BUILDING    table and detail text, the text's contacts count
* FURNITURE   detail text only, agent with two contacts and shortened numbers
* HOUSEHOLD   detail text only, no agent
* MACHINERY   table with spans and detail text, a contact on the review panel
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeflow.sources.pages import spread

from .roles import table


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _p(*parts: str | Column) -> list:
    return ["<p>", *parts, "</p>"]


def notice_pages(spark: SparkSession, sf: str) -> DataFrame:
    """url, html, page_id, ingest_seq."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    x = spread(table(spark, sf, "customer")).select(
        "c_custkey", "c_name", k.alias("k"), n.alias("n"), F.col("c_mktsegment").alias("seg"),
        F.abs(F.floor("c_acctbal")).cast("string").alias("amount"),
        _cat("010-6", F.lpad(k, 7, "0")).alias("bp"), _cat("021-5", F.lpad(n, 7, "0")).alias("ap"),
        _cat("138", F.lpad(k, 8, "0")).alias("mp"))
    col = F.col
    table_only, panel = col("seg") == "AUTOMOBILE", col("seg") == "MACHINERY"
    with_table = col("seg").isin("AUTOMOBILE", "BUILDING", "MACHINERY")
    with_agent = col("seg") != "HOUSEHOLD"

    def row(label: str, *value: str | Column) -> list:
        return ["<tr><td class='t title'>", label, "</td><td colspan=3>", *value, "</td></tr>"]

    summary = _cat(
        '<div class="vF table"><table class="x">',
        *row("采购项目名称：", "项目 ", col("k")), *row("品目", "货物"), *row("行政区域", "省", col("n")),
        *row("采购单位", "大学", col("n")), *row("采购单位地址", "校园", col("k"), "号"),
        F.when(col("seg") == "BUILDING", "").otherwise(_cat(*row("采购单位联系方式", "李雷 ", col("bp")))),
        *row("代理机构名称", "招标", col("n")),
        F.when(table_only, _cat(*row("代理机构联系方式", "赵敏", col("mp"), "、钱进 ", col("ap")))).otherwise(""),
        *row("项目联系人", "孙丽、周涛"),
        *row("项目联系电话", F.when(table_only, F.right(col("bp"), F.lit(8))).otherwise(
            F.when(panel, col("mp")).otherwise(col("bp")))),
        # A key over two rows and a ragged last row.
        F.when(panel, "<tr><th rowspan=2>中标单位<td rowspan=2>乙方<td>备注<td>一<tr><td>备注<td>二"
               ).otherwise(""),
        *row("总中标金额", "￥", col("amount"), ".50万元"), "</table></div>")

    agent_lines = _cat(
        *_p("2.采购代理机构信息"), *_p("名 称：招标", col("n")), *_p("地址：", col("n"), "路2号"),
        *_p("联系方式：", F.when(panel, "王强").otherwise("赵敏"), "、陈明 ", col("ap"), "/1234"))
    detail = _cat(
        "<div class='main vF_detail_content'>", *_p("一、项目编号：TC-", col("k")),
        *_p("二、项目名称：采购 ", col("k")), *_p("三、中标（成交）信息"),
        *_p("供应商名称：", col("c_name")), *_p("供应商地址：", col("n"), "路1号"),
        *_p("中标金额：", col("amount"), "万元"), *_p("五、评审专家名单："), *_p("王强、刘洋"),
        *_p("六、代理服务费"), *_p("按标准"), *_p("另计"), *_p("七、公告期限"), *_p("1个工作日"),
        *_p("八、其他补充事宜"), *_p("无"), *_p("九、凡对本次公告内容提出询问，请联系"),
        *_p("1.采购人信息"), *_p("名称：大学", col("n")), *_p("地址：校园", col("k")),
        *_p("联系方式：李雷，", col("bp")), F.when(with_agent, agent_lines).otherwise(""),
        *_p("3.项目联系方式"), *_p("项目联系人：孙丽、周涛"),
        "<p>电话：", F.when(col("seg") == "FURNITURE", col("ap")).otherwise(col("bp")), "</div>")
    html = _cat(
        "<!DOCTYPE html><html><head>",
        F.when(table_only, "").otherwise(_cat(
            '<meta name="ArticleTitle" content="公告 ', col("k"), '"><meta name="PubDate" content="2024年1月',
            col("n"), '日 09:00">')),
        "<title>站点</title></head><body><script>var a='<p>项目名称：假</p>';</script>",
        F.when(table_only, _cat("<h2 class='tc'>公告 ", col("k"),
                                "</h2><span id=pubTime>2024年1月", col("n"), "日 09:00</span>")).otherwise(""),
        F.when(with_table, summary).otherwise(""), F.when(table_only, "").otherwise(detail),
        "</body></html>")
    return x.select(
        col("c_custkey").alias("page_id"), _cat("http://notice.example/", col("k"), ".htm").alias("url"),
        html.alias("html"), col("c_custkey").cast("long").alias("ingest_seq"))


# The same facts in SQL, one row per page.
N = """n AS (SELECT c_custkey AS page_id, 'http://notice.example/' || c_custkey || '.htm' AS url,
  CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n, c_mktsegment AS seg, c_name,
  CAST(abs(CAST(floor(c_acctbal) AS BIGINT)) AS VARCHAR) AS amount,
  '010-6' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS bp,
  '021-5' || lpad(CAST(c_nationkey AS VARCHAR), 7, '0') AS ap,
  '021-5000' || '1234' AS ap2,
  '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS mp,
  c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AS has_table,
  c_mktsegment != 'AUTOMOBILE' AS has_text FROM customer)"""


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One stored search-result page per customer with three listed items."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    html = _cat(
        "<html><body><ul class='vT-srch-result-list-bid'>",
        "<li><a href='/cggg/", k, ".htm' style='x'>公告 <font color=red>中标</font> ", k,
        "</a><p>摘要</p><span>2024.01.05 10:00:00 | 采购人：大学", n, " | 代理机构：招标", n, "<br><b>类</b></span>",
        "<li><a name=none>无链接</a></li>",
        "<li><div><a href='http://other.example/", k, "'>第二条 ", k, "</a></div></li></ul>",
        "<ul><li><a href='/no.htm'>不在列表内</a></li></ul></body></html>")
    return spread(table(spark, sf, "customer")).select(
        F.col("c_custkey").alias("page_id"), html.alias("html"))
