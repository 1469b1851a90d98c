"""Invented notices: one expectation per rule."""

from decimal import Decimal

import pytest

from noticeflow.operators.html_blocks import html_blocks
from noticeflow.operators.notice_pages import parsed_notices
from noticeflow.plans.notice import card_candidates, format_notice, notices


def row(key, *values):
    return f"<tr><td class=title>{key}</td>" + "".join(f"<td>{v}</td>" for v in values) + "</tr>"


def table(*rows):
    return "<div class=table><table>" + "".join(rows) + "</table></div>"


def text(*lines):
    return "<div class=vF_detail_content>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>"


@pytest.fixture(scope="module")
def read(spark):
    def run(html, **options):
        blocks = html_blocks(spark.createDataFrame([("u", html)], "url string, html string"))
        return parsed_notices(blocks, **options).first().asDict(True)
    return run


@pytest.fixture(scope="module")
def cards(spark):
    def run(html):
        blocks = html_blocks(spark.createDataFrame([("u", html)], "url string, html string"))
        rows = card_candidates(notices(blocks), ["url"]).orderBy("cand_pos").collect()
        return [(r.company, r.contact_name, r.phones, r.emails, r.role) for r in rows]
    return run


def test_meta_prefers_tags(read):
    assert read("<meta name=ArticleTitle content=甲><meta name=PubDate content=''><h2 class='tc x'>乙</h2>"
                "<span id=pubTime> 2024-1-5 </span>")["meta"] == {"title": "甲", "publish_date": "2024-1-5"}
    assert read("<h2>丙</h2><h2 class=tc>乙<b>丁</b></h2>")["meta"] == {"title": "乙丁", "publish_date": ""}


def test_sections(read):
    s = read(text("项目编号：TC1", "项目编号：ZZ2", "项目名称：x:甲", "三、中标（成交）信息", "供应商名称：乙", "供应商地址：路",
                  "成交金额（元）:12", "供应商名称：丙", "主要标的信息", "货", "评审专家", "张、 李 、", "王", "代理服务费", "一",
                  "二", "公告期限", "三天", "五天", "其它补充事宜", "无", "凡对本次公告", "问", "<strong>答</strong>"))["sections"]
    assert (s["project_no"], s["project_name"]) == ("TC1", "甲")
    assert s["bid_info"] == {"supplier": "丙", "supplier_address": "路", "amount": "12"}
    assert s["experts"] == ["张", "李", "王"] and s["agency_fee"] == "一\n二\n"
    assert (s["announcement_period"], s["supplement"], s["contacts_raw"]) == ("五天", "无\n", "答")


def test_no_detail_text_means_empty_sections(read):
    got = read("<p>项目名称：甲</p>")
    assert got["sections"]["project_name"] == "" and got["content"] == ""
    assert got["contacts"]["buyer"]["name"] == ""


def test_table_contacts(read):
    c = read(table(row("采购单位地址", "早"), row("采购单位", "甲"), row("采购单位联系方式", "李雷 010-61110000 A@b.cn"),
                   row("代理机构名称", "乙"), row("代理机构联系人", "王五13811112222，赵六、,010-62223333"),
                   row("项目联系人", "孙、 周13900001111"), row("项目联系电话", "123")))["contacts"]
    # The address came before the name row, which starts the buyer afresh.
    assert c["buyer"] == {"name": "甲", "address": "", "contact_name": "李雷", "phone": "010-61110000",
                          "email": "A@b.cn", "contacts_list": []}
    assert [(p["name"], p["phone"]) for p in c["agent"]["contacts_list"]] == [
        ("王五", "13811112222"), ("赵六", ""), ("", "010-62223333")]
    assert (c["agent"]["contact_name"], c["agent"]["phone"]) == ("王五", "13811112222")
    assert [(p["name"], p["phone"]) for p in c["project"]["details"]] == [("孙", ""), ("周", "13900001111")]
    assert c["project"]["phone"] == "123"


def test_text_contacts_of_buyer(read):
    def buyer(*lines):
        c = read(text("1.采购人信息", *lines))["contacts"]["buyer"]
        return c["name"], c["address"], c["contact_name"], c["phone"], c["email"]

    assert buyer("名　称：x", "名称：甲", "地址：路", "电话：见 13811112222") == ("甲", "路", "", "13811112222", "")
    assert buyer("联系方式：李雷、010-61110000") == ("", "", "李雷", "010-61110000", "")
    # Without a full number the whole cell is split, and clears what was there.
    assert buyer("电话：13811112222", "联系方式：李雷 a@b.cn") == ("", "", "李雷", "", "a@b.cn")
    # A bare number leaves the name alone.
    assert buyer("联系方式：李雷 a@b.cn", "联系方式：13811112222") == ("", "", "李雷", "13811112222", "a@b.cn")


def test_text_contacts_of_agent(read):
    def agent(*lines):
        c = read(text("2.采购代理机构信息", *lines))["contacts"]["agent"]
        return c["contact_name"], c["phone"], [(p["name"], p["phone"]) for p in c["contacts_list"]]

    assert agent("联系人：王五、赵六 010-62223333/4444") == (
        "王五", "010-62223333, 010-62224444",
        [("王五", "010-62223333, 010-62224444"), ("赵六", "010-62223333, 010-62224444")])
    # A later phone line fills in missing numbers, the first one only.
    assert agent("联系人：王五", "电话：010-62223333", "电话：010-65556666") == (
        "王五", "010-65556666", [("王五", "010-62223333")])
    # A phone line before the list does not.
    assert agent("电话：010-62223333", "联系方式：王五") == ("王五", "", [("王五", "")])
    # A list line without names empties the list but keeps the first name.
    assert agent("联系人：王五 010-62223333", "联系方式：13811112222") == ("王五", "13811112222", [])


def test_text_contacts_of_project(read):
    c = read(text("3.项目联系方式", "项目联系人：孙丽、周涛13900001111", "电 话：010-1:2", "电　话：3"))["contacts"]["project"]
    assert [(p["name"], p["phone"]) for p in c["details"]] == [("孙丽", ""), ("周涛", "13900001111")]
    assert c["phone"] == "2"


def test_heading_line_is_read_too(read):
    c = read(text("代理机构名称：乙", "凡对本次公告，代理机构", "地址：路"))["contacts"]["agent"]
    assert (c["name"], c["address"]) == ("乙", "路")


def test_text_replaces_table_even_if_empty(read):
    html = table(row("采购单位", "甲"), row("采购单位联系方式", "李雷 010-61110000")) + text("其他")
    assert read(html)["contacts"]["buyer"]["name"] == ""
    assert read(html, fill_gaps=True)["contacts"]["buyer"]["contact_name"] == "李雷"


def test_experts_are_removed(read):
    got = read(text("评审专家", "李雷、王五", "凡对本次公告", "1.采购人信息", "联系方式：李雷 010-61110000",
                    "2.代理机构", "联系人：王五、赵六", "3.项目联系方式", "项目联系人：李雷"))["contacts"]
    assert got["buyer"]["contact_name"] == "" and got["buyer"]["phone"] == "010-61110000"
    assert [p["name"] for p in got["agent"]["contacts_list"]] == ["赵六"]
    assert [p["name"] for p in got["project"]["details"]] == ["李雷"]


def test_format_prefers_summary_or_text(spark):
    html = (table(row("项目名称", "表"), row("供应商名称", "表商"), row("总中标金额", "3万元"), row("采购单位", "表人"),
                  row("采购单位联系方式", "李雷 010-61110000"))
            + text("项目名称：文", "中标（成交）信息", "供应商名称：文商", "采购人信息", "名称：文人", "电话：13811112222"))
    blocks = html_blocks(spark.createDataFrame([("u", html)], "url string, html string"))
    r = format_notice(parsed_notices(blocks)).first()
    assert (r.project_name, r.supplier, r.buyer_name) == ("表", "文商", "表人")
    assert (r.bid_amount, r.bid_yuan) == ("3万元", Decimal("30000.00"))
    assert (r.buyer_contact, r.buyer_phone) == ("李雷 010-61110000", "13811112222")


def sides(agent="招标公司", agent_phone="010-62223333", project_phone="", people="孙丽、周涛13900001111"):
    lines = ["采购人信息", "名称：大学", "联系方式：李雷010-61110000"]
    if agent:
        lines += ["2.代理机构", f"名称：{agent}", f"联系人：王五 {agent_phone}"]
    return text(*lines, "项目联系方式", f"项目联系人：{people}", f"电话：{project_phone}")


@pytest.mark.parametrize("html, owner, role", [
    (sides(project_phone="62223333"), "招标公司", "agent"),           # agent's number without area code
    (sides(project_phone="0086-10-61110000"), "大学", "buyer"),
    (sides(project_phone="55556666"), "招标公司", "agent"),           # nobody's: the agent's staff
    (sides(project_phone=""), "招标公司", "agent"),
    (sides(agent="", project_phone="55556666"), "大学", "buyer"),
    (sides(project_phone="5556666", agent_phone="010-15556666"), "招标公司", "agent"),
])
def test_project_contact_owner(cards, html, owner, role):
    got = {name: (company, r) for company, name, _, _, r in cards(html)}
    assert got["孙丽"] == (owner, role) and got["周涛"] == (owner, role)


def test_project_contact_with_own_number(cards):
    got = {n: (c, p) for c, n, p, _, _ in cards(sides(project_phone="55556666", people="孙丽、周涛010-61110000"))}
    assert got["孙丽"] == ("招标公司", ["55556666"])
    assert got["周涛"] == ("大学", ["010-61110000", "55556666"])


def test_candidates(cards):
    html = table(row("采购单位", "甲、大学"), row("采购单位联系方式", "李雷 a@B.cn"), row("供应商名称", "商"),
                 row("代理机构名称", "乙"), row("代理机构联系方式", "王五、王五13811112222、赵"))
    assert cards(html) == [
        ("甲大学", "李雷 a@B.cn", [], ["a@b.cn"], "buyer"),
        ("商", "", [], [], "supplier"),
        ("乙", "王五", [], [], "agent"),
        ("乙", "", [], [], "agent"),                       # one letter is no name
        ("乙", "王五、王五13811112222、赵", ["13811112222"], [], "agent"),
    ]
