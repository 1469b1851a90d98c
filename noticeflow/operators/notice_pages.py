"""Fields, sections and contacts of one kind of notice page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chars import (built_once, first, first_filled, last, let, none_if_empty, split_filled,
                               strip, text_or_empty)
from ..functions.contact import expand_phones, first_phone, names_of_line, split_contact
from ..functions.text import after_last_colon
from . import dom
from .notice_tables import key_values, summary_fields, summary_table

CONTACT = "struct<name:string,phone:string,email:string>"
# Heading text -> section, in matching order.
SECTION_HEADINGS = (
    (("中标（成交）信息",), "bid_info"),
    (("主要标的信息",), "main_content"),
    (("评审专家",), "experts"),
    (("代理服务费",), "agency_fee"),
    (("公告期限",), "announcement_period"),
    (("其它补充事宜", "其他补充事宜"), "supplement"),
    (("凡对本次公告",), "contacts"),
)


def _or_empty_list(arr: Column, element: str) -> Column:
    return F.coalesce(arr, F.array().cast(f"array<{element}>"))


@built_once
def detail_div() -> Column:
    return dom.find(dom.els(), dom.both(dom.tag_is("div"), dom.has_class("vF_detail_content")))


@built_once
def full_text() -> Column:
    """Text of the detail container, one run per line."""
    return text_or_empty(let(detail_div(), lambda d: dom.text_of(d, "\n")))


@built_once
def notice_meta() -> Column:
    """struct<title, publish_date> from meta tags, else from the page."""
    def meta(name: str) -> Column:
        return dom.find(dom.els(), dom.both(
            dom.tag_is("meta"), lambda e: F.coalesce(e["name"] == name, F.lit(False))))["content"]

    heading = let(dom.find(dom.els(), dom.both(dom.tag_is("h2"), dom.has_class("tc"))), dom.plain_text)
    stamp = let(dom.find(dom.els(), dom.both(
        dom.tag_is("span"), lambda e: F.coalesce(e["id"] == "pubTime", F.lit(False)))), dom.plain_text)
    return F.struct(first_filled(meta("ArticleTitle"), heading).alias("title"),
                    first_filled(meta("PubDate"), stamp).alias("publish_date"))


# ------------------------------------------------------------ text sections

def _has(*words: str):
    def test(text: Column) -> Column:
        out = text.contains(words[0])
        for w in words[1:]:
            out = out | text.contains(w)
        return out
    return test


def _line_kind(text: Column) -> Column:
    """'no' and 'name' lines hold a value, a section name opens a section, null is body."""
    kind = (F.when(text.contains("项目编号") & text.contains("TC"), F.lit("no"))
            .when(text.contains("项目名称") & ~text.contains("项目编号"), F.lit("name")))
    for words, section in SECTION_HEADINGS:
        kind = kind.when(_has(*words)(text), F.lit(section))
    return kind


def _carried(lines: Column, opens) -> Column:
    """Cut lines into runs headed by the lines that open one.

    Every line belongs to the latest opening line before it: the runs are the
    slices between neighbouring openings, so each line is visited once.
    """
    heads = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("at"), l.alias("line"))),
                     lambda h: opens(h["line"]))

    def cut(hs: Column) -> Column:
        return F.transform(hs, lambda h, i: F.struct(
            h["line"].alias("head"),
            F.slice(lines, h["at"] + 2,
                    F.coalesce(F.get(hs, i + 1)["at"], F.size(lines)) - h["at"] - 1).alias("body")))

    return let(heads, cut)


@built_once
def notice_sections() -> Column:
    """Sections of the detail text by their headings."""
    paragraphs = let(detail_div(), lambda d: F.transform(
        dom.find_all(dom.inside(d), dom.tag_is("p", "strong")), dom.plain_text))
    lines = F.transform(_or_empty_list(paragraphs, "string"), lambda t: F.struct(
        _line_kind(t).alias("kind"), t.alias("text")))

    def collect(ls: Column) -> Column:
        runs = _carried(ls, lambda l: l["kind"].isNotNull() & ~l["kind"].isin("no", "name"))

        def of_kind(kind: str) -> Column:
            return after_last_colon(last(F.filter(ls, lambda l: l["kind"] == kind))["text"])

        def build(rs: Column) -> Column:
            def body(section: str) -> Column:
                mine = F.filter(rs, lambda r: r["head"]["kind"] == section)
                return F.filter(F.flatten(mine["body"]), lambda l: l["kind"].isNull())["text"]

            def labelled(texts: Column, wanted, *earlier) -> Column:
                """Value of the last line with the label and no label tried before it."""
                def mine(t: Column) -> Column:
                    ok = wanted(t)
                    for e in earlier:
                        ok = ok & ~e(t)
                    return ok
                return text_or_empty(after_last_colon(last(F.filter(texts, mine))))

            supplier, address = _has("供应商名称"), _has("供应商地址")
            amount = _has("中标金额", "成交金额")

            def joined(texts: Column) -> Column:
                return F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit("\n"))), "")

            return F.struct(
                text_or_empty(of_kind("no")).alias("project_no"),
                text_or_empty(of_kind("name")).alias("project_name"),
                let(body("bid_info"), lambda b: F.struct(
                    labelled(b, supplier).alias("supplier"),
                    labelled(b, address, supplier).alias("supplier_address"),
                    labelled(b, amount, supplier, address).alias("amount"))).alias("bid_info"),
                F.lit("").alias("main_content"),
                F.flatten(F.transform(body("experts"), lambda t: split_filled(t, "、"))
                          ).alias("experts"),
                joined(body("agency_fee")).alias("agency_fee"),
                text_or_empty(last(body("announcement_period"))).alias("announcement_period"),
                joined(body("supplement")).alias("supplement"),
                text_or_empty(last(body("contacts"))).alias("contacts_raw"))

        return let(runs, build)

    return let(lines, collect)


# ----------------------------------------------------------------- contacts

def _role(name=None, address=None, contact_name=None, phone=None, email=None, contacts=None) -> Column:
    def field(c):
        return text_or_empty(c) if c is not None else F.lit("")
    return F.struct(
        field(name).alias("name"), field(address).alias("address"),
        field(contact_name).alias("contact_name"), field(phone).alias("phone"),
        field(email).alias("email"),
        (_or_empty_list(contacts, CONTACT) if contacts is not None
         else F.array().cast(f"array<{CONTACT}>")).alias("contacts_list"))


def _project(details=None, phone=None) -> Column:
    return F.struct(
        (_or_empty_list(details, CONTACT) if details is not None
         else F.array().cast(f"array<{CONTACT}>")).alias("details"),
        (text_or_empty(phone) if phone is not None else F.lit("")).alias("phone"))


def _people(parts: Column) -> Column:
    return F.transform(parts, split_contact)


def _row_kind(key: Column) -> Column:
    return (F.when(key.contains("采购单位") & ~key.contains("地址") & ~key.contains("联系方式"),
                   F.lit("buyer_name"))
            .when(key.contains("采购单位地址"), F.lit("buyer_address"))
            .when(key.contains("采购单位联系方式"), F.lit("buyer_contact"))
            .when(key.contains("代理机构名称"), F.lit("agent_name"))
            .when(key.contains("代理机构地址"), F.lit("agent_address"))
            .when(key.contains("代理机构联系方式") | key.contains("代理机构联系人"),
                  F.lit("agent_contact"))
            .when(key.contains("项目联系人"), F.lit("project_names"))
            .when(key.contains("项目联系电话"), F.lit("project_phone")))


@built_once
def table_contacts() -> Column:
    """struct<buyer, agent, project> from the first two cells of each summary row."""
    def row(tr: Column) -> Column:
        return let(dom.find_all(dom.inside(tr), dom.tag_is("td", "th")), lambda cells: F.struct(
            let(first(cells), dom.plain_text).alias("key"),
            text_or_empty(let(F.get(cells, F.lit(1)), dom.plain_text)).alias("value")))

    rows = let(summary_table(), lambda t: F.transform(
        dom.find_all(dom.inside(t), dom.tag_is("tr")), row))
    kinds = F.filter(F.transform(_or_empty_list(rows, "struct<key:string,value:string>"),
                                 lambda r: F.struct(_row_kind(r["key"]).alias("kind"),
                                                    r["value"].alias("value"))),
                     lambda r: r["kind"].isNotNull())

    def since(rs: Column, kind: str) -> Column:
        """Rows from the last one of a kind on: a name row starts its role afresh."""
        n = F.size(rs)
        back = F.array_position(F.reverse(rs["kind"]), kind)
        return F.when(back == 0, rs).otherwise(F.slice(rs, n - back.cast("int") + 1, back.cast("int")))

    def value(rs: Column, kind: str) -> Column:
        return last(F.filter(rs, lambda r: r["kind"] == kind))["value"]

    def values(rs: Column, kind: str) -> Column:
        return F.filter(rs, lambda r: r["kind"] == kind)["value"]

    def buyer(rs: Column) -> Column:
        return let(split_contact(value(rs, "buyer_contact")), lambda c: _role(
            value(rs, "buyer_name"), value(rs, "buyer_address"),
            c["name"], c["phone"], c["email"]))

    def agent(rs: Column) -> Column:
        lists = F.transform(values(rs, "agent_contact"), lambda v: F.filter(
            _people(split_filled(v, "[、，,]")), lambda c: (c["name"] != "") | (c["phone"] != "")))

        def build(ls: Column) -> Column:
            people = last(ls)
            mail = last(F.filter(F.transform(ls, lambda l: first(l)["email"]), lambda e: e != ""))
            return _role(
                value(rs, "agent_name"), value(rs, "agent_address"),
                first(F.filter(people["name"], lambda n: n != "")),
                first(F.filter(people["phone"], lambda p: p != "")), mail, people)

        return let(lists, build)

    def build(rs: Column) -> Column:
        details = F.filter(_people(F.transform(F.split(value(rs, "project_names"), "、"), strip)),
                           lambda c: c["name"] != "")
        return F.struct(
            let(since(rs, "buyer_name"), buyer).alias("buyer"),
            let(since(rs, "agent_name"), agent).alias("agent"),
            _project(details, value(rs, "project_phone")).alias("project"))

    return let(kinds, build)


def _contact_head(text: Column) -> Column:
    return (F.when(text.contains("凡对本次公告"), F.lit(None).cast("string"))
            .when(_has("采购人信息", "1.采购人")(text), F.lit("buyer"))
            .when(text.contains("代理机构"), F.lit("agent"))
            .when(_has("项目联系方式", "3.项目")(text), F.lit("project")))


def _side_line(text: Column) -> Column:
    return (F.when(_has("名 称", "名称")(text), F.lit("name"))
            .when(text.contains("地址"), F.lit("address"))
            .when(_has("电 话", "电话")(text), F.lit("phone"))
            .when(text.contains("联系方式"), F.lit("contact"))
            .when(text.contains("联系人"), F.lit("person")))


@built_once
def text_contacts() -> Column:
    """struct<buyer, agent, project> from the paragraphs of the detail text."""
    paragraphs = let(detail_div(), lambda d: F.transform(
        dom.find_all(dom.inside(d), dom.tag_is("p")), dom.plain_text))
    lines = F.transform(
        F.filter(_or_empty_list(paragraphs, "string"), lambda t: ~t.contains("凡对本次公告")),
        lambda t: F.struct(_contact_head(t).alias("head"), _side_line(t).alias("kind"),
                           t.alias("text")))

    def of_role(runs: Column, role: str) -> Column:
        mine = F.filter(runs, lambda r: r["head"]["head"] == role)
        # A heading line is read as a line of its own section, too.
        return F.flatten(F.transform(mine, lambda r: F.concat(F.array(r["head"]), r["body"])))

    def value(ls: Column, kind: str) -> Column:
        return after_last_colon(last(F.filter(ls, lambda l: l["kind"] == kind))["text"])

    def buyer(ls: Column) -> Column:
        def sets(line: Column) -> Column:
            """What one line assigns; null means the line leaves a field as it is."""
            value_text = after_last_colon(line["text"])

            def contact(v: Column) -> Column:
                phone = first_phone(v)

                def with_phone(p: Column) -> Column:
                    rest = strip(F.translate(F.replace(v, p, F.lit("")), "、，,：:", ""))
                    return F.struct(none_if_empty(rest).alias("name"), p.alias("phone"),
                                    F.lit(None).cast("string").alias("email"))

                return let(phone, lambda p: F.when(p != "", with_phone(p)).otherwise(
                    split_contact(v)))

            nothing = F.lit(None).cast("string")
            return (F.when(line["kind"] == "phone", F.struct(
                        nothing.alias("name"), none_if_empty(first_phone(line["text"])).alias("phone"),
                        nothing.alias("email")))
                    .when(line["kind"] == "contact", let(value_text, contact)))

        def build(ss: Column) -> Column:
            def latest(field: str) -> Column:
                return last(F.filter(ss[field], lambda x: x.isNotNull()))
            return _role(value(ls, "name"), value(ls, "address"),
                         latest("name"), latest("phone"), latest("email"))

        return let(F.filter(F.transform(ls, sets), lambda s: s.isNotNull()), build)

    def agent(ls: Column) -> Column:
        def read(line: Column) -> Column:
            v = F.when(line["kind"] == "phone", line["text"]).otherwise(
                after_last_colon(line["text"]))
            return let(v, lambda x: F.struct(
                (line["kind"] != "phone").alias("is_list"),
                F.array_join(expand_phones(x), ", ").alias("phone"),
                F.when(line["kind"] != "phone", names_of_line(x)).alias("names")))

        reads = F.transform(
            F.filter(ls, lambda l: l["kind"].isin("phone", "contact", "person")), read)

        def build(rs: Column) -> Column:
            n = F.size(rs)
            back = F.array_position(F.reverse(rs["is_list"]), True).cast("int")
            # From the last contact line on: that line makes the list, later
            # phone lines fill in the numbers it lacks.
            tail = F.when(back > 0, F.slice(rs, n - back + 1, back))
            named = F.filter(rs, lambda r: F.size(r["names"]) > 0)
            phone = last(F.filter(rs, lambda r: (r["phone"] != "") | (
                r["is_list"] & (F.size(r["names"]) > 0))))["phone"]

            def people(t: Column) -> Column:
                number = text_or_empty(first(F.filter(t["phone"], lambda p: p != "")))
                return let(number, lambda p: F.transform(first(t)["names"], lambda nm: F.struct(
                    nm.alias("name"), p.alias("phone"), F.lit("").alias("email"))))

            return _role(value(ls, "name"), value(ls, "address"),
                         first(last(named)["names"]), phone, None, let(tail, people))

        return let(reads, build)

    def project(ls: Column) -> Column:
        names = last(F.filter(ls["text"], lambda t: t.contains("项目联系人")))
        details = F.filter(_people(F.transform(F.split(after_last_colon(names), "、"), strip)),
                           lambda c: c["name"] != "")
        phone = last(F.filter(ls["text"], lambda t: (
            ~t.contains("项目联系人") & _has("电 话", "电话")(t))))
        return _project(details, after_last_colon(phone))

    def build(runs: Column) -> Column:
        return F.struct(let(of_role(runs, "buyer"), buyer).alias("buyer"),
                        let(of_role(runs, "agent"), agent).alias("agent"),
                        let(of_role(runs, "project"), project).alias("project"))

    return let(lines, lambda ls: let(_carried(ls, lambda l: l["head"].isNotNull()), build))


def merged_contacts(has_text: Column, from_text: Column, from_table: Column,
                    fill_gaps: bool = False) -> Column:
    """Text contacts replace the table's wherever the page has a detail text.

    ``fill_gaps`` keeps the table's value where the text gives none.
    """
    if not fill_gaps:
        return F.when(has_text, from_text).otherwise(from_table)

    def side(role: str) -> Column:
        a, b = from_text[role], from_table[role]
        return _role(*[first_filled(a[f], b[f])
                       for f in ("name", "address", "contact_name", "phone", "email")],
                     F.when(F.size(a["contacts_list"]) > 0, a["contacts_list"])
                     .otherwise(b["contacts_list"]))

    a, b = from_text["project"], from_table["project"]
    filled_in = F.struct(
        side("buyer").alias("buyer"), side("agent").alias("agent"),
        _project(F.when(F.size(a["details"]) > 0, a["details"]).otherwise(b["details"]),
                 first_filled(a["phone"], b["phone"])).alias("project"))
    return F.when(has_text, filled_in).otherwise(from_table)


def without_experts(contacts: Column, experts: Column) -> Column:
    """Clear contacts that are members of the review panel."""
    def side(role: str) -> Column:
        r = contacts[role]
        kept = F.filter(r["contacts_list"], lambda c: ~F.array_contains(experts, c["name"]))
        return F.struct(
            r["name"], r["address"],
            F.when(F.array_contains(experts, r["contact_name"]), F.lit(""))
            .otherwise(r["contact_name"]).alias("contact_name"),
            r["phone"], r["email"], kept.alias("contacts_list"))

    return F.struct(side("buyer").alias("buyer"), side("agent").alias("agent"),
                    contacts["project"].alias("project"))


@built_once
def _summary() -> Column:
    return summary_fields(F.col("_pairs"))


def parsed_notices(blocks: DataFrame, fill_gaps: bool = False) -> DataFrame:
    """Page columns plus meta, summary, sections, contacts and content."""
    kept = dom.other_columns(blocks)
    read = blocks.select(
        *kept,
        notice_meta().alias("meta"),
        key_values().alias("_pairs"),
        notice_sections().alias("sections"),
        detail_div().isNotNull().alias("_has_text"),
        text_contacts().alias("_from_text"),
        table_contacts().alias("_from_table"),
        full_text().alias("content"))
    merged = read.withColumn("_contacts", merged_contacts(
        F.col("_has_text"), F.col("_from_text"), F.col("_from_table"), fill_gaps))
    return merged.select(
        *kept, "meta", _summary().alias("summary"), "sections",
        without_experts(F.col("_contacts"), F.col("sections.experts")).alias("contacts"), "content")
