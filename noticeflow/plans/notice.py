"""Flat notices and card candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chars import built_once, first, first_filled, let, split_filled, strip, text_or_empty
from ..functions.contact import (clean_company, clean_contact_names, clean_emails, clean_phones,
                                 contact_role, format_phones, project_owner, simple_phones,
                                 split_phone_list)
from ..functions.text import parse_amount
from ..operators.notice_pages import CONTACT, parsed_notices

# Fixed value.
NOTICE_SOURCE = "中国公共资源交易网"
CANDIDATE = ("struct<company:string,contact_name:string,phones:array<string>,"
             "emails:array<string>,role:string>")
PARSED = ("meta", "summary", "sections", "contacts", "content")


def format_notice(parsed: DataFrame) -> DataFrame:
    """Nested notice -> flat notice, one column per stored field."""
    kept = [c for c in parsed.columns if c not in PARSED]
    s, c, x = F.col("summary"), F.col("contacts"), F.col("sections")

    def phones(role: str) -> Column:
        direct = c[role]["phone"]
        return F.when(direct != "", format_phones(direct)).otherwise(
            F.array_join(simple_phones(s[role]["contact"]), ", "))

    amount_text = first_filled(x["bid_info"]["amount"], s["amount"]["total"], s["amount"]["bid"])
    details = c["project"]["details"]
    named = F.transform(split_filled(s["contacts"]["name"], "、"), lambda n: F.struct(
        n.alias("name"), F.lit("").alias("phone"), F.lit("").alias("email")))
    return parsed.select(
        *kept,
        F.col("meta.title").alias("title"),
        F.col("meta.publish_date").alias("publish_date"),
        F.lit(NOTICE_SOURCE).alias("source"),
        x["project_no"].alias("project_no"),
        first_filled(s["project_info"]["name"], x["project_name"]).alias("project_name"),
        s["project_info"]["category"].alias("category"),
        s["project_info"]["region"].alias("region"),
        first_filled(x["bid_info"]["supplier"], s["supplier"]["name"]).alias("supplier"),
        first_filled(x["bid_info"]["supplier_address"], s["supplier"]["address"])
        .alias("supplier_address"),
        amount_text.alias("bid_amount"),
        parse_amount(amount_text)["yuan"].alias("bid_yuan"),
        first_filled(s["buyer"]["name"], c["buyer"]["name"]).alias("buyer_name"),
        first_filled(s["buyer"]["address"], c["buyer"]["address"]).alias("buyer_address"),
        first_filled(s["buyer"]["contact"], c["buyer"]["contact_name"]).alias("buyer_contact"),
        phones("buyer").alias("buyer_phone"),
        c["buyer"]["email"].alias("buyer_email"),
        first_filled(s["agent"]["name"], c["agent"]["name"]).alias("agent_name"),
        first_filled(s["agent"]["address"], c["agent"]["address"]).alias("agent_address"),
        first_filled(s["agent"]["contact"], c["agent"]["contact_name"]).alias("agent_contact"),
        phones("agent").alias("agent_phone"),
        c["agent"]["email"].alias("agent_email"),
        c["agent"]["contacts_list"].alias("agent_contacts_list"),
        F.when(F.size(details) > 0, details).otherwise(named).alias("project_contacts"),
        first_filled(s["contacts"]["phone"], c["project"]["phone"]).alias("project_phone"),
        first_filled(s["experts"], F.array_join(x["experts"], ", ")).alias("experts"),
        F.col("content"),
    )


def notices(blocks: DataFrame, fill_gaps: bool = False) -> DataFrame:
    return format_notice(parsed_notices(blocks, fill_gaps))


def _candidate(company: Column, name: Column, phones: Column, emails: Column, role: Column) -> Column:
    return F.struct(company.alias("company"), name.alias("contact_name"), phones.alias("phones"),
                    emails.alias("emails"), role.alias("role")).cast(CANDIDATE)


def _as_emails(email: Column) -> Column:
    return F.filter(F.array(email), lambda e: e != "")


@built_once
def notice_candidates() -> Column:
    """All card candidates of a flat notice, in order: array of CANDIDATE.

    Project contacts go to the side whose phone matches theirs; without a
    match to the agent, and without an agent to the buyer.
    """
    def cell(name: str) -> Column:
        return strip(text_or_empty(F.col(name)))

    none = F.array().cast(f"array<{CANDIDATE}>")
    facts = F.struct(
        cell("buyer_name").alias("buyer"), cell("agent_name").alias("agent"),
        cell("buyer_contact").alias("buyer_contact"), cell("agent_contact").alias("agent_contact"),
        split_phone_list(cell("buyer_phone")).alias("buyer_phones"),
        split_phone_list(cell("agent_phone")).alias("agent_phones"),
        split_phone_list(cell("project_phone")).alias("project_phones"))

    def build(f: Column) -> Column:
        buyer = F.when(
            (f["buyer"] != "") & (f["buyer_contact"] != ""), F.array(_candidate(
                f["buyer"], f["buyer_contact"], f["buyer_phones"], _as_emails(cell("buyer_email")),
                F.lit("buyer")))).otherwise(none)
        supplier = F.when(cell("supplier") != "", F.array(_candidate(
            cell("supplier"), F.lit(""), F.array(), F.array(), F.lit("supplier")))).otherwise(none)

        people = F.transform(F.col("agent_contacts_list"), lambda p: F.struct(
            strip(p["name"]).alias("name"), p["phone"].alias("phone"),
            strip(p["email"]).alias("email")))
        # Each name once, at its first place.
        listed = let(people, lambda ps: F.transform(
            F.filter(F.array_distinct(ps["name"]), lambda n: n != ""),
            lambda n: let(first(F.filter(ps, lambda p: p["name"] == n)), lambda p: _candidate(
                f["agent"], n, split_phone_list(p["phone"]), _as_emails(p["email"]),
                F.lit("agent")))))

        def with_single(ls: Column) -> Column:
            single = F.when(
                (f["agent_contact"] != "") & ~F.array_contains(ls["contact_name"], f["agent_contact"]),
                F.array(_candidate(f["agent"], f["agent_contact"], f["agent_phones"],
                                   _as_emails(cell("agent_email")), F.lit("agent")))).otherwise(none)
            return F.concat(ls, single)

        agent = F.when(f["agent"] != "", let(listed, with_single)).otherwise(none)

        def owner(phones: Column) -> Column:
            return project_owner(phones, f["agent"], f["agent_phones"], f["buyer"],
                                 f["buyer_phones"])

        def project(common: Column) -> Column:
            def one(p: Column) -> Column:
                phones = F.array_distinct(F.concat(split_phone_list(p["phone"]),
                                                   f["project_phones"]))
                return let(phones, lambda ph: let(
                    F.coalesce(common, owner(ph), first_filled(f["agent"], f["buyer"])),
                    lambda company: _candidate(
                        company, strip(p["name"]), ph, F.array(),
                        contact_role(company, f["agent"], f["buyer"]))))
            named = F.filter(F.col("project_contacts"), lambda p: strip(p["name"]) != "")
            return F.filter(F.transform(named, one), lambda c: c["company"] != "")

        return F.concat(buyer, supplier, agent, let(owner(f["project_phones"]), project))

    return let(facts, build)


def card_candidates(flat: DataFrame, keys: list[str]) -> DataFrame:
    """One cleaned row per candidate: keys, cand_pos, company, contact_name, phones,
    emails, role (X14, X15)."""
    cand = F.col("_cand")
    return (flat.select(*keys, F.posexplode(notice_candidates()).alias("cand_pos", "_cand"))
            .select(*keys, "cand_pos",
                    strip(clean_company(cand["company"])).alias("company"),
                    text_or_empty(first(clean_contact_names(F.array(cand["contact_name"]))))
                    .alias("contact_name"),
                    F.array_sort(clean_phones(cand["phones"])).alias("phones"),
                    F.array_sort(clean_emails(cand["emails"])).alias("emails"),
                    strip(cand["role"]).alias("role")))
