"""Queries and merges over business cards and their mentions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chars import like_text, strip, text_or_empty
from .cursor import beyond, ordering
from .dedupe import unseen
from .sizing import bounded, settled

# Company cells that only point elsewhere.
PLACEHOLDER_COMPANIES = ("%详见%正文%", "%见公告%", "%见附件%")
MIN_COMPANY = 3
CARD_LIMIT = 200


def card_id(company: Column, contact_name: Column) -> Column:
    return F.xxhash64(company, contact_name)


def real_company(company: str = "company") -> Column:
    """Not a placeholder and longer than two characters."""
    c = F.col(company)
    return reduce(lambda a, p: a & ~c.like(p), PLACEHOLDER_COMPANIES, F.length(c) >= MIN_COMPANY)


def card_matches(q: str) -> Column:
    """Search text in company or contact name."""
    if not q:
        return F.lit(True)
    return like_text(F.col("company"), q) | like_text(F.col("contact_name"), q)


# ---------------------------------------------------------------- statistics

def top_companies(c: DataFrame, m: DataFrame, k: int = 5) -> DataFrame:
    """Companies by number of distinct announcements that mention them.

    Mentions are unique per (card, announcement, role), so reducing them before
    the join would shuffle them all to save few. A company is stood for by the
    smallest of its card ids until it is counted: two numbers per mention are
    shuffled, no names. The distinct count runs in two steps, the first keyed
    by (company, announcement), so a company with a third of all mentions is
    spread out.
    """
    cards = c.filter(real_company()).select(F.col("id").alias("business_card_id"), "company")
    names = cards.groupBy("company").agg(F.min("business_card_id").alias("company_key"))
    keyed = cards.join(names, "company").select("business_card_id", "company_key")
    counts = (m.select("business_card_id", "announcement_id").join(keyed, "business_card_id")
              .groupBy("company_key").agg(F.countDistinct("announcement_id").alias("count")))
    return (counts.join(names, "company_key").select("company", "count")
            .orderBy(F.desc("count"), F.asc("company")).limit(k))


def role_distribution(m: DataFrame) -> DataFrame:
    """Mentions per role (A5)."""
    return m.groupBy("role").agg(F.count(F.lit(1)).alias("count"))


def with_project_counts(c: DataFrame, m: DataFrame, some: bool = False) -> DataFrame:
    """Cards with their number of distinct announcements, 0 for none.

    Mentions are reduced to one row per card before they meet the cards. If
    ``c`` holds only ``some`` cards, mentions of others drop out before that.
    """
    if some:
        m = m.join(c.select(F.col("id").alias("business_card_id")), "business_card_id", "left_semi")
    counts = (m.groupBy("business_card_id")
              .agg(F.countDistinct("announcement_id").alias("projects_count"))
              .withColumnRenamed("business_card_id", "id"))
    return c.join(counts, "id", "left").withColumn(
        "projects_count", F.coalesce("projects_count", F.lit(0)))


def cards_of_company(c: DataFrame, m: DataFrame, company: str, like: bool = False,
                     limit: int | None = CARD_LIMIT) -> DataFrame:
    """Cards of a company, most active first; blank company gives none.

    A limit of None gives them all.
    """
    company = (company or "").strip()
    if not company:
        where = F.lit(False)
    elif like:
        where = like_text(F.col("company"), company)
    else:
        where = F.col("company") == company
    found = (with_project_counts(c.filter(where), m, some=True)
             .orderBy(F.desc("projects_count"), F.desc_nulls_last("updated_at"), F.asc("id")))
    return found if limit is None else found.limit(limit)


def exported_cards(c: DataFrame, m: DataFrame, q: str = "") -> DataFrame:
    """Every card with joined phones and e-mails, by company and name."""
    return (with_project_counts(c.filter(card_matches(q)), m, some=bool(q))
            .select("company", "contact_name", F.array_join("phones", ", ").alias("phones"),
                    F.array_join("emails", ", ").alias("emails"), "projects_count",
                    "created_at", "updated_at")
            .orderBy("company", "contact_name"))


# ---------------------------------------------------------------- card list

KEY = ["company", "contact_name"]
CARD_PAGE_ORDER = ("-updated_at", *KEY)


def _page_order() -> list[Column]:
    return ordering(CARD_PAGE_ORDER)


def _listed_mentions(m: DataFrame, a: DataFrame | None, role: str, province: str) -> DataFrame:
    """Mentions that pass the role and province filters (J3, P15). Announcements
    are read only when a province is asked for."""
    if role:
        m = m.filter(F.col("role") == role)
    if province:
        found = a.filter(like_text(F.col("title"), province)
                         | like_text(F.col("content"), province))
        m = m.join(found.select(F.col("id").alias("announcement_id")), "announcement_id",
                   "left_semi")
    return m


def _listed_cards(c: DataFrame, m: DataFrame | None, q: str) -> DataFrame:
    """Cards that pass the search (P14) and, if mentions are given, have one of them."""
    cards = c.filter(card_matches(q))
    if m is None:
        return cards
    return cards.join(m.select(F.col("business_card_id").alias("id")).distinct(), "id", "left_semi")


def card_list(c: DataFrame, m: DataFrame, a: DataFrame | None = None, q: str = "",
              role: str = "", province: str = "", limit: int = 50, offset: int = 0,
              cursor: Sequence | None = None) -> DataFrame:
    """One row per (company, contact), recently updated first.

    The order depends on cards alone, so the page is cut first, on narrow
    card rows. Mentions are then counted, and phones and e-mails fetched, for
    the cards of the page only. With a role or province the mentions that pass are
    found once and written as pairs of numbers, so the texts of announcements are
    read once. With a ``cursor`` over ``CARD_PAGE_ORDER`` the page is the one behind that row.
    """
    narrow = m.select("business_card_id", "announcement_id")
    if role or province:
        narrow = settled(_listed_mentions(m, a, role, province).select(*narrow.columns).distinct())
    listed = _listed_cards(c, narrow if role or province else None, q)
    groups = (listed.groupBy(*KEY)
              .agg(F.max("id").alias("id"), F.max("created_at").alias("created_at"),
                   F.max("updated_at").alias("updated_at")))
    if cursor is not None:
        groups = groups.filter(beyond(CARD_PAGE_ORDER, cursor))
    page = bounded(limit, settled(
        groups.orderBy(*_page_order()).offset(offset).limit(limit)))
    on_page = c.select("id", *KEY, "phones", "emails").join(page.select(*KEY), KEY)
    ids = on_page.select(F.col("id").alias("business_card_id"), *KEY)
    counts = (narrow.join(ids, "business_card_id")
              .groupBy(*KEY).agg(F.countDistinct("announcement_id").alias("projects_count")))
    values = on_page.groupBy(*KEY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("phones")))).alias("phones"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("emails")))).alias("emails"))
    return (values.join(counts, KEY, "left").join(page, KEY)
            .select("id", *KEY, F.array_join("phones", ", ").alias("phones"),
                    F.array_join("emails", ", ").alias("emails"), "created_at", "updated_at",
                    F.coalesce("projects_count", F.lit(0)).alias("projects_count"))
            .orderBy(*_page_order()))


def card_group_count(c: DataFrame, m: DataFrame, a: DataFrame | None = None, q: str = "",
                     role: str = "", province: str = "") -> DataFrame:
    """Number of (company, contact) groups under the list's filters."""
    passing = _listed_mentions(m, a, role, province) if role or province else None
    return (_listed_cards(c, passing, q).select(*KEY).distinct()
            .agg(F.count(F.lit(1)).alias("total")))


# ---------------------------------------------------------------- history

def mentions_of_card(m: DataFrame, a: DataFrame, card: int) -> DataFrame:
    """Announcements that mention one card id, newest first."""
    wanted = m.filter(F.col("business_card_id") == card)
    return _history(wanted, a)


def same_identity(c: DataFrame, card: int) -> DataFrame:
    """All cards with the (company, contact) of the given card."""
    one = c.filter(F.col("id") == card).select(*KEY).limit(1)
    return c.join(F.broadcast(one), KEY, "left_semi")


def card_history(c: DataFrame, m: DataFrame, a: DataFrame, card: int) -> DataFrame:
    """The same over every card of that identity."""
    cards = same_identity(c, card).select(F.col("id").alias("business_card_id"))
    return _history(m.join(cards, "business_card_id"), a)


def _history(wanted: DataFrame, a: DataFrame) -> DataFrame:
    """One identity's mentions against all announcements; the sizes seen at run
    time decide how they meet."""
    found = a.select(F.col("id").alias("announcement_id"), "title", "url", "source", "publish_date")
    narrow = wanted.select("announcement_id", "role")
    return (found.join(narrow, "announcement_id")
            .select(F.col("announcement_id").alias("id"), "title", "url", "source",
                    "publish_date", "role")
            .orderBy(F.desc_nulls_last("publish_date"), F.asc("id"), F.asc("role")))


# ---------------------------------------------------------------- merges

def combine_cards(rows: DataFrame) -> DataFrame:
    """Rows with the card columns -> one card per (company, contact_name) (A10).

    Phones and e-mails are united, the first created_at and the last
    updated_at kept; rows without company or contact drop out. The result
    does not depend on order, repetition or grouping of the rows. Values are
    reduced to distinct (card, kind, value) rows first, keyed by all three, so
    a card named in a third of all notices is never gathered in one task as
    raw rows.
    """
    def tagged(kind: str, arr: Column) -> Column:
        return F.transform(F.coalesce(arr, F.array()), lambda v: F.struct(
            F.lit(kind).alias("kind"), v.alias("value")))

    items = rows.select(
        strip(text_or_empty(F.col("company"))).alias("company"),
        strip(text_or_empty(F.col("contact_name"))).alias("contact_name"),
        F.explode_outer(F.concat(tagged("p", F.col("phones")), tagged("e", F.col("emails"))))
        .alias("_i"), "created_at", "updated_at")
    value = strip(F.col("_i.value"))
    distinct = items.select(
        "company", "contact_name", F.col("_i.kind").alias("kind"),
        F.when(F.col("_i.kind") == "e", F.lower(value)).otherwise(value).alias("value"),
        "created_at", "updated_at"
    ).filter((F.col("company") != "") & (F.col("contact_name") != "")
             ).groupBy("company", "contact_name", "kind", "value").agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))

    def values(kind: str) -> Column:
        return F.array_sort(F.collect_list(
            F.when((F.col("kind") == kind) & (F.col("value") != ""), F.col("value"))))

    merged = distinct.groupBy("company", "contact_name").agg(
        values("p").alias("phones"), values("e").alias("emails"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return merged.select(card_id(F.col("company"), F.col("contact_name")).alias("id"),
                         "company", "contact_name", "phones", "emails", "created_at", "updated_at")


def seen_cards(candidates: DataFrame, seen_at: Column) -> DataFrame:
    """Candidates as card rows first and last seen at one time."""
    return candidates.select("company", "contact_name", "phones", "emails",
                             seen_at.alias("created_at"), seen_at.alias("updated_at"))


def merge_cards(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cards after merging candidates into a snapshot.

    ``old`` has the card columns, ``new`` company, contact_name, phones, emails
    and ``seen_at``.
    """
    return combine_cards(old.drop("id").unionByName(seen_cards(new, F.col("seen_at"))))


def distinct_mentions(new: DataFrame) -> DataFrame:
    """Complete, distinct mentions."""
    return (new.filter(F.col("business_card_id").isNotNull() & F.col("announcement_id").isNotNull())
            .select("business_card_id", "announcement_id",
                    strip(text_or_empty(F.col("role"))).alias("role")).distinct())


def new_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions to append: complete, distinct and not stored."""
    key = ["business_card_id", "announcement_id", "role"]
    return unseen(distinct_mentions(new), old, key)
