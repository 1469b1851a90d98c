"""Contact rows: names x phones x e-mails of an announcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.contact import extract_contacts

TOP_COMPANIES = 20


def contactable() -> Column:
    """A phone or an e-mail is needed."""
    return (F.col("phone") != "") | (F.col("email") != "")


def contact_rows(df: DataFrame, announcement_id: str = "announcement_id") -> DataFrame:
    """One row per name, phone and e-mail combination.

    Expects company, contacts, phones and emails columns; an empty list counts
    as one empty value.
    """
    def at_least_one(arr: Column) -> Column:
        return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, arr).otherwise(F.array(F.lit("")))

    rows = df.withColumn("contact_name", F.explode(at_least_one(F.col("contacts"))))
    rows = rows.withColumn("phone", F.explode(at_least_one(F.col("phones"))))
    rows = rows.withColumn("email", F.explode(at_least_one(F.col("emails"))))
    return (rows.filter(contactable())
            .select(F.col(announcement_id).alias("announcement_id"),
                    F.coalesce("company", F.lit("")).alias("company"), "contact_name", "phone",
                    "email"))


def contacts_in_text(df: DataFrame, text: str, announcement_id: str) -> DataFrame:
    """Contact rows read from running text."""
    found = df.select(announcement_id, extract_contacts(F.col(text)).alias("_c"))
    return contact_rows(found.select(announcement_id, "_c.*"), announcement_id)


def top_contact_companies(contacts: DataFrame, k: int = TOP_COMPANIES) -> DataFrame:
    """Companies by contact rows, empty ones left out (A3)."""
    return (contacts.filter(F.col("company").isNotNull() & (F.col("company") != ""))
            .groupBy("company").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("company")).limit(k))
