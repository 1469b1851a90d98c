"""Statistics kept up to date by batches.

Announcements and mentions are appended once and a mention arrives with its announcement, so
a count of distinct announcements, too, is the sum of the counts of the batches. Each
batch stores its own counts, (kind, key, count); an answer sums these states and
reads no table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import day_of, province_of
from ..operators.cards import card_id
from ..operators.cards import real_company
from ..sources.state import View

KINDS = ("total", "source", "province", "day", "role", "company", "card")


def batch_statistics(announcements: DataFrame, kept: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key, count, kind) of one batch: its announcements, kept card candidates and mentions.

    Companies and cards are counted by distinct announcements, first per (name,
    announcement), so a company in a third of all notices is spread over tasks.
    """
    def counted(rows: DataFrame, kind: str, key: Column) -> DataFrame:
        return rows.groupBy(key.cast("string").alias("key")).agg(
            F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit(kind))

    once = lambda key: kept.select(key.alias("k"), "announcement_id").distinct()
    return reduce(DataFrame.unionByName, [
        counted(announcements, "total", F.lit("announcements")),
        counted(mentions, "total", F.lit("mentions")),
        counted(announcements, "source", F.col("source")),
        counted(announcements, "province", province_of(F.col("title"), F.col("content"))),
        counted(announcements, "day", day_of(F.col("publish_date"))),
        counted(mentions, "role", F.col("role")),
        counted(once(F.col("company")), "company", F.col("k")),
        counted(once(card_id(F.col("company"), F.col("contact_name"))), "card", F.col("k"))])


def totals(view: View) -> DataFrame:
    """Announcements and mentions stored (A1)."""
    return view.statistics("total").select(F.col("key").alias("table"), "count")


def count_by(view: View, kind: str) -> DataFrame:
    """Announcements by source, province or day, mentions by role."""
    return view.statistics(kind).select(F.col("key").alias(kind), "count")


def top_companies(view: View, k: int = 5) -> DataFrame:
    """Companies by number of announcements that mention them."""
    return (view.statistics("company").withColumnRenamed("key", "company").filter(real_company())
            .orderBy(F.desc("count"), F.asc("company")).limit(k))


def with_project_counts(cards: DataFrame, view: View) -> DataFrame:
    """Cards with their number of announcements, 0 for none."""
    counts = view.statistics("card").select(F.col("key").cast("long").alias("id"), F.col("count").alias("projects_count"))
    return cards.join(counts, "id", "left").withColumn("projects_count", F.coalesce("projects_count", F.lit(0)))
