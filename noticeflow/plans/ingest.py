"""Stored pages -> announcements, cards and mentions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.chars import contains_any, first_filled, strip
from ..functions.text import clean_announcement, clean_url, publish_day
from ..operators.cards import card_id, distinct_mentions, seen_cards
from ..operators.dedupe import unseen
from ..operators.generic_pages import page_text
from ..operators.html_blocks import html_blocks
from ..operators.refused import REFUSAL_WORDS, refused
from ..schema import ANNOUNCEMENTS, MENTIONS
from ..session import shared_dir
from ..sources.state import REWRITE_AFTER, State, View
from .notice import card_candidates, notices
from .statistics import batch_statistics

# Fixed value.
INGEST_SOURCE = "ccgp-bxsearch"
_OPTIONAL = {"list_title": "string", "list_date": "string", "scraped_at": "timestamp"}
# Markup for one task of the parser, and the least that is dealt out to more tasks.
TASK_BYTES = 32 << 20
LEAST_TASK_BYTES = 1 << 20


@dataclass(frozen=True)
class Ingested:
    """Counters of one batch."""

    pages: int
    new_notices: int
    skipped: int
    refused: int
    card_writes: int


def prepared(pages: DataFrame) -> DataFrame:
    """Clean urls and the optional list columns; a page without url has ''."""
    for name, kind in _OPTIONAL.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return (pages.select(clean_url(F.col("url")).alias("url"), "html", *_OPTIONAL,
                         F.col("ingest_seq").cast("long").alias("ingest_seq"))
            .withColumn("url", F.coalesce("url", F.lit(""))))


def may_be_refused(html: Column) -> Column:
    """Markup that could hold the wording of a refusal; without it a page is none."""
    return contains_any(html, (*REFUSAL_WORDS, "&#"))


def parser_tasks(markup: int, cores: int) -> int:
    """Tasks that parse so many bytes: one for each TASK_BYTES, and no idle cores but for a small batch."""
    return max(1, -(-markup // TASK_BYTES), min(cores, markup // LEAST_TASK_BYTES))


def new_pages(pages: DataFrame, stored: DataFrame | View, seen: Observation | None = None) -> DataFrame:
    """Pages to parse for every unknown url, with the flag ``contested``.

    One pass over the pages notes url, ingest_seq and what the markup may be; everything is
    decided on these short rows, and a second pass picks the markup that is wanted by (url,
    ingest_seq), so a url with many copies stays spread. A url with one page needs no
    more. Of several copies the first that is not refused is wanted: those are the first copy
    without any wording of a refusal and the earlier ones with it, which only parsing can
    judge. Pages without markup are no copies. ``seen`` counts the pages as they are noted.

    What is wanted is dealt out by its bytes of markup: parsing costs far more than the shuffled
    bytes tell, by which Spark would join it into one task.
    """
    rows = prepared(pages)
    shared_dir(rows.sparkSession)
    noted = rows.select("url", "ingest_seq", F.coalesce(F.col("html") != "", F.lit(False)).alias("_markup"),
                        F.coalesce(may_be_refused(F.col("html")), F.lit(False)).alias("_doubt"),
                        F.octet_length("html").cast("long").alias("_bytes"))
    if seen is not None:
        noted = noted.observe(seen, F.count(F.lit(1)).alias("pages"))
    noted = noted.checkpoint().filter(F.col("url") != "")
    copies = noted.groupBy("url").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min(F.when(F.col("_markup") & ~F.col("_doubt"), F.col("ingest_seq"))).alias("_sure")).checkpoint()
    known = stored.known_urls(copies) if isinstance(stored, View) else stored
    fresh = unseen(copies, known, ["url"])
    wanted = (noted.filter("_markup").join(fresh, "url")
              .filter((F.col("_copies") == 1) | F.col("_sure").isNull() | (F.col("ingest_seq") == F.col("_sure"))
                      | (F.col("_doubt") & (F.col("ingest_seq") < F.col("_sure"))))
              .select("url", "ingest_seq", (F.col("_copies") > 1).alias("contested"), "_bytes"))
    tasks = parser_tasks(wanted.agg(F.sum("_bytes")).first()[0] or 0, rows.sparkSession.sparkContext.defaultParallelism)
    return (rows.join(wanted.drop("_bytes"), ["url", "ingest_seq"]).select(*rows.columns, "contested")
            .repartition(tasks, "url", "ingest_seq"))


def first_good(read: DataFrame) -> DataFrame:
    """Pages that are not refused, the first copy of each url."""
    good = read.filter(~F.col("refused"))
    firsts = (good.filter("contested").groupBy("url").agg(F.min("ingest_seq").alias("ingest_seq")))
    return good.filter(~F.col("contested")).unionByName(
        good.filter("contested").join(firsts, ["url", "ingest_seq"], "left_semi").select(*good.columns))


def refused_page() -> Column:
    return refused(page_text("\n", all_text=True))


def announcement_id(url: Column) -> Column:
    return F.xxhash64(url)


def parsed_pages(fresh: DataFrame, fill_gaps: bool = False) -> DataFrame:
    """Flat notices of pages that are no refusal notice, with the parsed candidates' keys."""
    blocks = html_blocks(fresh).filter(~refused_page())
    return notices(blocks, fill_gaps)


def announcements_of(flat: DataFrame, now: datetime, title_limit: int | None = None,
                     content_limit: int | None = None) -> DataFrame:
    """Cleaned announcement rows; list title and date win over the page's.

    Whole texts are stored unless limits are given.
    """
    rows = flat.select(
        strip(first_filled(F.col("list_title"), F.col("title"))).alias("title"), "url", "content",
        strip(first_filled(F.col("list_date"), F.col("publish_date"))).alias("publish_date"),
        F.lit(INGEST_SOURCE).alias("source"),
        F.coalesce("scraped_at", F.lit(now)).alias("scraped_at"), "ingest_seq")
    return (clean_announcement(rows, title_limit, content_limit)
            .withColumn("id", announcement_id(F.col("url")))
            .withColumn("publish_day", publish_day(F.col("publish_date")))
            .withColumn("created_at", F.lit(now))
            .select(*[f.name for f in ANNOUNCEMENTS.fields]))


def candidates_of(flat: DataFrame) -> DataFrame:
    """Cleaned candidates keyed by announcement."""
    return card_candidates(
        flat.withColumn("announcement_id", announcement_id(F.col("url"))), ["announcement_id"])


def has_card_key() -> Column:
    return (F.col("company") != "") & (F.col("contact_name") != "")


def kept_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with both parts of the card key; suppliers have no contact name."""
    return candidates.filter(has_card_key())


def winners_of(candidates: DataFrame) -> DataFrame:
    """Supplier companies per announcement, which the card table leaves out."""
    return (candidates.filter((F.col("role") == "supplier") & (F.col("company") != ""))
            .select("announcement_id", "company").distinct())


def mentions_of(kept: DataFrame) -> DataFrame:
    return kept.select(card_id(F.col("company"), F.col("contact_name")).alias("business_card_id"),
                       "announcement_id", "role")


def ingest(pages: DataFrame, state: State, writer: str | None = None, writer_batch: int | None = None,
           now: datetime | None = None, fill_gaps: bool = False, keep_suppliers: bool = False,
           rewrite_after: int = REWRITE_AFTER) -> Ingested | None:
    """Run one batch against the stored state and commit it.

    Pages are parsed once: the flat notices are written next to the state and
    announcements, cards and mentions are made from that table. Refused pages stay in it,
    flagged, as the table of rejects; of several copies of a url the first one not refused is
    stored. The counters are observed while the rows are written.

    The state numbers its batches itself. A writer that may run a batch again
    names itself and its own number: what this pair has already committed is
    skipped and gives None.
    """
    stored = state.view()
    if writer is not None and (writer, writer_batch) in stored.written:
        return None
    batch = state.claim()
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    seen, judged, new, found = (Observation() for _ in range(4))

    blocks = html_blocks(new_pages(pages, stored, seen)).withColumn("refused", refused_page())
    read = notices(blocks, fill_gaps)
    state.stage("notices", batch, read.observe(judged, F.count_if("refused").alias("refused")))
    read = state.staged("notices", batch, read.schema)
    flat = first_good(read)

    state.stage("announcements", batch, announcements_of(flat, now).observe(new, F.count(F.lit(1)).alias("new")))
    announcements = state.staged("announcements", batch, ANNOUNCEMENTS)
    state.add_urls(batch, announcements)
    candidates = candidates_of(flat)
    state.stage("candidates", batch, candidates.observe(found, F.count_if(has_card_key()).alias("kept")))
    kept = kept_candidates(state.staged("candidates", batch, candidates.schema))
    cards = state.add_cards(batch, seen_cards(kept, F.lit(now)), stored, rewrite_after)
    # The announcements are new, so none of their mentions can be stored.
    state.stage("mentions", batch, distinct_mentions(mentions_of(kept)))
    state.stage("statistics", batch, batch_statistics(
        announcements, kept, state.staged("mentions", batch, MENTIONS)), "kind")
    if keep_suppliers:
        state.stage("winners", batch, winners_of(state.staged("candidates", batch, candidates.schema)))
    state.commit(batch, cards, writer, writer_batch)

    n_pages, n_new, n_refused = seen.get["pages"], new.get["new"], judged.get["refused"]
    return Ingested(pages=n_pages, new_notices=n_new, skipped=n_pages - n_new - n_refused,
                    refused=n_refused, card_writes=found.get["kept"])
