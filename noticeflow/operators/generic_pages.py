"""Links, result lists, titles, texts and contacts of pages of any site."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chars import built_once, first, let, none_if_empty, strip, text_or_empty
from ..functions.contact import EMAIL, MOBILE
from ..functions.text import DATE_SHAPES, NO_TITLE, find_date, parse_list_info
from ..functions.urls import absolute_url, join_url, url_parts
from . import dom
from .notices import not_older, title_gate

# Fixed values.
HITS_PER_SELECTOR = 100
ENOUGH_LINKS = 10
MIN_LINK_TEXT = 10
MIN_TITLE = 5
RESULT_LIST_CLASS = "vT-srch-result-list-bid"
RESULT_BASE = "https://www.ccgp.gov.cn/"
RESULT_SOURCE = "ccgp-bxsearch"
CATEGORY_SOURCE = "中国公共资源交易网"


def page_text(sep: str = "\n", all_text: bool = False) -> Column:
    """Text of the visible page, navigation and the like left out."""
    runs = F.col("texts") if all_text else dom.visible(F.col("texts"))
    return F.array_join(runs["s"], sep)


@built_once
def page_title() -> Column:
    """First h1, h2, title or title-like element whose text is long enough."""
    def candidate(pred: dom.Predicate) -> Column:
        text = let(dom.find(dom.els(), pred), dom.plain_text)
        return let(text, lambda t: F.when(F.length(t) > MIN_TITLE, t))

    return F.coalesce(candidate(dom.tag_is("h1")), candidate(dom.tag_is("h2")),
                      candidate(dom.tag_is("title")),
                      candidate(dom.class_like("title|heading")), F.lit(NO_TITLE))


@built_once
def page_content() -> Column:
    """Text of the main container, one run per line; the body when there is none."""
    shown = dom.visible(dom.els())
    box = F.coalesce(
        dom.find(shown, dom.both(dom.tag_is("div"), dom.class_like("content|article|detail|main"))),
        dom.find(shown, dom.both(dom.tag_is("div"), dom.id_like("content|article|detail"))),
        dom.find(shown, dom.tag_is("article")),
        dom.find(shown, dom.tag_is("main")),
        dom.find(shown, dom.tag_is("body")),
        first(dom.els()))
    return text_or_empty(let(box, lambda b: F.array_join(dom.visible(dom.runs_of(b))["s"], "\n")))


@built_once
def page_date() -> Column:
    return find_date(dom.raw_text(dom.visible(F.col("texts"))))


def generic_detail(blocks: DataFrame) -> DataFrame:
    """Title, content and date of any page."""
    kept = dom.other_columns(blocks)
    return blocks.select(*kept, page_title().alias("title"), page_content().alias("content"),
                         page_date().alias("publish_date"))


def generic_contact(blocks: DataFrame) -> DataFrame:
    """First mobile number and first e-mail address of the whole page.

    Neither runs on from one block of the page into the next, as from a title into a menu.
    """
    kept = dom.other_columns(blocks)
    def has(pattern: str):
        return lambda s: s.rlike(pattern)

    text = dom.lines_text(F.col("texts"))
    title = none_if_empty(page_title())
    return (blocks.withColumn("_text", text)
            .select(*kept,
                    F.when(title != NO_TITLE, title).alias("title"),
                    # The run that holds the date, in one of two spellings.
                    F.coalesce(*[first(F.filter(F.col("texts")["s"], has(p)))
                                 for p in (DATE_SHAPES[0], DATE_SHAPES[3])]).alias("publish_date"),
                    none_if_empty(F.regexp_extract("_text", MOBILE, 0)).alias("phone"),
                    none_if_empty(F.regexp_extract("_text", EMAIL, 0)).alias("email")))


def _found(order: int, pred: dom.Predicate, most: int | None) -> Column:
    """The first elements a selector finds, with its place among the selectors."""
    hits = dom.find_all(dom.els(), pred)
    return F.transform(hits if most is None else F.slice(hits, 1, most),
                       lambda e: F.struct(F.lit(order).alias("order"), e.alias("e")))


@built_once
def link_hits() -> Column:
    return link_hits_within(HITS_PER_SELECTOR, ENOUGH_LINKS)


def link_hits_within(per_selector: int | None, enough: int | None) -> Column:
    """array<struct<order,title,url,date>>: the selectors' links in turn, until more than
    ``enough`` are found, each selector's first ``per_selector`` elements; None lifts a limit.
    Relative links are joined to the parts in ``_base``."""
    found = F.concat(*[_found(i, pred, per_selector) for i, pred in enumerate((
        dom.both(dom.tag_is("a"), dom.class_like("title|link|item")),
        dom.both(dom.tag_is("a"),
                 lambda e: F.coalesce(e["href"].rlike(r"(?i)\.(html|shtml|asp)\z"), F.lit(False))),
        dom.tag_is("li"),
        dom.tag_is("tr"),
        dom.both(dom.tag_is("div"), dom.class_like("item|list|row"))))])

    def anchor(x: Column) -> Column:
        a = F.when(x["e"]["tag"] == "a", x["e"]).otherwise(
            dom.find(dom.inside(x["e"]), dom.tag_is("a")))
        return F.struct(x["order"], x["e"], a.alias("a"))

    def titled(x: Column) -> Column:
        return F.struct(x["order"], x["e"], x["a"]["href"].alias("href"),
                        dom.text_of(x["a"]).alias("title"))

    def link(x: Column) -> Column:
        return F.struct(x["order"], x["title"],
                        absolute_url(x["href"], F.col("_base")).alias("url"),
                        let(dom.raw_text(dom.runs_of(x["e"])), find_date).alias("date"))

    linked = F.filter(F.transform(found, anchor), lambda x: x["a"].isNotNull())
    long_enough = F.filter(F.transform(linked, titled), lambda x: (
        (F.length(x["title"]) >= MIN_LINK_TEXT) & (x["href"] != "")))
    hits = F.filter(F.transform(long_enough, link), lambda x: x["url"] != "")

    def until_enough(hs: Column) -> Column:
        # A selector is tried while those before it have found ten or fewer.
        tried = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: (
            F.size(F.filter(hs, lambda h: h["order"] < k)) <= enough))
        return let(F.array_max(tried), lambda k: F.filter(hs, lambda h: h["order"] <= k))

    return hits if enough is None else let(hits, until_enough)


def page_links(blocks: DataFrame, base: str = "url", per_selector: int | None = HITS_PER_SELECTOR,
               enough: int | None = ENOUGH_LINKS) -> DataFrame:
    """One row per link of a listing page: page columns, link_pos, title, link, date (X11).

    With ``per_selector`` and ``enough`` None no link is left out; a link that several
    selectors find is then listed once for each.
    """
    kept = dom.other_columns(blocks)
    usual = (per_selector, enough) == (HITS_PER_SELECTOR, ENOUGH_LINKS)
    hits = link_hits() if usual else link_hits_within(per_selector, enough)
    return (blocks.withColumn("_base", url_parts(F.col(base)))
            .select(*kept, hits.alias("_links"))
            .select(*kept, F.posexplode("_links").alias("link_pos", "_link"))
            .select(*kept, "link_pos", F.col("_link.title").alias("link_title"),
                    F.col("_link.url").alias("link_url"), F.col("_link.date").alias("link_date")))


def listed_notices(blocks: DataFrame, as_of: datetime | str, base: str = "url") -> DataFrame:
    """Links of a listing page that name a result notice of the last days."""
    return page_links(blocks, base).filter(
        title_gate("link_title") & not_older(as_of, col="link_date"))


def result_items(blocks: DataFrame) -> DataFrame:
    """One row per item of a stored search-result page."""
    kept = dom.other_columns(blocks)
    lists = F.transform(
        dom.find_all(dom.els(), dom.both(dom.tag_is("ul"), dom.has_class(RESULT_LIST_CLASS))),
        lambda ul: F.filter(dom.inside(ul), lambda e: (
            (e["tag"] == "li") & (e["parent"] == ul["pos"]))))

    def item(li: Column) -> Column:
        a = first(F.filter(dom.inside(li), lambda e: (e["tag"] == "a") & e["href"].isNotNull()))
        span = dom.find(dom.inside(li), dom.tag_is("span"))
        return F.struct(
            let(a, lambda x: F.struct(dom.text_of(x, " ").alias("title"),
                                      strip(x["href"]).alias("href"))).alias("a"),
            text_or_empty(let(span, lambda x: dom.text_of(x, " "))).alias("info"))

    return (blocks.select(*kept, F.posexplode(F.transform(F.flatten(lists), item))
                          .alias("item_pos", "_item"))
            .filter((F.col("_item.a.title") != "") & (F.col("_item.a.href") != ""))
            .withColumn("_info", parse_list_info(F.col("_item.info")))
            .select(*kept, "item_pos", F.col("_item.a.title").alias("title"),
                    F.when(F.col("_item.a.href").startswith("http"), F.col("_item.a.href"))
                    .otherwise(join_url(url_parts(F.lit(RESULT_BASE)), F.col("_item.a.href")))
                    .alias("item_url"), "_info.publish_date",
                    "_info.buyer_name", "_info.agent_name", F.lit(RESULT_SOURCE).alias("source")))


def titled_links(blocks: DataFrame, keyword: str, site: str = "https://www.ccgp.gov.cn"
                 ) -> DataFrame:
    """Links whose text holds a keyword and whose target is an htm page."""
    kept = dom.other_columns(blocks)
    links = F.transform(dom.find_all(dom.els(), dom.tag_is("a")), lambda a: F.struct(
        dom.text_of(a).alias("title"), text_or_empty(a["href"]).alias("href")))
    href = F.col("_link.href")
    return (blocks.select(*kept, F.posexplode(F.filter(links, lambda x: (
                x["title"].contains(keyword) & x["href"].contains("htm"))))
            .alias("link_pos", "_link"))
            .select(*kept, "link_pos", F.col("_link.title").alias("link_title"),
                    F.when(href.startswith("http"), href)
                    .otherwise(F.concat(F.lit(site), href)).alias("link_url"),
                    F.lit(CATEGORY_SOURCE).alias("source")))
