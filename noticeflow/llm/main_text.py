"""The main text of a page as the best-scoring run of its tokens.

A page is a sequence of words and tags. Words score by the elements they stand in, tags score
below zero, and one linear scan finds the contiguous run with the largest sum. Weights come
from labelled pages: those with exactly one article (or else one main element), whose words
inside are content. Whether a word stands in an article is its label only, never a feature: a
page is scored by its other elements and their classes, whatever labels it has. Counts are
made over all pages, of contexts hashed into `BUCKETS` buckets, so the driver gets at most so
many rows and no context is left out. What is never content (scripts, forms, menus, adverts,
notices, comments, ...) has no weight in the scan and is left out of the text.

Markup is read once from front to back: unclosed quotes, end tags without a start and deep
nesting cost no more than others.
"""

from __future__ import annotations

import functools
import html
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices

BUCKETS = 1 << 17
TAG_COST = -0.2
#: Words of an element within another one of a class count against so many words of the
#: element anywhere, so that a container seen a few times decides nothing.
BACK_OFF_WORDS = 500.0

# Fixed values of the markup language.
RAW = frozenset("script style textarea noscript template iframe svg math object select xmp title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button dialog menu fieldset input".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toc toolbar tooltip widget".split())
# Words that say where or how something stands, not what it is: cookie-bar, comment-list, sidebar-left.
PLACING_WORDS = frozenset(
    "area bar block bottom box btn button cell col column container content desktop fixed form global group holder icon "
    "icons inner item items left link links list main mobile outer page panel post posts primary region right row "
    "secondary section site slot sticky text title top unit wrap wrapper zone".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
            "option": "option", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody"}
SIBLING_STOPS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table",
                 "option": "select", "tbody": "table", "tfoot": "table"}

NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
STOP = re.compile(r"[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[a-z]+")
UNLABELLED = frozenset(("article", "main", "body", "html"))  # the labels, and what holds them


def markup(page: str):
    """(tag, is an end tag, attributes) for tags and (None, text, None) for texts, in order.

    A tag ends at the first ">" outside quotes; a "<" without one is text. Comments,
    declarations and elements whose content is not text are left out.
    """
    last = max(page.rfind(c) for c in ">\"'")
    failed: set[int] = set()      # quotes from which no tag ends
    known = (0, -1)               # nothing ends or quotes between these two places but the second

    def end_of_tag(at: int) -> int:
        nonlocal known
        opened = []
        while at <= last:
            if not known[0] <= at <= known[1]:
                known = (at, STOP.search(page, at).start())
            stop = known[1]
            if page[stop] == ">":
                return stop
            if stop in failed:
                break
            opened.append(stop)
            at = page.find(page[stop], stop + 1) + 1
            if not at:
                break
        failed.update(opened)
        return -1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield None, page[at:lt if lt > 0 else n], None
            if lt < 0:
                return
        m = NAME.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                yield None, "<", None
                at = lt + 1
            continue
        stop = end_of_tag(m.end())
        if stop < 0:
            yield None, "<", None
            at = lt + 1
            continue
        tag, at = m[2].lower(), stop + 1
        if tag in RAW and not m[1]:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else n
            continue
        yield tag, bool(m[1]), page[m.end():stop]


def attributes_of(text: str) -> dict[str, str]:
    """Names in lower case with their values; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def names_boilerplate(name: str) -> bool:
    """A whole class name or id that says boilerplate: one of its words does, and the others only place it.

    So comment-list and sidebar_left do, share-price and search-for-life do not.
    """
    words = PART.findall(name)
    return not BOILERPLATE_NAMES.isdisjoint(words) and all(w in BOILERPLATE_NAMES or w in PLACING_WORDS for w in words)


def _is_boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS and not (tag == "header" and in_article):
        return True
    if tag in ("body", "html", "main") or not attributes:
        return False
    if any(names_boilerplate(n) for key in ("class", "id") for n in attributes.get(key, "").lower().split()):
        return True
    return ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or attributes.get("role", "").lower() in BOILERPLATE_ROLES
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower()) is not None)


def tokens(page: str) -> list[tuple]:
    """(context, text, block, inside) for text and (tag, None, block, inside) for tags, in order.

    The context of a text is None under boilerplate, else its nearest block element and what
    holds that, each with its first class, and "a" within a link; article and main
    elements are no part of it. `block` changes wherever a block begins or ends; `inside` tells
    whether an article or a main element is open.
    """
    out, stack, block = [], [], 0  # stack of (tag, boilerplate above or here, block, holder)
    where: dict[str, list[int]] = {}  # places in the stack of each open tag, and of blocks under ""

    def nearest(tag):
        places = where.get(tag)
        return places[-1] if places else -1

    def close_to(depth):
        while len(stack) > depth:
            tag = stack.pop()[0]
            where[tag].pop()
            if tag not in INLINE:
                where[""].pop()

    def inside():
        return bool(where.get("article")), bool(where.get("main"))

    for tag, end, text in markup(page):
        if tag is None:
            _, off, label, holder = stack[-1] if stack else ("", False, "", "")
            context = None if off else (f"{holder}>{label}" if holder else label) + ("|a" if where.get("a") else "")
            out.append((context, end, block, *inside()))
            continue
        if end:
            if nearest(tag) >= 0:
                close_to(nearest(tag))
        else:
            if tag in CLOSES_P:
                if nearest("p") >= 0 and nearest("p") == nearest(""):
                    close_to(nearest("p"))
            elif tag in SIBLINGS:
                limit = max(nearest(t) for t in SIBLING_STOPS[tag].split())
                while (at := max(nearest(t) for t in SIBLINGS[tag].split())) > limit:
                    close_to(at)
            if tag not in VOID and not text.endswith("/"):
                attributes = attributes_of(text) if text else {}
                above, off, label, holder = stack[-1] if stack else ("", False, "", "")
                off = off or _is_boilerplate(tag, attributes, bool(where.get("article")))
                if tag not in INLINE:
                    holder = label or holder
                    names = attributes.get("class", "").lower().split()
                    label = "" if tag in UNLABELLED else tag + (f".{names[0]}" if names else "")
                where.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    where.setdefault("", []).append(len(stack))
                stack.append((tag, off, label, holder))
        if tag not in INLINE and tag != "br":
            block += 1
        elif tag == "br":
            out.append((None, " ", block, False, False))
        out.append((tag, None, block, *inside()))
    return out


def labelled_by(page: str) -> int | None:
    """3 if the page has one article, 4 if it has none but one main element: the field that labels it."""
    n = len(re.findall(r"<article[\s>]", page, re.I))
    if n == 1:
        return 3
    return 4 if not n and len(re.findall(r"<main[\s>]", page, re.I)) == 1 else None


def bucket(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind} {name}".encode()) % BUCKETS


class Weights:
    """Log odds that a word in an element is content, and that a tag stands within content."""

    def __init__(self, counts: dict[int, tuple[int, int]]):
        self.counts = counts  # by bucket: words or tags inside and outside content

    def _odds(self, n_in: float, n_out: float) -> float:
        return max(-3.0, min(3.0, math.log((n_in + 0.5) / (n_out + 0.5))))

    def of_word(self, context: str) -> float:
        """Of the element within its holder as far as it was seen, else of the element anywhere."""
        element = context.rpartition(">")[2]
        known = self.counts.get(bucket("word", element))
        odds = self._odds(*known) if known else -0.5 if context.endswith("|a") else 1.0
        if element == context or not (held := self.counts.get(bucket("held", context))):
            return odds
        share = 1.0 / (1.0 + math.exp(-odds))
        return self._odds(held[0] + BACK_OFF_WORDS * share, held[1] + BACK_OFF_WORDS * (1.0 - share))

    def of_tag(self, tag: str) -> float:
        known = self.counts.get(bucket("tag", tag))
        return min(TAG_COST, 0.2 * self._odds(*known)) if known else TAG_COST


def extract(page: str, weights: Weights) -> str:
    """The text of the best region: blocks joined by blank lines; empty if nothing scores above 0."""
    toks = tokens(page)
    word_score, tag_score = functools.cache(weights.of_word), functools.cache(weights.of_tag)
    best = total = 0.0
    first = last = at = -1
    scores = []
    for i, tok in enumerate(toks):
        if tok[1] is None:
            s = tag_score(tok[0])
        elif tok[0] is None or not (n := len(tok[1].split())):
            scores.append(0.0)
            continue
        else:
            s = n * word_score(tok[0])
        scores.append(s)
        if total <= 0:
            total, at = 0.0, i
        total += s
        if total > best:
            best, first, last = total, at, i
    if last < 0:
        return ""
    # Character data right beside the region belongs to the block it starts or ends in.
    while last + 1 < len(toks) and toks[last + 1][2] == toks[last][2]:
        last += 1
    while first > 0 and toks[first - 1][2] == toks[first][2]:
        first -= 1
    blocks: dict[int, list[str]] = {}
    for i in range(first, last + 1):
        where, text, block, *_ = toks[i]
        if text is None or (where is None and text != " "):
            continue
        if where is not None and scores[i] < 0 and word_score(where) <= -1.0:
            continue  # learned boilerplate between content
        blocks.setdefault(block, []).append(text)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def learn(pages: DataFrame, content: str = "html") -> Weights:
    """Weights from the labelled ones of all pages; the driver gets one row for a bucket."""
    def run(batches):
        counts = {True: Counter(), False: Counter()}
        for batch in slices(batches, "html", 8 << 20):
            for page in batch.column("html").to_pylist():
                field = labelled_by(page)
                if field is None:
                    continue
                for tok in tokens(page):
                    if tok[1] is None:
                        if tok[0] not in ("article", "main", "body", "html"):
                            counts[tok[field]][bucket("tag", tok[0])] += 1
                    elif tok[0] is not None and (n := len(tok[1].split())):
                        element = tok[0].rpartition(">")[2]
                        counts[tok[field]][bucket("word", element)] += n
                        if element != tok[0]:
                            counts[tok[field]][bucket("held", tok[0])] += n
        keys = sorted(counts[True] | counts[False])
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(keys, pa.int32()), "n_in": pa.array([counts[True][k] for k in keys], pa.int64()),
            "n_out": pa.array([counts[False][k] for k in keys], pa.int64())})

    found = (pages.where(F.col(content).isNotNull()).select(F.col(content).alias("html"))
             .mapInArrow(run, "bucket int, n_in long, n_out long")
             .groupBy("bucket").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")))
    return Weights({r["bucket"]: (r["n_in"], r["n_out"]) for r in found.collect()})


def main_text(pages: DataFrame, weights: Weights, content: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each in `into`; an input column of that name is replaced.

    A null or empty page, and one without content, has an empty text. Repeated rows stay.
    """
    pages = pages.drop(into) if into != content else pages
    position = pages.columns.index(content)

    def run(batches):
        for batch in slices(batches, content, 8 << 20):
            texts = [extract(p, weights) for p in pc.fill_null(batch.column(position), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, into])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())]))
