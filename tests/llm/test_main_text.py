import random
import time

import pytest

from noticeflow.llm import main_text

NAV = '<nav><ul><li><a href="/a">menu one</a><li><a>menu two</a></ul></nav>'
PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p> five six";</script></head>'
        '<body>{nav}<div class="cookie-notice">we use cookies here</div>{open}<h1>Title &amp; more</h1>'
        '<p>First   <b>bold\n</b> words here<br>next&nbsp;line<p>Second &lt;b&gt; part'
        '<div class="ad">buy this now</div><form><p>name <input></form><p>Last one.{close}'
        '<div id="comments"><p>great post thanks a lot</p></div><aside>side words</aside><footer>foot</footer></body></html>')
WANT = "Title & more\n\nFirst bold words here next line\n\nSecond <b> part\n\nLast one."


def page(tag):
    return PAGE.format(nav=NAV, open=f"<{tag}>" if tag else "", close=f"</{tag.split()[0]}>" if tag else "")


def test_regions(spark):
    rows = [(1, page("article"), "a"), (2, page("main"), "b"), (3, page('div id="body"'), "c"), (4, None, "d"), (5, "", "e"),
            (6, "plain words only", "f"), (7, "<script>x</script>", "g"), (8, "<p>a < b &#x41; <i>c", "h"),
            (9, "<p>" + "<div>" * 3000 + "deep", "i"), (1, page("article"), "a")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = main_text.main_text(pages, main_text.learn(pages))
    assert out.columns == ["page_id", "html", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[3] == WANT
    assert text[4] == text[5] == text[7] == ""
    assert text[6] == "plain words only" and text[8] == "a < b A c" and text[9] == "deep"


def test_learned_boilerplate(spark):
    html = "<body><div class=zed>other stories you may like today</div><article><p>Real words.</p></article></body>"
    pages = spark.createDataFrame([(i, html) for i in range(5)] + [(9, html.replace("article", "div"))],
                                  "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in main_text.main_text(pages, main_text.learn(pages)).collect()}
    assert out[0] == out[9] == "Real words."


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert main_text.main_text(pages, main_text.learn(pages)).collect() == []


def test_the_run_is_the_best_of_all():
    """Against every run of tokens of random pages."""
    rng = random.Random(1)
    weights = main_text.Weights({main_text.bucket("word", t): c for t, c in
                                 {"p": (90, 10), "li": (10, 90), "h1": (60, 40), "div.x": (1, 30)}.items()})
    for _ in range(60):
        html = "".join(f"<{t}>{' '.join('w' + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 6)))}</{t.split()[0]}>"
                       for t in rng.choices(["p", "li", "h1", "div class=x"], k=rng.randint(1, 12)))
        toks = main_text.tokens(html)
        scores = [weights.of_tag(t[0]) if t[1] is None else len(t[1].split()) * weights.of_word(t[0]) for t in toks]
        runs = [(sum(scores[i:j + 1]), i, j) for i in range(len(toks)) for j in range(i, len(toks))]
        best, i, j = max(runs, key=lambda r: (round(r[0], 9), -r[1], -r[2]))
        want = [] if best <= 0 else [t[1] for t in toks[i:j + 1] if t[1] is not None and weights.of_word(t[0]) > -1.0]
        assert main_text.extract(html, weights).split() == " ".join(want).split()


@pytest.mark.parametrize("html", ["<p x='" * 150_000, "<p " * 300_000, "<p<p" * 200_000 + "'", "<p x='>' " * 100_000,
                                  "<div>" * 80_000 + "</b>" * 150_000, "<!--" * 200_000,
                                  "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000,
                                  "<p><td>" + "<b>" * 50_000 + "<div></div>" * 50_000])
def test_malformed_pages_take_linear_time(html):
    start = time.process_time()
    main_text.tokens(html)
    assert time.process_time() - start < 6  # going back made each of these take minutes


def test_whole_names_decide():
    says = main_text.names_boilerplate
    assert all(map(says, ["ad", "cookie-notice", "comment-list", "sidebar_left", "site-header", "related-posts", "share"]))
    assert not any(map(says, ["share-price", "search-for-life", "story", "content", "main", "advent", "post-body", ""]))
    weights = main_text.Weights({})
    for attributes in ('class="share-price"', 'id=search-for-life', 'title="hidden gem"', 'data-x="class=ad"'):
        assert main_text.extract(f"<div {attributes}><p>Words of a story.</p></div>", weights) == "Words of a story."
    for attributes in ('class="x comment-list"', "hidden", 'ROLE=dialog', 'style="display: none"'):
        assert main_text.extract(f"<div {attributes}><p>Words.</p></div>", weights) == ""


def test_a_story_beside_the_article_is_found(spark):
    common = "<body><ul><li><a>one two</a></ul><article><h1>Head</h1><p>" + "word " * 60 + "</p></article><div class=zone9><p>more from us</p></div>"
    odd = "<body><article><h1>Headline</h1></article><div class=story><p>" + "tale " * 80 + "</p></div>"
    pages = spark.createDataFrame([(i, common) for i in range(300)] + [(999, odd)], "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in main_text.main_text(pages, main_text.learn(pages)).collect()}
    assert out[999] == "Headline\n\n" + "tale " * 79 + "tale"
    assert out[0] == "Head\n\n" + "word " * 59 + "word"  # what stands in zone9 everywhere is learned to be outside


def test_more_contexts_than_ever_listed(spark):
    """Weights do not depend on how many other contexts there are."""
    boiler = [(i, f"<body><div class=q{i}>{'never read this ' * 4}</div><article><p>Real words.</p></article>") for i in range(7000)]
    pages = spark.createDataFrame(boiler, "page_id long, html string")
    weights = main_text.learn(pages)
    assert {main_text.extract(html, weights) for _, html in boiler[::500]} == {"Real words."}
