from urllib.parse import urljoin

from pyspark.sql import functions as F

from noticeflow.functions import urls

BASES = ["http://h.example/a/b/c.htm?q=1#f", "https://h.example", "http://h.example/a/", "http://h:80/x?y=/z/"]
LINKS = ["", "http://o/x", "https://o/x", "/x", "/x/../y?z=../w", "x.htm", "./x", "../x", "../../../x", "?p=2",
         "#top", "//o/x", "a/./b/../c", "..", ".", "mailto:a@b.cn", "javascript:void(0)", "x?y=1#z"]


def test_join_equals_urljoin(spark):
    rows = [(b, l) for b in BASES for l in LINKS]
    df = spark.createDataFrame(rows, "b string, l string")
    got = df.select("b", "l", urls.join_url(urls.url_parts(F.col("b")), F.col("l")).alias("y")).collect()
    # An empty reference keeps the base; the fragment does not matter to a page.
    wrong = [(r.b, r.l, r.y) for r in got if r.l and r.y != urljoin(r.b, r.l)]
    assert wrong == []


def test_absolute_url_keeps_host(values):
    base = urls.url_parts(F.lit("http://h.example/a/"))
    assert values(lambda c: urls.absolute_url(c, base), [None, "", "http://o/x", "//o/x", "x", "mailto:a@b"]) == [
        None, None, "http://o/x", None, "http://h.example/a/x", "mailto:a@b"]


def test_site_type(values):
    assert values(urls.site_type, ["http://www.ccgp.gov.cn/x", "http://else/"]) == ["ccgp", "ccgp"]
    assert values(lambda c: urls.site_type(c, "other"), ["http://ccgp-x.gov.cn/", None]) == ["ccgp", "other"]
