from pyspark.sql import functions as F

from noticeflow.operators import dom, generic_pages, notice_tables
from noticeflow.operators.html_blocks import html_blocks, lay_out, parse_page


def shape(html):
    """tag -> joined text of the first element of each tag."""
    els, texts = parse_page(html)
    out = {}
    for e in els:
        out.setdefault(e[6], "|".join(t[0] for t in texts[e[3]:e[4]]))
    return out


def test_open_tags_are_closed():
    els, texts = parse_page("<ul><li>a<li>b</ul><p>c<p>d<div>e</div>")
    assert [e[6] for e in els] == ["#root", "ul", "li", "li", "p", "p", "div"]
    assert ["".join(t[0] for t in texts[e[3]:e[4]]) for e in els[2:]] == ["a", "b", "c", "d", "e"]
    parents = [e[1] for e in els]
    assert parents == [-1, 0, 1, 1, 0, 0, 0]


def test_table_cells_close_each_other():
    assert shape("<table><tr><td>a<td><p>b<tr><th>c</table>d")["tr"] == "a|b"
    assert shape("<table><tr><td>a<td>b<tr><th>c</table>d")["table"] == "a|b|c"


def test_stray_end_tag_does_not_leave_a_table():
    assert shape("<div><table><tr><td>a</div>b</td></tr></table></div>")["td"] == "ab"


def test_scripts_comments_entities_and_attributes():
    els, texts = parse_page("<p class='x  y' ID=i>a<!-- <p>no</p> -->&amp;b<script>'<p>no</p>'</script>"
                            "<a HREF=/u?a=1&amp;b=2>c</a><br/>d<style>p{}</style>")
    p = next(e for e in els if e[6] == "p")
    assert (p[7], p[8]) == ("x y", "i")
    assert [t[0] for t in texts] == ["a", "&b", "c", "d"]
    assert next(e for e in els if e[6] == "a")[9] == "/u?a=1&b=2"


def test_entities_without_semicolon():
    assert [t[0] for t in parse_page("<p>a&amp</p><p>&quotb&lt;c &am</p>")[1]] == ["a&", '"b<c &am']


def test_broken_markup_does_not_fail():
    for html in ("", "<", "<p", "a<b", "<p title=it's>x</p>", "</p></div>", "<td>" * 50, "<!-- open", "<script>x"):
        parse_page(html)


def test_gap_marks_white_space():
    _, texts = parse_page("<b>2024</b>-01 <i>05</i><u>x</u>\n<s>y</s>")
    assert [(t[0], t[1]) for t in texts] == [("2024", False), ("-01", False), ("05", True), ("x", False), ("y", True)]


def grid(rows):
    """Expand runs to a column-per-cell picture."""
    return ["".join(str(r[0]) * r[3] for r in row) for row in lay_out(rows)]


def test_grid_with_spans():
    assert grid([[(1, 1, 2), (2, 2, 1)], [(3, 1, 1), (4, 1, 1), (5, 1, 1)]]) == ["122", "134"]
    assert grid([[(1, 2, 2), (2, 1, 1)], [(3, 1, 1)], [(4, 1, 1), (5, 1, 3), (6, 1, 1)]]) == ["112", "113", "456"]
    # Rows below keep what was placed first; spans end with the table.
    assert grid([[(1, 1, 9), (2, 1, 1)], [(3, 2, 1)], [(4, 1, 1)]]) == ["12", "13", "14"]
    assert lay_out([]) == [] and lay_out([[], []]) == [[], []]


def test_huge_spans_stay_small():
    assert lay_out([[(1, 10**9, 10**9)], [(2, 1, 1)]]) == [[(1, 0, 0, 10**9)], [(1, 0, 0, 10**9)]]


def pages_of(spark, *htmls, base="http://h.example/list/"):
    return html_blocks(spark.createDataFrame(
        [(i, base, h) for i, h in enumerate(htmls)], "page_id int, url string, html string"))


def test_null_page_has_no_blocks(spark):
    row = pages_of(spark, None).first()
    assert row.els == [] and row.texts == [] and row.tables == []


def test_invalid_bytes_do_not_stop_the_job(spark):
    df = spark.sql("SELECT 'u' AS url, CAST(X'3C703E61FF623C2F703E' AS STRING) AS html")
    row = html_blocks(df).first()
    assert row.texts[0].s == "a\ufffdb"


def test_generic_detail(spark):
    rows = generic_pages.generic_detail(pages_of(
        spark, "<title>站点名称很长的</title><h1>短</h1><nav>2020-01-01</nav><div id=Content-x>正文<p>日期 2024.01.05</div>",
        "<h1>一个够长的标题</h1><p>a<footer>b</footer>2024年1月5日",
        "<div class=page-title>类标题也可以用</div>", "")).orderBy("page_id").collect()
    assert [(r.title, r.content, r.publish_date) for r in rows] == [
        ("站点名称很长的", "正文\n日期 2024.01.05", "2024.01.05"),
        ("一个够长的标题", "一个够长的标题\na\n2024年1月5日", "2024年1月5日"),
        ("类标题也可以用", "类标题也可以用", None), ("未知标题", "", None)]


def test_page_links_stop_after_enough(spark):
    few = "".join(f"<a class=item href=/x{i}.html>一个足够长的链接文字{i}</a>" for i in range(3))
    many = "".join(f"<li><a class=title href=y{i}.shtml>另一个足够长的链接{i}</a> 2024-01-0{i % 9}</li>" for i in range(12))
    rows = generic_pages.page_links(pages_of(spark, few, many, "<li><a href=//o/x>外站链接不会保留的</a>")).collect()
    first = [r for r in rows if r.page_id == 0]
    # Class hits, then the same links again by href; li, tr and div find none.
    assert len(first) == 6 and first[0].link_url == "http://h.example/x0.html"
    second = [r for r in rows if r.page_id == 1]
    assert len(second) == 12 and {r.link_date for r in second} == {None}
    assert not [r for r in rows if r.page_id == 2]


def test_page_links_without_limits(spark):
    many = "".join(f"<a class=title href=/a/{i}>某某项目中标公告第{i:03d}号</a>" for i in range(150))
    items = "".join(f"<li><a href=/b/{i}>另一个项目成交公告{i:03d}</a></li>" for i in range(30))
    blocks = pages_of(spark, many + items)
    usual = [r["link_url"] for r in generic_pages.page_links(blocks).collect()]
    every = [r["link_url"] for r in generic_pages.page_links(blocks, per_selector=None, enough=None).collect()]
    assert len(usual) == 100 and usual == every[:100]
    assert every == [*[f"http://h.example/a/{i}" for i in range(150)], *[f"http://h.example/b/{i}" for i in range(30)]]
    some = generic_pages.page_links(blocks, per_selector=20, enough=25).collect()
    assert len(some) == 20 + 20


def test_link_date_comes_from_the_item(spark):
    row = generic_pages.page_links(pages_of(
        spark, "<table><tr><td><a href=../z.htm>表格里的一个很长的链接</a><td>2024<b>-01-05</b></tr></table>")).first()
    assert (row.link_url, row.link_date) == ("http://h.example/z.htm", "2024-01-05")


def test_table_profile_counts_direct_cells(spark):
    html = ("<table><tr><th colspan=2>a</th></tr><tr><td class='x title' rowspan=2>b<td>c</tr></table>"
            "<table><tr><td>x</table><table></table>")
    rows = notice_tables.table_profile(pages_of(spark, html)).orderBy("table_no").collect()
    assert [(r.total_rows, r.max_cols, r.has_colspan, r.has_rowspan, r.header_rows, r.complexity) for r in rows] == [
        (2, 2, True, True, 2, "high"), (1, 1, False, False, 0, "simple")]


def test_key_values(spark):
    html = ("<div class='table'><table>"
            "<tr><th>甲：</th><td>1</td><td>1</td><td>2</td></tr>"
            "<tr><td>乙</td><td>3</td></tr>"                       # no header cell: skipped
            "<tr><th colspan=2>丙</th><td>4</td></tr>"             # a wide key is met again
            "<tr><th colspan=3>丁</th><td>5</td></tr>"             # group heading
            "<tr><th rowspan=2>戊</th><td>6</td></tr><tr><td>7</td></tr>"
            "<tr><td></td><th>己:</th><td></td></tr>"              # no value
            "</table></div>")
    row = pages_of(spark, html).select(notice_tables.key_values().alias("kv")).first()
    assert [(p.key, p.value) for p in row.kv] == [("甲", "1 2"), ("丙", "丙 4"), ("戊", "6")]


def test_summary_fields_exact_loose_and_last(spark):
    pairs = [("项目名称", "a"), ("采购单位", "b"), ("采购单位的地址", "c"), ("采购人", "d"), ("采购单位", "e"),
             ("评审专家（名单）", "x"), ("无关", "y"), ("成交金额（万元）", "9")]
    df = spark.createDataFrame([(pairs,)], "p array<struct<key:string,value:string>>")
    s = df.select(notice_tables.summary_fields(F.col("p")).alias("s")).first().s
    # 采购单位 came first, 采购人 later: the later key wins. The loose key holds 采购单位.
    assert (s.project_info.name, s.buyer.name, s.experts, s.amount.bid) == ("a", "d", "x", "9")
    assert s.buyer.address == ""


def test_text_of_uses_separator(spark):
    b = pages_of(spark, "<p> a <b>b</b>c</p>")
    p = dom.find(dom.els(), dom.tag_is("p"))
    assert b.select(dom.text_of(p, "-").alias("t")).first().t == "a-b-c"


def test_pages_are_parsed_in_small_parts(spark):
    """The blocks of a whole Arrow batch are never held at once, and no page is lost."""
    df = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") == 500, F.repeat(F.lit("<p>x"), 400_000)).when(
        F.col("id") != 7, F.concat(F.lit("<p>"), F.col("id"))).alias("html"))
    blocks = html_blocks(df)
    assert blocks.count() == 1000
    assert blocks.select(F.sum(F.size("texts"))).first()[0] == 998 + 400_000
    import pyarrow as pa

    from noticeflow.operators import html_blocks as module
    batch = pa.RecordBatch.from_pydict({"html": ["x"] * 100 + ["y" * (3 << 20)] + [None] + ["z" * (1 << 19)] * 5})
    parts = list(module._parts(batch, "html"))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in parts] == [64, 36, 1, 3, 2, 1]


def test_contacts_end_with_their_block(spark):
    rows = generic_pages.generic_contact(pages_of(
        spark, "<title>Write to a.b@mail.example.com</title><nav>Home</nav><p>1391234<p>5678",
        "<p>a@<b>mail</b>.example.com<br>next</p>13<i>8</i>12345678<div>9", "<div>x <b>y@z.example</b></div>com")).orderBy("page_id").collect()
    assert [(r.phone, r.email) for r in rows] == [
        (None, "a.b@mail.example.com"), ("13812345678", "a@mail.example.com"), (None, "y@z.example")]
