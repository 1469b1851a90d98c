from datetime import datetime

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from noticeflow.plans import ingest as plan
from noticeflow.schema import PAGES
from noticeflow.sources.state import State
from noticeflow.streaming.ingest import first_seen, first_seen_table, ingest_stream, page_stream

NOW, LATER = datetime(2024, 2, 1), datetime(2024, 3, 1)


def notice(buyer, person, phone, supplier="商"):
    return (f"<meta name=ArticleTitle content='公告{buyer}'><meta name=PubDate content=2024年1月5日>"
            "<div class=vF_detail_content><p>中标（成交）信息<p>供应商名称：" + supplier +
            f"<p>采购人信息<p>名称：{buyer}<p>联系方式：{person}{phone}</div>")


ROWS = [
    ("//n/1", notice("甲校", "李雷", "010-11112222"), "", "", NOW, 1),
    (" http://n/1 ", notice("乙校", "王五", "010-33334444"), "", "", NOW, 2),      # the same url once cleaned
    ("http://n/2", notice("甲校", "李雷", "13811112222"), "列表标题 ", "2024.02.03", NOW, 3),
    ("http://n/3", "<p>访问过于频繁</p>", "", "", NOW, 4),
    ("http://n/4", "", "", "", NOW, 5),
    ("", notice("丙校", "赵六", "010-55556666"), "", "", NOW, 6),
]


def tables(state):
    return (sorted((r.url, r.title, r.publish_date, str(r.publish_day), r.source) for r in state.announcements().collect()),
            sorted((r.company, r.contact_name, tuple(r.phones), r.created_at, r.updated_at) for r in state.cards().collect()),
            sorted((r.business_card_id, r.announcement_id, r.role) for r in state.mentions().collect()))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES)


def test_one_batch(spark, pages, tmp_path):
    state = State(spark, str(tmp_path))
    run = plan.ingest(pages, state, now=NOW, keep_suppliers=True)
    assert run == plan.Ingested(pages=6, new_notices=2, skipped=3, refused=1, card_writes=2)
    a, c, m = tables(state)
    assert a == [("http://n/1", "公告甲校", "2024-1-5", "2024-01-05", "ccgp-bxsearch"),
                 ("http://n/2", "列表标题", "2024-02-03", "2024-02-03", "ccgp-bxsearch")]
    assert c == [("甲校", "李雷", ("010-11112222", "13811112222"), NOW, NOW)]
    assert len(m) == 2 and {r[2] for r in m} == {"buyer"}
    rejects = spark.read.parquet(f"{tmp_path}/notices/batch=0").filter("refused").collect()
    assert [r.url for r in rejects] == ["http://n/3"]
    winners = spark.read.parquet(f"{tmp_path}/winners/batch=0").collect()
    assert {w.company for w in winners} == {"商"} and len(winners) == 2


def test_second_batch_adds_only_what_is_new(spark, pages, tmp_path):
    state = State(spark, str(tmp_path))
    plan.ingest(pages, state, now=NOW)
    before = tables(state)
    again = plan.ingest(pages, state, now=LATER)
    assert (again.new_notices, again.card_writes) == (0, 0) and tables(state) == before
    more = spark.createDataFrame([("http://n/9", notice("甲校", "李雷", "010-11113333"), "", "", LATER, 9)], PAGES)
    plan.ingest(more, state, now=LATER)
    assert tables(state)[1] == [("甲校", "李雷", ("010-11112222", "010-11113333", "13811112222"), NOW, LATER)]
    # A refused page was not stored: a good copy is taken later.
    good = spark.createDataFrame([("http://n/3", notice("丁校", "孙八", "010-1112222"), "", "", LATER, 10)], PAGES)
    assert plan.ingest(good, state, now=LATER).new_notices == 1


def test_empty_batch(spark, pages, tmp_path):
    state = State(spark, str(tmp_path))
    assert plan.ingest(pages.limit(0), state, now=NOW) == plan.Ingested(0, 0, 0, 0, 0)
    assert plan.ingest(pages, state, now=NOW).new_notices == 2


def test_committed_batch_is_not_applied_twice(spark, pages, tmp_path):
    state = State(spark, str(tmp_path))
    assert plan.ingest(pages, state, "w", 0, now=NOW) is not None
    assert plan.ingest(pages, state, "w", 0, now=LATER) is None
    assert plan.ingest(pages, state, "w", 1, now=LATER).new_notices == 0


def test_batch_then_streams_into_one_state(spark, pages, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    plan.ingest(pages.filter("ingest_seq = 1"), state, now=NOW)
    for n, seq in enumerate((3, 6)):
        more = spark.createDataFrame([(f"http://late/{seq}", notice("丙校", "赵六", "010-55556666"), "", "", NOW, seq)], PAGES)
        more.write.parquet(str(tmp_path / f"in{n}"))
        ingest_stream(page_stream(spark, str(tmp_path / f"in{n}")), state, str(tmp_path / f"p{n}")).awaitTermination()
    assert {r.url for r in state.announcements().collect()} == {"http://n/1", "http://late/3", "http://late/6"}


def test_good_copy_of_a_refused_page(spark, tmp_path):
    refusal = "<p>访问过于频繁</p>"
    rows = [("http://a", refusal, 1), ("http://a", notice("甲校", "李雷", "010-11112222"), 2),
            ("http://a", notice("乙校", "王五", "010-33334444"), 3),
            ("http://b", "", 4), ("http://b", notice("丙校", "赵六", "010-55556666"), 5),
            ("http://c", refusal, 6), ("http://c", refusal, 7),
            ("http://d", "<script>稍后再试</script>" + notice("丁校", "孙八", "010-1112222"), 8),
            ("http://d", notice("戊校", "周九", "010-1113333"), 9)]
    state = State(spark, str(tmp_path))
    run = plan.ingest(spark.createDataFrame(rows, "url string, html string, ingest_seq long"), state, now=NOW)
    assert (run.new_notices, run.refused) == (3, 3)
    assert {(r.url, r.title) for r in state.announcements().collect()} == {
        ("http://a", "公告甲校"), ("http://b", "公告丙校"), ("http://d", "公告丁校")}


def test_numbers_are_claimed_once(spark, tmp_path):
    one, two = State(spark, str(tmp_path)), State(spark, str(tmp_path))
    assert [one.claim(), two.claim(), one.claim()] == [0, 1, 2]
    # The later number commits first; the earlier one is not visible until it does.
    one.commit(1)
    assert one.view().batches == (1,)
    two.commit(0)
    assert two.view().batches == (0, 1)


def test_batch_that_died_is_redone(spark, pages, tmp_path, monkeypatch):
    state = State(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(State, "commit", lambda self, *_a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            plan.ingest(pages, state, now=NOW)
    assert state.announcements().count() == 0
    plan.ingest(pages, state, now=NOW)
    assert len(tables(state)[0]) == 2


def test_known_pages_never_reach_the_parser(spark, pages):
    stored = spark.createDataFrame([("http://n/1",)], "url string")
    df = plan.parsed_pages(plan.new_pages(pages, stored))
    text = plan_of(df)
    assert text.index("MapInArrow") < text.index("LeftAnti")


def test_markup_is_dealt_out_by_its_bytes(spark, tmp_path):
    """Markup that Spark packs into a single small file is parsed by all cores all the same; a short batch by one task."""
    page = F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 100_000))
    (spark.range(64).select(F.concat(F.lit("http://n/"), F.col("id").cast("string")).alias("url"), page.alias("html"),
                            F.col("id").alias("ingest_seq")).coalesce(1).write.parquet(str(tmp_path / "p")))
    pages, none = spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame([], "url string")
    chosen = plan.new_pages(pages, none)
    assert chosen.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism == 4
    assert chosen.count() == 64
    few = plan.new_pages(pages.filter("ingest_seq < 3"), none)
    assert few.select(F.spark_partition_id()).distinct().count() == 1 and few.count() == 3
    assert plan.parser_tasks(10 * plan.TASK_BYTES + 1, 4) == 11 and plan.parser_tasks(0, 4) == 1


def test_stream_equals_batch(spark, pages, tmp_path):
    whole = State(spark, str(tmp_path / "batch"))
    plan.ingest(pages, whole, now=NOW)
    arriving = str(tmp_path / "arriving")
    for i in range(1, 7):
        pages.filter(F.col("ingest_seq") == i).coalesce(1).write.mode("append").parquet(arriving)
    state = State(spark, str(tmp_path / "stream"))
    stream = page_stream(spark, arriving, PAGES, files_per_trigger=1)
    ingest_stream(stream, state, str(tmp_path / "progress")).awaitTermination()
    want, got = tables(whole), tables(state)
    assert [r[:5] for r in got[0]] == want[0] and got[2] == want[2]
    assert [r[:3] for r in got[1]] == [r[:3] for r in want[1]]
    # Nothing new: a restart from the same progress changes nothing.
    ingest_stream(stream, state, str(tmp_path / "progress")).awaitTermination()
    assert tables(state)[0] == got[0]


@pytest.mark.parametrize("spread_by", [None, "ingest_seq"])
def test_first_seen(spark, tmp_path, spread_by):
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(ROWS, PAGES).write.parquet(arriving)
    stream = first_seen(page_stream(spark, arriving), spread_by=spread_by)
    (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start(out).awaitTermination())
    urls = sorted(r.url for r in spark.read.parquet(out).collect())
    assert urls == ["", "http://n/1", "http://n/2", "http://n/3", "http://n/4"]


@pytest.mark.parametrize("spread_by", [None, "ingest_seq"])
def test_first_seen_table_keeps_late_pages(spark, tmp_path, spread_by):
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("//n/1", 1, 100), ("//n/2", 2, 1), ("http://n/1", 3, 50), ("//n/3", 4, 0), ("http://n/2 ", 5, 200)]
    for part in (rows[:3], rows[3:]):
        for url, seq, at in part:
            (spark.createDataFrame([(url, seq, datetime(2024, 1, 1).replace(year=2000 + at % 30))],
                                   "url string, ingest_seq long, scraped_at timestamp")
             .coalesce(1).write.mode("append").parquet(arriving))
        stream = page_stream(spark, arriving, spark.read.parquet(arriving).schema, files_per_trigger=1)
        query = first_seen_table(stream, out, str(tmp_path / "cp"), spread_by)
        query.awaitTermination()
    got = sorted((r.url, r.ingest_seq) for r in spark.read.parquet(out).collect())
    assert got == [("http://n/1", 1), ("http://n/2", 2), ("http://n/3", 4)]
    assert any("rocksdb" in k.lower() for s in query.lastProgress["stateOperators"] for k in s["customMetrics"])


def test_stream_dedupe_reads_a_table_of_several_files(spark, tmp_path):
    from check import rows_of

    from workload.ingest_queries import stream_dedupe
    rows = [(i, f"{'https' if i % 3 else 'http'}://h.example/{i // 2}", "") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = stream_dedupe(spark, str(tmp_path))
    assert rows_of(got.columns, got.collect()) == rows_of(["url"], {(u,) for _, u, _ in rows})
