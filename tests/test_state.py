"""Stored state: buckets of cards and urls, states of statistics."""

import os
from datetime import datetime

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from noticeflow.operators import cards as card_queries
from noticeflow.operators import notices
from noticeflow.plans import ingest as plan
from noticeflow.plans import statistics
from noticeflow.schema import ANNOUNCEMENTS, CARDS, PAGES
from noticeflow.sources import state as stored
from noticeflow.sources.state import State
from test_ingest import NOW, notice


def card(company, phone, day=1):
    return (None, company, "李", [phone], [], datetime(2024, 1, day), datetime(2024, 1, day))


def put(spark, state, batch, rows, after=1, view=None):
    changes = spark.createDataFrame(rows, CARDS)
    state.commit(batch, state.add_cards(batch, changes, view or state.view(), after))


def folders(path):
    return {f for f in os.listdir(path) if f.startswith("bucket=")}


def test_a_batch_rewrites_only_buckets_with_changes(spark, tmp_path):
    state = State(spark, str(tmp_path))
    put(spark, state, 0, [card(f"公司{i}", "1") for i in range(400)])
    put(spark, state, 1, [card(f"公司{i}", "2") for i in range(10)])
    assert len(folders(f"{tmp_path}/cards/batch=0")) > stored.CARD_BUCKETS * 3 // 4
    assert folders(f"{tmp_path}/cards/batch=1") == folders(f"{tmp_path}/card_changes/batch=1")
    assert 0 < len(folders(f"{tmp_path}/cards/batch=1")) <= 10
    view = state.view()
    assert view.loose_changes() == {}
    plan_text = plan_of(view.cards())
    assert "Exchange" not in plan_text and "Aggregate" not in plan_text  # nothing is regrouped
    got = {r.company: r.phones for r in view.cards().collect()}
    assert got == {f"公司{i}": ["1", "2"] if i < 10 else ["1"] for i in range(400)}


def test_only_buckets_with_loose_changes_are_regrouped(spark, tmp_path):
    state = State(spark, str(tmp_path))
    put(spark, state, 0, [card(f"公司{i}", "1") for i in range(100)])
    put(spark, state, 1, [card("公司3", "2")], after=3)
    view = state.view()
    (bucket, batches), = view.loose_changes().items()
    assert batches == [1]
    assert {r.company: r.phones for r in view.cards([bucket]).collect()}["公司3"] == ["1", "2"]
    put(spark, state, 2, [card("公司3", "3")], after=2)
    assert state.view().loose_changes() == {} and state.view().whole_buckets()[bucket].batch == 2
    assert {r.company: r.phones for r in state.cards().collect()}["公司3"] == ["1", "2", "3"]


def test_writers_at_once_lose_no_card(spark, tmp_path):
    """Both looked before the other committed, and both rewrote the bucket."""
    state = State(spark, str(tmp_path))
    put(spark, state, 0, [card("甲", "1")])
    view = state.view()
    put(spark, state, 2, [card("甲", "2")], view=view)   # number 1 is not committed yet
    put(spark, state, 1, [card("甲", "3")], view=view)
    assert [r.phones for r in state.cards().collect()] == [["1", "2", "3"]]
    put(spark, state, 3, [card("甲", "4")])
    assert state.view().loose_changes() == {}
    assert [r.phones for r in state.cards().collect()] == [["1", "2", "3", "4"]]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Four batches of notices, some pages twice."""
    state = State(spark, str(tmp_path_factory.mktemp("state")))
    rows = [(f"http://n/{i}", notice(f"北京{i % 5}校" if i % 2 else f"甲{i % 3}校", f"李{'雷梅兰'[i % 3]}", f"010-1111222{i % 10}"),
             "", f"2024-01-{1 + i % 9:02} 10:00", NOW, i) for i in range(24)]
    for n in range(4):
        plan.ingest(spark.createDataFrame(rows[max(0, n * 6 - 3):n * 6 + 6], PAGES), state, now=NOW, rewrite_after=2)
    return state


def test_known_urls_of_other_buckets_are_not_read(spark, filled):
    asked = spark.createDataFrame([("http://n/1",), ("http://other/1",)], "url string")
    known = filled.view().known_urls(asked)
    assert "dynamicpruning" in plan_of(known).lower()
    urls = {r.url for r in known.collect()}
    assert "http://n/1" in urls and len(urls) < 24
    assert [r.url for r in asked.join(known, "url", "left_anti").collect()] == ["http://other/1"]


def test_statistics_of_batches_equal_a_full_run(filled):
    view = filled.view()
    a, c, m = view.announcements(), view.cards(), view.mentions()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(statistics.totals(view)) == [("announcements", a.count()), ("mentions", m.count())]
    assert rows(statistics.count_by(view, "source")) == rows(notices.count_by_source(a))
    assert rows(statistics.count_by(view, "province")) == rows(notices.count_by_province(a))
    assert rows(statistics.count_by(view, "day")) == rows(notices.count_by_day(a))
    assert rows(statistics.count_by(view, "role")) == rows(card_queries.role_distribution(m))
    assert [tuple(r) for r in statistics.top_companies(view).collect()] == [tuple(r) for r in card_queries.top_companies(c, m).collect()]
    cols = ["company", "contact_name", "projects_count"]
    assert rows(statistics.with_project_counts(c, view).select(cols)) == rows(card_queries.with_project_counts(c, m).select(cols))


def test_statistics_read_states_only(filled):
    text = plan_of(statistics.top_companies(filled.view()))
    assert "statistics" in text and "PartitionFilters" in text and "announcements" not in text and "mentions" not in text


def test_markup_is_read_in_two_passes(spark, tmp_path):
    spark.createDataFrame([("http://n/1", "<p>x", "", "", NOW, 1)], PAGES).write.parquet(str(tmp_path / "p"))
    chosen = plan.new_pages(spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame([], "url string"))
    assert plan_of(chosen).count("html:string") == 1  # the first pass has left short rows in the checkpoint folder
    assert chosen.filter(F.col("contested")).count() == 0 and chosen.count() == 1


def laid_rows(spark, rows):
    now = NOW
    return spark.createDataFrame(
        [(i, f"t{i}", f"u{i}", "c", str(day or ""), None if day is None else datetime.fromisoformat(day).date(), s, now, now, i)
         for i, s, day in rows], ANNOUNCEMENTS)


def add(state, rows):
    n = state.claim()
    state.stage("announcements", n, rows)
    state.add_urls(n, rows)
    state.commit(n)
    return n


def seqs(df):
    return sorted(r.ingest_seq for r in df.collect())


def test_compaction_keeps_all_rows_and_prunes(spark, tmp_path):
    state = State(spark, str(tmp_path))
    assert state.compact() is None
    rows = [(i, "ab"[i % 2], f"2024-0{1 + i % 3}-15") for i in range(12)] + [(12, "", None), (13, None, "2024-01-15")]
    add(state, laid_rows(spark, rows[:6]))
    before = state.view()
    add(state, laid_rows(spark, rows[6:]))
    assert state.compact() == 2 and state.view().compaction.compacted == {0, 1}
    add(state, laid_rows(spark, [(20, "a", "2024-01-20")]))
    view = state.view()
    assert seqs(view.announcements()) == [*range(14), 20] and seqs(before.announcements()) == [*range(6)]
    assert sorted(r.source or "-" for r in view.announcements().filter("ingest_seq in (12, 13)").collect()) == ["-", "-"]
    assert view.announcements().filter("ingest_seq = 12").first().source == ""
    found = view.announcements("a", "2024-01-01", "2024-01-31")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(by_source" in text.replace("\n", " ")
    assert seqs(found) == [0, 6, 20]
    laid = [p for p in found.inputFiles() if "/compact/" in p]
    assert laid and seqs(view.announcements(start="2024-03-01")) == [2, 5, 8, 11]
    assert {r.url for r in view.urls().collect()} == {f"u{i}" for i in [*range(14), 20]}
    known = view.known_urls(spark.createDataFrame([("u3",), ("u20",), ("z",)], "url string"))
    assert {"u3", "u20"} <= {r.url for r in known.collect()}
    assert state.compact() == 4 and seqs(state.announcements()) == [*range(14), 20]


def test_a_batch_that_commits_during_a_compaction_is_read(spark, tmp_path):
    state = State(spark, str(tmp_path))
    add(state, laid_rows(spark, [(0, "a", "2024-01-01")]))
    late = state.claim()
    state.stage("announcements", late, laid_rows(spark, [(1, "a", "2024-01-01")]))
    state.compact()
    state.commit(late)
    assert seqs(state.announcements()) == [0, 1]
    state.compact()
    assert seqs(state.announcements()) == [0, 1]


def test_statistics_and_cards_survive_a_compaction(filled):
    before = filled.view()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = [rows(before.all_statistics()), rows(before.mentions()), rows(before.cards()), rows(before.announcements())]
    filled.compact()
    after = filled.view()
    assert [rows(after.all_statistics()), rows(after.mentions()), rows(after.cards()), rows(after.announcements())] == want


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    state, conf = State(spark, str(tmp_path)), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(conf, "64KB")
    try:
        rows = spark.range(200_000).select(F.xxhash64("id").cast("string").alias("key"), F.col("id").alias("count"),
                                           F.lit("card").alias("kind"))
        state.stage("statistics", 0, rows, "kind")
    finally:
        spark.conf.unset(conf)
    assert len(list((tmp_path / "statistics" / "batch=0" / "kind=card").glob("*.parquet"))) > 1
    assert spark.read.parquet(f"{tmp_path}/statistics/batch=0").count() == 200_000
