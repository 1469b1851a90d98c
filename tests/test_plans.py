"""What the physical plans must and must not contain."""

import re

import pytest
from conftest import SF, plan_of

import __spark_entry__ as entry

PYTHON = {"page_blocks", "page_titles", "page_details", "page_links", "page_contacts", "titled_links", "refusal_pages",
          "result_items", "notice_meta", "table_cells", "table_profile", "table_fields", "notice_sections",
          "table_contacts", "text_contacts", "notice_contacts", "notice_text", "flat_notices", "notice_candidates",
          "notice_winners", "listed_notices"}
EAGER = {"ingest", "ingest_counters", "ingest_stream", "stream_dedupe", "export_by_province", "export_by_day",
         "dedupe_title_or_url", "notice_cards", "ingest_mixed", "stream_dedupe_late", "export_all",
         "export_all_contacts", "export_all_summary", "batch_statistics"}


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - EAGER))
def test_plan_shape(spark, name):
    text = plan_of(entry.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert ("MapInArrow" in text) == (name in PYTHON)
    assert text.count("MapInArrow") <= 1


def test_list_does_not_read_content(spark):
    from noticeflow.operators import notices
    from workload.roles import texts
    listed = notices.page(texts(spark, SF).drop("title").withColumnRenamed("source", "publish_date"))
    assert "text" not in plan_of(listed).split("ReadSchema")[1]
    counted = plan_of(notices.count_by_source(texts(spark, SF)))
    assert "ReadSchema: struct<source:string>" in counted


def test_search_text_reaches_the_scan(spark):
    from noticeflow.operators import notices
    from workload.roles import table
    a = table(spark, SF, "documents").selectExpr("text AS title", "source AS content")
    assert "StringContains(text,招标)" in plan_of(notices.search(a, q="招标"))


def test_range_filter_reaches_the_scan(spark):
    from noticeflow.operators import notices
    from workload.roles import table
    a = table(spark, SF, "documents").filter(notices.date_between("a", "b", "source"))
    assert "GreaterThanOrEqual(source,a)" in plan_of(a)


def test_page_keeps_mentions_of_other_cards_unshuffled(spark):
    text = plan_of(entry.queries()["card_list"](spark, SF))
    scan = text.index("l_suppkey")
    assert "BroadcastHashJoin [business_card_id" in text[:scan]


def test_distinct_counts_are_spread_over_announcements(spark):
    text = plan_of(entry.queries()["top_companies"](spark, SF))
    assert re.search(r"hashpartitioning\(company_key#\d+L, announcement_id#\d+L", text)
    # No names are shuffled with the mentions.
    assert "hashpartitioning(company#" in text and not re.search(r"hashpartitioning\(company#\d+, ann", text)


def test_counts_of_some_cards_read_their_mentions_only(spark):
    for name in ("cards_by_company", "cards_by_company_like"):
        text = plan_of(entry.queries()[name](spark, SF))
        assert text.count("l_suppkey") and "LeftSemi" in text
        # The semi join stands below the count of mentions.
        assert text.index("HashAggregate(keys=[business_card_id") < text.index("LeftSemi")
