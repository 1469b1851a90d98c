import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import cards, contacts
from noticeflow.schema import CARDS, MENTIONS

T1, T2, T3 = (datetime(2024, 1, d) for d in (1, 2, 3))
CANDIDATE = "company string, contact_name string, phones array<string>, emails array<string>, seen_at timestamp"


def card(i, company, name, phones=(), emails=(), created=T1, updated=T1):
    return (i, company, name, list(phones), list(emails), created, updated)


@pytest.fixture(scope="module")
def data(spark):
    c = spark.createDataFrame([
        card(1, "甲公司", "李雷", ["1"], ["a@b.cn"], T1, T2), card(2, "甲公司", "李雷", ["2", "1"], [], T2, T3),
        card(3, "甲公司", "王五", [], [], T1, T2), card(4, "详见公告正文", "赵六"), card(5, "AB", "孙"),
        card(6, "乙公司", "周 a%b", ["9"], [], T1, T2), card(7, "None", "x", [], [], T1, None)], CARDS)
    m = spark.createDataFrame([(1, 10, "buyer"), (1, 10, "agent"), (2, 10, "agent"), (2, 11, "agent"),
                               (3, 11, "buyer"), (4, 10, "buyer"), (5, 10, "buyer"), (6, 12, "agent")], MENTIONS)
    a = spark.createDataFrame([(10, "北京中标", "x", "u1", "s", "2024-1-5"), (11, "成交", "在北京", "u2", "s", "2024-01-31"),
                               (12, "上海", "y", "u3", "s", None)],
                              "id long, title string, content string, url string, source string, publish_date string")
    return c, m, a


def test_top_companies(data):
    c, m, _ = data
    assert [tuple(r) for r in cards.top_companies(c, m).collect()] == [("甲公司", 2), ("乙公司", 1)]


def test_role_distribution(data):
    assert {(r.role, r["count"]) for r in cards.role_distribution(data[1]).collect()} == {("buyer", 4), ("agent", 4)}


def listed(df):
    return [(r.id, r.company, r.contact_name, r.phones, r.projects_count) for r in df.collect()]


def test_card_list_joins_duplicates(data):
    c, m, a = data
    assert listed(cards.card_list(c, m))[:3] == [
        (2, "甲公司", "李雷", "1, 2", 2), (6, "乙公司", "周 a%b", "9", 1), (3, "甲公司", "王五", "", 1)]
    assert len(listed(cards.card_list(c, m))) == 6
    assert [r[0] for r in listed(cards.card_list(c, m, limit=2, offset=1))] == [6, 3]


def test_card_list_counts_only_what_passes(data):
    c, m, a = data
    assert listed(cards.card_list(c, m, role="buyer", q="甲")) == [
        (1, "甲公司", "李雷", "1, 2", 1), (3, "甲公司", "王五", "", 1)]
    assert [(r[0], r[4]) for r in listed(cards.card_list(c, m, a, province="北京", q="甲"))] == [(2, 2), (3, 1)]
    assert listed(cards.card_list(c, m, a, province="上海", role="buyer")) == []


@pytest.mark.parametrize("args, n", [({}, 6), ({"q": "甲"}, 2), ({"role": "agent"}, 2), ({"province": "北京"}, 4),
                                     ({"q": "A_B"}, 0), ({"q": "a_b"}, 1), ({"q": "%"}, 6)])
def test_group_count_agrees_with_list(data, args, n):
    c, m, a = data
    if args == {"q": "A_B"}:
        n = 1                                  # letters match in either case
    assert cards.card_group_count(c, m, a, **args).first().total == n
    assert len(listed(cards.card_list(c, m, a, **args))) == n


def test_large_page_is_checkpointed(data):
    c, m, _ = data
    assert len(listed(cards.card_list(c, m, limit=5000))) == 6


def test_cards_of_company(data):
    c, m, _ = data
    got = [(r.id, r.projects_count) for r in cards.cards_of_company(c, m, "甲公司").collect()]
    assert got == [(2, 2), (1, 1), (3, 1)]
    assert cards.cards_of_company(c, m, "  ").count() == 0
    assert {r.id for r in cards.cards_of_company(c, m, "none", like=True).collect()} == {7}
    assert {r.id for r in cards.cards_of_company(c, m, "none").collect()} == set()


def test_history(data):
    c, m, a = data
    assert [(r.id, r.role) for r in cards.card_history(c, m, a, 1).collect()] == [
        (10, "agent"), (10, "agent"), (10, "buyer"), (11, "agent")]      # dates compare as text
    assert [(r.id, r.role) for r in cards.mentions_of_card(m, a, 2).collect()] == [(10, "agent"), (11, "agent")]
    assert cards.card_history(c, m, a, 99).count() == 0


def test_exported_cards(data):
    c, m, _ = data
    got = [(r.company, r.contact_name, r.phones, r.projects_count) for r in cards.exported_cards(c, m, "公司").collect()]
    assert got == [("乙公司", "周 a%b", "9", 1), ("甲公司", "李雷", "1", 1), ("甲公司", "李雷", "2, 1", 2), ("甲公司", "王五", "", 1)]


def merged(df):
    return {(r.company, r.contact_name): (r.phones, r.emails, r.created_at, r.updated_at) for r in df.collect()}


def test_merge_cards(spark):
    old = spark.createDataFrame([card(1, "甲", "李", ["2"], ["a@b"], T1, T1), card(2, "乙", "王", [], [], T1, T2)], CARDS)
    new = spark.createDataFrame([("甲 ", "李", ["1 ", "", "2"], [" A@B "], T3), ("丙", "赵", None, [], T3),
                                 ("丁", " ", ["1"], [], T3), (None, "x", [], [], T3)], CANDIDATE)
    got = cards.merge_cards(old, new)
    assert merged(got) == {("甲", "李"): (["1", "2"], ["a@b"], T1, T3), ("乙", "王"): ([], [], T1, T2),
                           ("丙", "赵"): ([], [], T3, T3)}
    assert got.schema.fieldNames() == CARDS.fieldNames()
    ids = got.select("id", cards.card_id(F.col("company"), F.col("contact_name")).alias("k")).collect()
    assert all(r.id == r.k for r in ids)


def test_merge_does_not_depend_on_batches(spark):
    rng = random.Random(5)
    rows = [(rng.choice("甲乙丙"), rng.choice("李王"), [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 3))],
             [f"{rng.choice('xyz')}@m"] * rng.randint(0, 1), T1) for _ in range(60)]
    empty = spark.createDataFrame([], CARDS)

    def run(*batches):
        state = empty
        for b in batches:
            state = cards.merge_cards(state, spark.createDataFrame(b, CANDIDATE))
        return merged(state)

    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert run(rows) == run(shuffled[:20], shuffled[20:45], shuffled[45:], rows[:5])


def test_new_mentions(spark):
    old = spark.createDataFrame([(1, 1, "buyer")], MENTIONS)
    new = spark.createDataFrame([(1, 1, " buyer"), (1, 1, None), (1, 1, ""), (None, 1, "x"), (2, None, "x"),
                                 (2, 1, "agent"), (2, 1, "agent")], MENTIONS)
    got = sorted(tuple(r) for r in cards.new_mentions(old, new).collect())
    assert got == [(1, 1, ""), (2, 1, "agent")]


def test_contact_rows(spark):
    df = spark.createDataFrame([(1, "甲", ["李", "王"], ["1", "2"], []), (2, None, [], [], ["a@b"]), (3, "乙", ["赵"], [], [])],
                               "announcement_id long, company string, contacts array<string>, phones array<string>,"
                               "emails array<string>")
    assert sorted(tuple(r) for r in contacts.contact_rows(df).collect()) == [
        (1, "甲", "李", "1", ""), (1, "甲", "李", "2", ""), (1, "甲", "王", "1", ""), (1, "甲", "王", "2", ""),
        (2, "", "", "", "a@b")]
