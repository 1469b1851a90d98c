import random

import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.sql import functions as F, types as T

from noticeflow.operators import contained, grams, notices
from noticeflow.operators.text_index import TextIndex

PICK = random.Random(7)
WORDS = ["招标公告", "采购", "智能", "机房", "中标", "Alpha", "beta_x", "100%", "Straße", "İzmir", "ab"]


def drawn(n):
    return [(i, " ".join(PICK.choices(WORDS, k=2)) if i % 7 else None,
             " ".join(PICK.choices(WORDS, k=PICK.randint(0, 12))) + f" no{i}" if i % 11 else "") for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(drawn(600), "id long, title string, content string")
    built = TextIndex(spark, str(tmp_path_factory.mktemp("index")), ("title", "content"), blocks=24, buckets=4)
    built.add(rows.filter("id < 300"), 0)
    built.add(rows.filter("id >= 300"), 1)
    built.add(rows.filter("id >= 300"), 1)  # again
    return built, rows


@pytest.mark.parametrize("q", ["", "智能", "招标公告", "alpha 智", "no599", "NO59", "beta_x", "a%x", "_", "0%", "straße", "ß", "i̇zmir", "zzzz", "no", "\\"])
def test_search_equals_scan(index, q):
    built, rows = index
    want = sorted(r.id for r in notices.search(rows, q=q).collect())
    assert sorted(r.id for r in built.search(q).collect()) == want


def test_a_search_reads_few_blocks_and_postings(index):
    built, rows = index
    found = built.candidates("no599")
    assert [r.id for r in found.collect()] == [599]
    assert found.select("block").distinct().count() <= 2  # of 24
    plan = plan_of(built.search("no599"))
    assert "dynamicpruning" in plan.lower() and "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "")
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan
    assert built.rarest("no599 zq") == [] and built.rarest("no") is None


def keyword_table(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "at long, keyword string")


def test_keyword_table_equals_contains(spark, index):
    _, rows = index
    words = ["智能", "招", "no59", "no5", "Alpha beta", "absent", "ab", "a", "100%", "", "no599 no599", "机房 智能"]
    got = {(r.id, r.at, r.is_first) for r in notices.keyword_table_hits(rows, keyword_table(spark, words), all_hits=True).collect()}
    want = set()
    for i, title, content in ((r.id, r.title, r.content) for r in rows.collect()):
        text = "\n".join(x for x in (title, content) if x is not None)
        hits = [k for k, w in enumerate(words) if w and w in text]
        want |= {(i, k, k == hits[0]) for k in hits}
    assert got == want
    assert notices.keyword_table_hits(rows, keyword_table(spark, ["x"]).filter("false")).collect() == []
    assert notices.keyword_table_hits(rows.filter("false"), keyword_table(spark, ["智能"])).collect() == []


def test_keyword_candidates_follow_hits(spark):
    """Keywords that share their first characters with every text meet only the texts that hold them."""
    docs = spark.createDataFrame([(i, f"公开招标 项目{i:04} 公开招标采购") for i in range(400)], "id long, text string")
    words = keyword_table(spark, [f"公开招标 项目{i:04}" for i in range(0, 400, 4)])
    met = notices.keyword_candidates(docs, words, "id", "text")
    assert 100 <= met.count() <= 300


def test_grams_are_linear_and_whole():
    text = "ab" * 5 + "é漢😀" * 3
    assert len(grams.gram_numbers(text, 3)) == len({text[i:i + 3] for i in range(len(text) - 2)})
    assert grams.gram_numbers("ab", 3) == [] == grams.gram_numbers("", 3)


def test_grams_across_chunks(monkeypatch):
    text = "".join(PICK.choices("abcdefgh", k=500))
    whole = grams.gram_numbers(text, 6)
    monkeypatch.setattr(grams, "CHUNK", 64)
    assert grams.gram_numbers(text, 6) == whole


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_keyword_counts_equal_hits_and_send_no_text(spark, index, block_bytes):
    _, rows = index
    words = keyword_table(spark, ["智能", "招", "no59", "Alpha beta", "absent", "ab", "a", "100%", "", "no599 no599", "机房 智能"])
    got = notices.keyword_table_counts(rows, words, block_bytes=block_bytes)
    hits = notices.keyword_table_hits(rows, words, all_hits=True).collect()
    want = {(r.id, r.at, r.keyword, sum(h.id == r.id for h in hits)) for r in hits if r.is_first}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 300
    if block_bytes == 1 << 20:
        assert "Exchange" not in plan_of(got) and "Join" not in plan_of(got)
    assert notices.keyword_table_counts(rows, words.filter("false")).collect() == []


def test_keyword_counts_on_random_texts(spark, monkeypatch):
    """Keywords that begin alike, hold white space, are longer than eight bytes or stand at the edge of a word."""
    monkeypatch.setattr(contained, "CHUNK", 64)
    monkeypatch.setattr(contained, "TEXT_BYTES", 300)
    monkeypatch.setattr(contained, "PAIRS", 50)
    rng = random.Random(11)
    parts = ["a", "b", "ab", "abcdefgh", "é", "招标", " ", "\n", "\x1f", "\x85", "　", "\t", "\x00", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 5, 30, 120]))) for _ in range(150)] + [None, "abcdefgh" * 40]
    words = list(dict.fromkeys(["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(300)] + ["abcdefgh" * n for n in (2, 3, 30, 41)]))
    words += words[:3]  # the same keyword at two places counts twice
    names = [chr(65 + i % 26) + str(i) for i in range(len(words))]
    table = pa.table({"at": names, "keyword": words}).sort_by("at")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = contained.first_and_count(rows, "id", "text", table, T.StringType()).collect()
    want = set()
    for i, t in enumerate(texts):
        hits = sorted((n, w) for n, w in zip(names, words) if w in (t or ""))
        want |= {(i, *hits[0], len(hits))} if hits else set()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    here = [t or "" for t in texts]  # CHUNK and PAIRS hold in this process
    for wanted, found in (([w for w in words if min(w.encode()) > 32], lambda t, s: contained._within_words(t, s)),
                          (words, lambda t, s: [s.inside(t.cast(pa.binary()))])):
        parts = list(found(pa.array(here), contained.Strings([w.encode() for w in wanted])))
        pairs = [(i, k) for text, string in parts for i, k in zip(text.tolist(), string.tolist())]
        assert set(pairs) == {(i, k) for i, t in enumerate(here) for k, w in enumerate(wanted) if w in t}
        assert len(parts) > 5 or wanted is words


def test_a_word_is_searched_once_for_all_texts(monkeypatch):
    """Texts of the same words cost no more comparisons than one of them."""
    seen, plain = [], contained.Strings.inside
    monkeypatch.setattr(contained.Strings, "inside", lambda self, texts: seen.append(len(texts)) or plain(self, texts))
    strings = contained.Strings([b"tion", b"er"])
    parts = list(contained._within_words(pa.array(["station erste"] * 500), strings))
    assert seen == [2]
    assert sum(len(t) for t, _ in parts) == 1000


def test_keyword_blocks_hold_neighbouring_lengths():
    assert notices.keyword_blocks([], 100) == [(0, 0, 1)]
    assert notices.keyword_blocks([(3, 40), (4, 50), (5, 60), (9, 250), (12, 10)], 100) == [(0, 4, 1), (5, 5, 1), (9, 9, 3), (12, 12, 1)]
