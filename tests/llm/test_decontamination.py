import hashlib
import random
import re

import pytest

from noticeflow.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    t = (text or "").translate(str.maketrans(dc.UPPER, dc.LOW))
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(t)]


def brute(text, items, window):
    w = [x[0] for x in words(text)]
    hit, found = set(), set()
    for item, t in items:
        ws = [x[0] for x in words(t)]
        n = min(window, len(ws))
        if not n:
            continue
        wins = {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in wins:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def case():
    rng = random.Random(3)
    vocab = ["a", "B", "c9", "dé", "漢字", "e", "f"]
    gen = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, gen(rng.choice([0, 2, 3, 4, 6, 12, 30]))) for i in range(14)]
    items += [(None, gen(5)), (50, None), (51, items[5][1]), (52, items[6][1])]
    texts = [gen(rng.choice([0, 1, 5, 40, 200])) for _ in range(30)]
    texts += [f"x y {items[-1][1]} zz {gen(4)}", None, "", gen(3000), "q w r t"]
    return items, [(i, t, "keep", i) for i, t in enumerate(texts)] + [(0, texts[0], "keep", 0)]


@pytest.mark.parametrize("window,block", [(4, 100_000), (4, 40), (6, 100_000)])
def test_equals_brute_force(spark, window, block):
    items, rows = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string, overlap string, n_hit long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.overlaps(docs, bench, window, block_words=block).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        o, (n, hit, found) = r["overlap"], brute(texts[r["doc_id"]], items, window)
        assert (o["n_words"], o["hit_words"], o["items"]) == (n, hit, found)
        assert o["n_hit"] == len(hit) and (o["longest"] >= 1) == bool(hit)
        w, inside = words(texts[r["doc_id"]]), []
        for s in o["spans"]:
            inside += [k for k, x in enumerate(w) if s["start"] <= x[1] and x[2] <= s["stop"]]
        assert inside == hit
    d = dc.digest(dc.overlaps(docs, bench, window, block_words=block)).collect()
    for r in d:
        found = brute(texts[r["doc_id"]], items, window)[2]
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "nothing of that kind is in here at all, " * 4
    rows = [(1, f"{clean}ONE two, three four five six seven eight nine ten. {clean}", "a"),
            (2, item, "b"), (3, clean, "c"), (4, None, "d"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in dc.remove_overlaps(docs, bench).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1]["text"] == clean + ". " + clean and out[3]["text"] == clean and out[4]["text"] is None
    assert out[1]["lang"] == "a"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.overlaps(docs, none).first()["overlap"]["n_words"] == 2
    assert dc.overlaps(docs.where("false"), docs.toDF("item_id", "text")).collect() == []
