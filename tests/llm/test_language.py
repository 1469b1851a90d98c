import math
import random

import numpy as np
import pyarrow as pa

from noticeflow.llm import language

SOUNDS = {"aa": ["ba", "lo", "ri", "né"], "bb": ["sch", "ung", "keit", "ü"], "cc": ["ción", "que", "ñe", "mos"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_main_language_and_mixture(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(SOUNDS) * 30)]
    extra = [(500, None, "aa"), (501, "", "bb"), (502, "123 !! 45", "cc"), (503, "— … —", None),
             (504, text(rng, "aa", 200) + " " + text(rng, "bb", 60), None), (505, text(rng, "cc", 20_000), None),
             (506, "né", None), (0, rows[0][1], "aa")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 3 != 1 or doc_id >= 500"))
    assert model.languages == ["aa", "bb", "cc"]
    got = language.identify(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang and 0.9 < by[i]["score"] <= 1 for i, _, lang in rows)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502, 503))
    assert by[504]["lang_pred"] == "aa" and set(by[504]["mixture"]) == {"aa", "bb"}
    assert 0.6 < by[504]["score"] < 0.95
    assert by[505]["lang_pred"] == "cc" and by[506]["lang_pred"] == "aa"


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    model = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert language.identify(docs, model).first()["lang_pred"] == "und"
    assert language.identify(docs.where("false"), model).collect() == []


def test_more_languages_than_are_counted_at_once(spark):
    """A hundred languages are all learned, and documents in each are named by it."""
    rng = random.Random(8)
    sounds = {f"l{i:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 4))) for _ in range(6)] for i in range(100)}

    def write(lang, n):
        return " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 3))) for _ in range(n))

    rows = [(i * 100 + j, write(lang, 60), lang) for i in range(3) for j, lang in enumerate(sounds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted(sounds)
    new = [(j, write(lang, 40), lang) for j, lang in enumerate(sounds)]
    got = language.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 98


def plain_mixture(like, rounds):
    """Expectation-maximisation with loops, over one text's segments."""
    k = len(like[0])
    share = [1.0 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for seg in like:
            top = max(seg)
            joint = [math.exp(x - top) * s for x, s in zip(seg, share)]
            for i, x in enumerate(joint):
                new[i] += x / sum(joint) / len(like)
        share = new
    return share


def test_shares_equal_a_plain_mixture(spark):
    """Where no language can be left out, the shares are those of plain rounds over all of them."""
    rng = random.Random(6)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(SOUNDS) * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for parts in (("aa", "bb", "cc"), ("cc", "aa", "bb")):
        raw, offs = language.text_buffers(pa.array([" ".join(text(rng, p, 150) for p in parts)]))
        like, _ = model.segments(raw, offs)
        want = plain_mixture(like.tolist(), language.ROUNDS)
        assert np.abs(model.shares(raw, offs)[0] - want).max() < 1e-3
