import random

import numpy as np
import pyarrow as pa

from noticeflow.llm import toxicity
from noticeflow.llm.arrays import text_buffers


def corpus(n=400):
    rng = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("ra", "lo", "né")]
    sentence = lambda: " ".join(rng.choices(vocab, k=8))
    docs = []
    for i in range(n):
        parts = [sentence() for _ in range(rng.randint(2, 12))]
        bad = i % 4 == 0
        if bad:
            parts[rng.randrange(len(parts))] += rng.choice([" vileword", " zorkling thing", " zorkish"])
        docs.append((i, ". ".join(parts) + ".", int(bad)))
    return docs


def test_learns_from_document_labels_and_points_at_sentences(spark):
    docs = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(0, 0), (None, 1), (7, None)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(table, labels.where("coalesce(doc_id, 0) % 5 != 0"))
    got = toxicity.score(table, model, sentences="where").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["doc_id"] % 5 == 0]
    truth = {i: y for i, _, y in docs}
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held) >= 0.95 * len(held)
    for r in got:
        if truth[r["doc_id"]] and r["score"] > 0.9 and r["where"]:
            worst = max(r["where"], key=lambda s: s["score"])
            assert any(w in r["text"][worst["start"]:worst["stop"]] for w in ("vileword", "zork"))
    twice = toxicity.score(table, model).select("doc_id", "score").collect()
    assert {tuple(r) for r in twice} == {(r["doc_id"], r["score"]) for r in got}


def test_score_is_the_noisy_or():
    model = toxicity.NoisyOr(bias=-1.0)
    rng = np.random.default_rng(1)
    model.weights = rng.normal(0, 0.3, toxicity.BUCKETS).astype(np.float32)
    texts = ["One two. Three four! five", "", "...", "été noir", None]
    scores, (row, _, _, p) = model.score(*text_buffers(pa.array(texts, pa.string())))
    for i in range(len(texts)):
        assert np.isclose(scores[i], 1 - np.prod(1 - p[row == i]))
    assert scores[1] == scores[2] == scores[4] == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.where("false"), model).collect() == []
