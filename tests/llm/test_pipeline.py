"""The pipeline over a small table against plain versions of its stages."""

import re

import corpus_pipeline
import public_tokenizers
from test_decontamination import brute, words
from test_neardup import jaccard, multiset
from tokenizers import Tokenizer

from noticeflow.llm import secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] < 0.5}
    sets, owner = {i: multiset(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if texts[i] == texts[j] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i in ids:
        if root(i) != i:
            continue
        n, hit, _ = brute(texts[i], items, 10)
        if n and len(hit) > 0.5 * n:
            continue
        text, w = texts[i], words(texts[i])
        for k in reversed(hit):  # a run of hit words goes with what stands between them
            end = w[k + 1][1] if k + 1 in set(hit) else w[k][2]
            text = text[:w[k][1]] + text[end:]
        text = re.sub(secrets.ASSIGN, lambda m: m[0][:m.start(2) - m.start()] + secrets.PLACEHOLDER
                      if len(m[2]) >= 6 else m[0], text)
        want[i] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
