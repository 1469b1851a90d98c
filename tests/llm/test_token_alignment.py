import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from noticeflow.llm import token_alignment

RANDOM = random.Random(5)
ODD = ["", " ", "a b", "A", "  two  spaces ", "tab\there", "\nline\n\nbreaks \n x", "né 漢字 \U0001F600\U0001F9D1‍\U0001F680 x", "<|endoftext|> <s> </s> <0x41>",
       "▁under one", "nbsp\xa0and　wide  ", "zero​width ﻿ bom", "\x00 \x1c\x1d control", "é combining ́ mark",
       "don't we'll 12345 3.14 ---- ////", "x" * 3000, "漢" * 2000, "\r\n", "a ᠎ b", None, "क्षि ப ഔ ༄ ⴰ"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def sides(tokenizers, text):
    """Ids and bytes of each token of the whole text, or nothing."""
    a, b = tokenizers
    alphabet = token_alignment.byte_alphabet()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids]
    right = []
    for i in b.encode(text, num_threads=1):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    same = b"".join(x for _, x in left) == want == b"".join(x for _, x in right)
    return (left, right) if text and same else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(tokenizers, texts):
    rows, docs = [], Counter()
    for text in texts:
        left, right = map(spans, sides(tokenizers, text or ""))
        ends = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        groups = [",".join(str(i) for s, e, i in left if p <= s and e <= q) + "|"
                  + ",".join(str(i) for s, e, i in right if p <= s and e <= q) for p, q in zip([0, *ends], ends)]
        links = [(i, j) for s, e, i in left for t, f, j in right if s < f and t < e]
        docs.update(set(links))
        rows.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    top = {}
    for (i, _), n in docs.items():
        top[i] = max(top.get(i, 0), n)
    return [(a, b, g, len(links), sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links), sha)
            for a, b, g, links, sha in rows], docs, top


def test_words_may_be_aligned_alone(tokenizers):
    """Joined words give the ids of the whole text, whatever stands between them."""
    pair = token_alignment.tokenizer_pair(None)
    parts = [t for t in ODD if t] + ["word", "Again,", "3rd", "the", "\n", "\t", " ", "  "]
    for _ in range(150):
        text = "".join(RANDOM.choice(parts[:15] + parts[17:]) + RANDOM.choice(["", " ", " ", "  ", "\n"]) for _ in range(6))
        lexicon = token_alignment.Lexicon(pair)
        codes = [lexicon.numbers[w] for w in token_alignment.words_of(text)]
        lexicon.learn()
        counts, _, _ = lexicon.arrays()
        left, right = sides(tokenizers, text)
        whole = pair.align([text])[0]
        if not left:
            assert whole is None and (counts[codes, 0] < 0).any()
            continue
        assert whole.a.tolist() == [i for i, _ in left] and whole.b.tolist() == [i for i, _ in right]
        assert whole.a_ends.tolist() == [e for _, e, _ in spans(left)]
        assert whole.b_ends.tolist() == [e for _, e, _ in spans(right)]
        assert ";".join(lexicon.groups[c] for c in codes) == "".join(pair.pieces(whole))[:-1]


def test_documents_and_pairs_equal_brute_force(spark, tokenizers, monkeypatch):
    texts = ODD + ["the cat sat on the mat", "the cat, the cat", "le chat ñandú", "the cat sat on the mat"] * 2
    want, docs, top = brute(tokenizers, texts)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    found = token_alignment.align(df)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
           for r in found.documents.collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in found.pairs.collect()}
    assert pairs == {x: (n, n == top[x[0]]) for x, n in docs.items()}


def test_small_slices_and_repeated_rows(spark, tokenizers):
    """Two rows to an Arrow batch, null and repeated ids, a text of many words."""
    texts = ["a b c", None, "a b c", "b c d " * 5_000, "", "née " * 50]
    want, _, _ = brute(tokenizers, [t if len(t or "") < 1_000 else "b c d" for t in texts])
    df = spark.createDataFrame([(None if i == 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = token_alignment.align(df).documents.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    assert len(rows) == 6 and sorted(r["doc_id"] or 0 for r in rows) == [0, 7, 7, 7, 7, 7]
    small = [r for r in rows if r["n_a"] < 1_000]
    assert sorted(r["n_links"] for r in small) == sorted(w[3] for i, w in enumerate(want) if i != 3)
    assert token_alignment.align(df.where("false")).documents.collect() == []


def test_groups_hold_the_same_bytes(spark, tokenizers):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, groups string")
    for r in token_alignment.token_groups(df).collect():
        left, right = sides(tokenizers, r["text"] or "")
        assert [i for g in r["groups"] for i in g["a"]] == [i for i, _ in left]
        assert [i for g in r["groups"] for i in g["b"]] == [i for i, _ in right]
        a, b = iter(left), iter(right)
        for g in r["groups"]:
            assert sum(len(next(a)[1]) for _ in g["a"]) == sum(len(next(b)[1]) for _ in g["b"]) == g["stop"] - g["start"]
