import bisect
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noticeflow.llm import packing
from noticeflow.llm.storage import saved

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def one_by_one(sizes, capacity):
    """Best-fit decreasing, one item at a time over a sorted list of rooms."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - s)
    return sorted(rooms)


def rooms_of(histogram, capacity):
    used, filled = {}, {}
    for size in histogram:
        mine = sorted(r for r in packing.best_fit(histogram, capacity) if r[0] == size)
        ends = [r[1] for r in mine[1:]] + [histogram[size]]
        for (_, rank, k, first, offset), end in zip(mine, ends):
            for t in range(end - rank):
                used.setdefault(first + t // k, []).append((offset + t % k * size, size))
    for b, parts in used.items():
        parts.sort()
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]]
        filled[b] = capacity - sum(p[1] for p in parts)
    return sorted(filled.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=300))
def test_groups_equal_item_by_item_best_fit(sizes):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    assert rooms_of(histogram, 40) == one_by_one(sizes, 40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab, .\n\t'sé1ß漢 　")), max_size=30), max_size=6))
def test_ids_equal_the_tokenizer_file(texts):
    got = packing.tokenizer(None).encode_batch(texts)
    assert [g.tolist() for g in got] == [
        TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack(spark):
    rng = random.Random(5)
    words = ["alpha", "beta,", "it's", "naïve", "42\n", "漢字"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300, 1500]))) for _ in range(60)]
    texts += [None, "", "a  b", "ends ", " starts", "x <|endoftext|> y", "w " * 1023, "word " * 2047 + "word"]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(0, texts[0], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, length long")
    parts = saved(packing.pieces(docs, keep_ids=True), "test")
    packed = packing.pack(parts).collect()
    whole = {i: reference_ids(t) for i, t in enumerate(texts)}
    assert len(packed) == sum(-(-len(whole[i]) // 1024) for i in [*range(len(texts)), 0])
    by = {}
    for r in packed:
        ids = whole[r["doc_id"]]
        assert list(r["ids"]) == ids[r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 1024
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = [r["length"] for r in packed]
    assert len(by) == len(one_by_one(sizes, 1024))
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack(parts)).collect()}
    assert all(list(r["ids"]) == joined[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
               for r in packing.pack(parts).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).collect() == []


def test_the_tokenizer_file_is_loaded_only_for_texts_with_the_special_token():
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json").rsplit("/", 1)[0])
    texts = ["plain words here", " spaced  text ", ""]
    assert [ids.tolist() for ids in bpe.encode_batch(texts)] == [reference_ids(t)[:-1] for t in texts]
    assert "full" not in vars(bpe)
    special = "a <|endoftext|> b"
    assert [ids.tolist() for ids in bpe.encode_batch([special])] == [reference_ids(special)[:-1]]
    assert "full" in vars(bpe)
