import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm import neardup


def multiset(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def brute_classes(texts):
    owner = list(range(len(texts)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    sets = [multiset(t) if t is not None else None for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            if texts[i] == texts[j] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    return [root(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["été", "漢字", "B2"]
    fresh = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [fresh(rng.choice([1, 3, 4, 5, 9, 60, 200])) for _ in range(40)]
    base = fresh(150)
    for k in range(60):  # a family of edits of many sizes
        w = base.split()
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        texts.append(" ".join(w))
    texts += [base.upper() + "!", base, base, "la " * 500, "la " * 505, "la " * 900]
    texts += [None, None, "", "", "!!!", "... --", "one two", "one two.", "One, two"]
    return texts


def test_overlap_equals_counters():
    texts = [t or "" for t in corpus()]
    a, b = texts[:-1], texts[1:]
    got = neardup.overlap(pa.array(a), pa.array(b), 5)
    want = [jaccard(multiset(x), multiset(y)) for x, y in zip(a, b)]
    assert np.allclose(got, want)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = {i: int(rng.integers(1, 12)) for i in range(50)}
    b = {i: max(1, int(w + rng.integers(-4, 5))) for i, w in a.items() if i % 4} | {99: 7}
    true = (sum(min(a.get(i, 0), b.get(i, 0)) for i in {*a, *b})
            / sum(max(a.get(i, 0), b.get(i, 0)) for i in {*a, *b}))

    def sign(items, seed):
        h = neardup.mixed(np.array([*items], np.uint64) + np.uint64(1000 * seed))
        return neardup.signatures(np.zeros(len(h), int), h, np.array([*items.values()]), 1, 64)

    agree = [(sign(a, s) == sign(b, s)).mean() for s in range(150)]
    assert abs(np.mean(agree) - true) < 4 * np.std(agree) / np.sqrt(len(agree))


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    rows = np.repeat([0, 1], 300)
    hashes = neardup.mixed(rng.integers(0, 350, 600).astype(np.uint64))
    key = np.unique(np.stack([rows.astype(np.uint64), hashes]), axis=1, return_counts=True)
    (r, h), c = key
    p = neardup.parities(r.astype(int), h, c, 2)
    sets = [Counter(dict(zip(h[r == i].tolist(), c[r == i].tolist()))) for i in (0, 1)]
    difference = sum(((sets[0] - sets[1]) + (sets[1] - sets[0])).values())
    assert sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64)) <= difference


def test_classes_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "n", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, label string, n long")
    got = neardup.classes(docs).collect()
    assert len(got) == len(texts) + 2
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(brute_classes(texts)))
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts)))


def test_no_pair_of_a_band_is_turned_away(spark):
    texts = []
    # Similar at 0.8 and in one band, although over 40 registers of 160 look unlike.
    for i in (1007, 2560, 6168, 7908, 8616, 14773, 22184):
        words = [f"s{i}w{k}" for k in range(13)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - i % 2 for i in range(len(texts))}


def test_pairs_of_a_large_family_grow_with_its_texts(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"f{i}" for i in range(120)]
    texts = []
    for k in range(600):  # edits next to each other, so that five-word runs stay alike at 0.8 or little less
        w, at = base[:], rng.randrange(110)
        w[at:at + k % 5] = [f"e{rng.randrange(9_000)}" for _ in range(k % 5)]
        texts.append(" ".join(w))
    seen = []
    plain = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == dict(enumerate(brute_classes(texts)))
    assert sum(seen) < 6 * len(texts)


def test_nodes_left_apart_are_paired_once_in_however_many_buckets_they_meet(spark):
    label = {i: 0 if i < 20 else i for i in range(23)}
    rows = [(i, key, label[i]) for i in range(23) for key in range(8)] + [(0, 9, 0), (22, 9, 22), (1, 10, 0)]
    rest = spark.createDataFrame(rows, "node long, key long, label long")
    side = [F.col(c).alias(f"{c}_b") for c in ("node", "label")]
    got = [tuple(sorted(r)) for r in neardup.apart_pairs(rest, side, F.lit(True)).select("node", "node_b").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for b in range(23) for a in range(b) if label[a] != label[b]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(docs).collect() == [] and neardup.deduplicated(docs).collect() == []
