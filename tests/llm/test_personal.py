import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from noticeflow.llm import personal
from noticeflow.llm.personal import KINDS

PICK = random.Random(3)
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = ["write to was.91@mail6.example.com or call +1 (017) 555-7713 now", "from 43.21.141.162, not 300.1.1.1 or 1.2.3",
         "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "a@b@c.d e.f@g", "é漢 x.y@z.w 1.2.3.4.5.6.7.8", "", None, "+1 2", "@.@@a.b",
         "+49 30 1234567890123 +493012345678", "x" * 50_000 + "@" + "y" * 10 + ".com", "1" * 40_000, "0001.002.3.255 0256.1.1.1", "a@b.c" * 3, "1.2.3.4@5.6"]


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    for t in TEXTS:
        if t and len(t) < 1_000:
            assert personal.base_spans(t) == brute(t)
    for _ in range(3_000):
        t = "".join(PICK.choice("ab@.@.-+ 1234 05()%é") for _ in range(PICK.randint(0, 40)))
        assert personal.base_spans(t) == brute(t), t
    assert personal.base_spans("4" * 30_000 + "@") == [] and len(personal.base_spans("1.2.3.4 " * 20_000)) == 20_000


def segmentations(window, kinds):
    """All sets of segments without overlap, each with a kind."""
    n = len(window.segments)
    for chosen in itertools.chain.from_iterable(itertools.combinations(range(n), r) for r in range(n + 1)):
        at = sorted(window.segments[s] for s in chosen)
        if all(a[1] <= b[0] for a, b in zip(at, at[1:], strict=False)):
            yield from itertools.product(*[[(s, k) for k in range(kinds)] for s in chosen])


@pytest.fixture
def window():
    found = personal.Window("5551, 5552 5553", 0, 15, [])
    assert 4 <= len(found.segments) <= 8
    return found, np.random.default_rng(1).normal(size=(len(found.segments), len(KINDS)))


def test_dynamic_programme_equals_all_segmentations(window):
    found, scores = window
    total = lambda parts: sum(scores[s, k] - 0.3 for s, k in parts)
    best = max(segmentations(found, len(KINDS)), key=total)
    got = personal.best_segments(found, scores, 0.3)
    assert got == sorted((*found.segments[s], k) for s, k in best)


def test_partition_equals_all_segmentations(window):
    found, scores = window
    weights = {p: np.exp(sum(scores[s, k] for s, k in p)) for p in segmentations(found, len(KINDS))}
    z, chance = personal.log_partition(found, scores)
    assert z == pytest.approx(np.log(sum(weights.values())))
    for s, k in itertools.product(range(len(scores)), range(len(KINDS))):
        assert chance[s, k] == pytest.approx(sum(w for p, w in weights.items() if (s, k) in p) / sum(weights.values()))


def sample(n=150):
    words = "the of and over into about under never often".split()
    some = lambda: " ".join(PICK.choice(words) for _ in range(PICK.randint(3, 12)))
    number = lambda k: "".join(PICK.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        value = [f"{PICK.choice(words)}.{number(2)}@mail{number(1)}.example.com", f"{PICK.randint(1, 255)}.{PICK.randint(0, 99)}.7.{PICK.randint(0, 255)}",
                 f"+1 ({number(3)}) 555-{number(4)}", "4111111111111111", "", number(16), f"version {number(1)}.{number(1)}"][i % 7]
        out.append(f"{some()} {value} {some()}")
    return out


def test_field_adds_forms_that_the_patterns_miss_and_leaves_others():
    weights = personal.trained(sample(), epochs=4)
    found = lambda t: [(k, t[a:b]) for k, a, b, base in personal.find_spans(t, weights) if not base]
    assert found("call the (212) 555-0187 about it") == [("phone", "(212) 555-0187")]
    assert found("write to jane.roe(at)mail.example.org never") == [("email", "jane.roe(at)mail.example.org")]
    for t in ("on 2024-01-05 12:30:00 and version 3.2 of it", "paid 1,250.75 for 12 of them", "plain words only", "a\nb\n\n9"):
        assert found(t) == []
    for t in sample(40):  # base spans stay, and nothing overlaps them
        spans = personal.find_spans(t, weights)
        base = [(k, a, b) for k, a, b, is_base in spans if is_base]
        assert base == brute(t)
        assert not any(a < d and c < b for k, a, b, x in spans if not x for _, c, d in base)


def test_scan_and_digest(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + [TEXTS[0]])], "doc_id long, text string, personal string")
    weights = personal.fit(docs, most_documents=10)
    rows = personal.digest(personal.scan(docs, weights)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if len(r["text"] or "") > 1_000:
            continue
        want = brute(r["text"] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x == k for x, _, _ in want) for k in KINDS]
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))
    empty = docs.where("false")
    assert not personal.fit(empty).any() and personal.scan(empty, weights).collect() == []
