"""Personal data by fixed patterns and a semi-Markov conditional random field.

Fixed patterns report e-mail addresses, IP addresses, card numbers and phone numbers.
Beyond them, whole candidate segments around digits and at-signs are scored by features of
the segment (its shape, digits, separators, checksum, neighbours), and a dynamic programme
over starts, lengths and types chooses the segmentation of highest total score. Segments
have a bounded number of units, so the programme is linear in the text. What the patterns
found is fixed in it: added spans never overlap those.

The weights maximise the conditional likelihood of segmentations whose entities are what the
patterns find in a bounded sample of documents, together with rewritten forms of those
entities (another separator, no country code, a spelled-out at-sign) in their own context,
so that the field learns forms that the patterns do not know.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices

KINDS = ("email", "ip", "card", "phone")
MOST_UNITS = 24
MOST_CHARS = 80
CONTEXT_UNITS = 4
SAMPLE_DOCUMENTS = 4_000
SAMPLE_WINDOWS = 3_000
EPOCHS = 4
COPIES = 3  # rewritten forms of each window that holds an entity, and decoys of all but one
FEATURES = 1 << 18
#: A segment must beat leaving its units alone by this much before it is added.
MARGIN = 1.0
SPANS = "array<struct<kind: string, start: int, stop: int, base: boolean>>"

TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[^\W_]+")
UNIT = re.compile(r"[^\W_]+|\s+|.", re.DOTALL)
SPELLED = re.compile(r"[(\[]at[)\]]| at ", re.IGNORECASE)
#: Where entities may be: near a digit, an at-sign or a spelled-out one.
ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]| at (?=[a-z0-9-]+(?: dot |\.))", re.IGNORECASE)
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the fixed patterns by start, then kind as listed.

    Each is the leftmost non-overlapping match of its pattern; an e-mail address is found
    from its at-sign and an IP address from the start of a run of digits, which gives the
    same matches in time linear in the text.
    """
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        tail = TAIL.match(text, at + 1) if start < at else None
        if tail:
            end = tail.end()
            out.append(("email", start, end))
        else:
            end = max(end, at)  # what stands before this sign cannot reach a later one
        at = text.find("@", at + 1)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- windows and features

def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold every possible entity: around anchors, merged where they touch."""
    low = high = -1
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - MOST_CHARS), min(len(text), m.end() + MOST_CHARS)
        if a > high:
            if high >= 0:
                yield low, high
            low = a
        high = b
    if high >= 0:
        yield low, high


def sort_of(c: str) -> str:
    """The kind of a neighbouring character; '' is the border of the text."""
    return "^" if not c else "9" if c in "0123456789" else "a" if c.isalpha() else "_" if c.isspace() else c


def shapes(segment: str) -> tuple[str, str]:
    """Runs with letters as w, runs of digits as their length (9 and over alike), other characters
    as they are; and the same without lengths, repeated parts once."""
    fine = RUN.sub(lambda m: f"<{min(len(m[0]), 9)}>" if m[0].isdecimal() else "w", segment)
    return fine[:40], re.sub(r"([w9][^w9])\1+", r"\1*", RUN.sub(lambda m: "9" if m[0].isdecimal() else "w", segment))[:24]


def possible(segment: str) -> bool:
    """Whether a segment may be an entity at all: enough digits, or an at-sign in some spelling."""
    first, last = segment[0], segment[-1]
    if "\n" in segment or not (last.isalnum() or last == ")") or not (first.isalnum() or first in "+("):
        return False
    return len(NOT_DIGIT.sub("", segment)) >= 4 or "@" in segment or bool(SPELLED.search(segment))


def features(text: str, start: int, stop: int) -> list[int]:
    """Hashed features of a whole segment, whatever its kind."""
    segment = text[start:stop]
    digits = NOT_DIGIT.sub("", segment)
    n = len(digits)
    left, right = sort_of(text[start - 1:start]), sort_of(text[stop:stop + 1])
    letters = any(c.isalpha() for c in segment)
    parts = [p for p in NOT_DIGIT.split(segment) if p]
    fine, coarse = shapes(segment)
    signs = "".join(sorted(set(RUN.sub("", segment))))[:8]
    named = (f"shape {fine}", f"coarse {coarse}", f"digits {min(n, 20)} {letters}", f"first {sort_of(segment[0])} {letters}",
             f"last {sort_of(segment[-1])}", f"sides {left}{right}", f"at {'@' in segment} {bool(SPELLED.search(segment))} {letters}",
             f"dots {min(segment.count('.'), 4)} {letters}", f"luhn {n >= 14 and luhn(digits)} {14 <= n <= 19} {letters}",
             f"parts {min(len(parts), 6)} {letters}", f"byte {all(len(p) < 4 and int(p) < 256 for p in parts)} {len(parts) == 4} {letters}",
             f"signs {signs}", f"spaces {min(segment.count(' '), 4)}", f"ten {9 < n < 16} {signs}", "bias")
    return [zlib.crc32(f.encode()) for f in named]


#: A feature counts for each kind on its own.
SALTS = np.array([zlib.crc32(k.encode()) for k in KINDS], np.int64)


def by_kind(found: list[list[int]]) -> np.ndarray:
    """Places in the weights, by segment, kind and feature."""
    ids = np.array(found, np.int64).reshape(len(found), 1, -1)
    return ((ids ^ SALTS[None, :, None]) * 0x9E3779B1 >> 7) % FEATURES


class Window:
    """A stretch of text as units and its candidate segments."""

    def __init__(self, text: str, low: int, high: int, taken: list[tuple[str, int, int]]):
        self.bounds = [m.start() for m in UNIT.finditer(text, low, high)] + [high]
        place = {p: i for i, p in enumerate(self.bounds)}
        self.size = len(self.bounds) - 1
        closed = np.zeros(self.size + 1, np.int64)
        for _, a, b in taken:
            closed[np.searchsorted(self.bounds, a, "right") - 1:np.searchsorted(self.bounds, b)] = 1
        before = np.concatenate([[0], np.cumsum(closed)])
        anchors = {place_of(self.bounds, m.start()) for m in ANCHOR.finditer(text, low, high)}
        near = np.zeros(self.size + 1, np.int64)
        near[[i for i in anchors if i < self.size]] = 1
        hits = np.concatenate([[0], np.cumsum(near)])
        self.segments: list[tuple[int, int]] = []
        for i in range(self.size):
            for j in range(i + 1, min(self.size, i + MOST_UNITS) + 1):
                if self.bounds[j] - self.bounds[i] > MOST_CHARS or before[j] > before[i]:
                    break
                if hits[j] > hits[i] and possible(text[self.bounds[i]:self.bounds[j]]):
                    self.segments.append((i, j))
        self.place = place


def place_of(bounds: list[int], at: int) -> int:
    return int(np.searchsorted(bounds, at, "right")) - 1


def scored(text: str, window: Window, weights: np.ndarray) -> np.ndarray:
    """A row of scores for each candidate segment, a column for each kind."""
    return weights[by_kind([features(text, window.bounds[i], window.bounds[j]) for i, j in window.segments])].sum(2)


def best_segments(window: Window, scores: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(segment, kind) of the segmentation of highest score, as (start unit, stop unit, kind).

    best[j] is the highest score of the first j units; a unit alone scores 0, a segment its
    score less the margin. Of equal segmentations the one with fewer entities is taken.
    """
    best, back = np.zeros(window.size + 1), [None] * (window.size + 1)
    by_stop: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(window.segments):
        by_stop.setdefault(j, []).append(s)
    for j in range(1, window.size + 1):
        best[j] = best[j - 1]
        for s in by_stop.get(j, ()):
            i, k = window.segments[s][0], int(scores[s].argmax())
            value = best[i] + scores[s, k] - margin
            if value > best[j] + 1e-12:
                best[j], back[j] = value, (i, k)
    out, j = [], window.size
    while j > 0:
        if back[j]:
            i, k = back[j]
            out.append((i, j, k))
            j = i
        else:
            j -= 1
    return out[::-1]


def log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top


def log_partition(window: Window, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """log of the summed weights of all segmentations, and each segment's probability by kind."""
    forward, backward = [0.0] * (window.size + 1), [0.0] * (window.size + 1)
    by_stop: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j) in enumerate(window.segments):
        by_stop.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    total = np.logaddexp.reduce(scores, axis=1).tolist() if len(scores) else []
    for j in range(1, window.size + 1):
        terms = [forward[j - 1]] + [forward[window.segments[s][0]] + total[s] for s in by_stop.get(j, ())]
        forward[j] = log_sum(terms)
    for i in range(window.size - 1, -1, -1):
        terms = [backward[i + 1]] + [backward[window.segments[s][1]] + total[s] for s in by_start.get(i, ())]
        backward[i] = log_sum(terms)
    z = forward[-1]
    chance = np.array([np.exp(forward[i] + scores[s] + backward[j] - z) for s, (i, j) in enumerate(window.segments)])
    return float(z), chance.reshape(-1, len(KINDS))


# ---------------------------------------------------------------- training

def rewritten(kind: str, value: str, pick: random.Random) -> str:
    """Another form of an entity, which the fixed patterns may not know."""
    if kind == "email":
        at, dot = pick.choice([("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", ".")])
        if pick.random() < 0.5:
            value = re.sub(r"[.]?[0-9]+", "", value)
        name, _, host = value.rpartition("@")
        return f"{name}{at}{host.replace('.', dot)}"
    digits = NOT_DIGIT.sub("", value)
    if kind == "phone":
        d = digits[-10:]
        return pick.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}",
                            f"00{digits[:-10] or '1'} {d[:3]} {d[3:6]} {d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}){d[3:6]}-{d[6:]}"])
    if kind == "card":
        sign = pick.choice([".", "/", "  ", " - "])
        return sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return value.replace(".", pick.choice(["[.]", "(.)", " . "]))


def decoy(digits: str, pick: random.Random) -> str:
    """Digits of an entity as something that is no personal data: a time, an amount, a version, a number."""
    d = (digits * 24)[:24]
    month, day, hour, minute = (1 + int(d[i:i + 2]) % most for i, most in ((4, 12), (6, 28), (8, 23), (10, 59)))
    return pick.choice([f"20{d[:2]}-{month:02}-{day:02} {hour:02}:{minute:02}:{d[12]}0", f"20{d[:2]}-{month:02}-{day:02}", f"{day:02}.{month:02}.20{d[:2]}",
                        f"{hour:02}:{minute:02} {d[:4]}-{d[4:8]}", f"{d[:3]},{d[3:6]},{d[6:9]}.{d[9:11]}", f"{d[:2]}.{d[2:5]}.{d[5:8]}", f"{d[0]}.{d[1]}.{d[2]}",
                        d[:pick.randint(4, 20)], f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d[:4]}-{d[4:8]}", f"{d[:2]}.{d[2:6]}", f"{d[:5]}-{d[5:9]} {d[9:12]}"])


def examples(texts: list[str], most: int = SAMPLE_WINDOWS, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(window text, entities in it): windows as they are, with their entities rewritten, and with
    decoys in their place. What the patterns find in a decoy is no entity to the field."""
    pick, out = random.Random(seed), []
    for text in texts:
        found = base_spans(text)
        for low, high in windows(text):
            inside = [s for s in found if s[1] >= low and s[2] <= high]
            if any(a[2] > b[1] for a, b in zip(inside, inside[1:], strict=False)):
                continue  # patterns that overlap are no single segmentation
            out.append((text[low:high], [(k, a - low, b - low) for k, a, b in inside]))
            for copy in range(COPIES * bool(inside)):
                changed, spans, at = "", [], low
                for k, a, b in inside:
                    new = rewritten(k, text[a:b], pick)
                    changed += text[at:a]
                    spans.append((k, len(changed), len(changed) + len(new)))
                    changed, at = changed + new, b
                out.append((changed + text[at:high], spans))
                changed, at = "", low
                for _, a, b in inside if copy else ():
                    changed, at = changed + text[at:a] + decoy(NOT_DIGIT.sub("", text[a:b]) or "1", pick), b
                if copy:
                    out.append((changed + text[at:high], []))
    pick.shuffle(out)
    return out[:most]


def trained(texts: list[str], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-6,
            most: int = SAMPLE_WINDOWS, seed: int = 1) -> np.ndarray:
    """Weights by stochastic gradient on the conditional log-likelihood of segmentations."""
    weights = np.zeros(FEATURES)
    square = np.full(FEATURES, 1e-3)
    prepared = []
    for text, spans in examples(texts, most, seed):
        window = Window(text, 0, len(text), [])
        at = {seg: s for s, seg in enumerate(window.segments)}
        truth = []
        for kind, a, b in spans:
            seg = (window.place.get(a), window.place.get(b))
            if seg in at:
                truth.append((at[seg], KINDS.index(kind)))
        if window.segments:
            ids = by_kind([features(text, window.bounds[i], window.bounds[j]) for i, j in window.segments])
            prepared.append((window, ids, truth))
    order, pick = list(range(len(prepared))), random.Random(seed)
    for _ in range(epochs):
        pick.shuffle(order)
        for p in order:
            window, ids, truth = prepared[p]
            _, chance = log_partition(window, weights[ids].sum(2))
            slope = -chance
            for s, k in truth:
                slope[s, k] += 1
            grad = np.bincount(ids.ravel(), np.repeat(slope.ravel(), ids.shape[2]), 0)
            hit = np.flatnonzero(grad)
            g = grad[hit] - decay * weights[hit]
            square[hit] += g * g
            weights[hit] += rate * g / np.sqrt(square[hit])
    return weights


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_documents: int = SAMPLE_DOCUMENTS,
        most_windows: int = SAMPLE_WINDOWS) -> np.ndarray:
    """Weights from at most `most_documents` texts that hold an anchor, the least by hash of id and text.

    Only the windows around anchors reach the driver: at most `most_windows`, each of some
    hundred characters (longer ones train nothing). No text is needed: without any, the
    weights are zero and nothing is added to the patterns.
    """
    def run(batches):
        for batch in batches:
            out, key = [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for low, high in windows(t):
                    if high - low <= 6 * MOST_CHARS:
                        out.append(t[low:high])
                        key.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(out, pa.string())], names=["key", "w"])

    chosen = (docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key"), F.col(text).alias("t"))
              .where(F.col("t").rlike("[0-9@]")).select("key", "t"))
    keys = chosen.select("key").distinct().orderBy("key").limit(most_documents)
    found = chosen.join(F.broadcast(keys), "key").dropDuplicates(["key"]).mapInArrow(run, "key long, w string")
    rows = found.orderBy("key", "w").limit(most_windows).collect()
    return trained([r["w"] for r in rows], most=most_windows)


# ---------------------------------------------------------------- finding

def find_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[str, int, int, bool]]:
    """(kind, start, stop, base) by start, then kind as listed, base ones first."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if weights.any():
        at = 0
        for low, high in windows(text):
            while at < len(base) and base[at][2] <= low:
                at += 1
            taken = []
            for s in base[at:]:
                if s[1] >= high:
                    break
                taken.append(s)
            window = Window(text, low, high, taken)
            if window.segments:
                scores = scored(text, window, weights)
                out += [(KINDS[k], window.bounds[i], window.bounds[j], False)
                        for i, j, k in best_segments(window, scores, margin)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), not s[3], s[2]))


def scan(docs: DataFrame, weights: np.ndarray, text: str = "text", into: str = "personal",
         margin: float = MARGIN) -> DataFrame:
    """docs with an array `into` of (kind, start, stop, base) in code points, end exclusive.

    base tells spans of the fixed patterns from those that the field adds. A null or empty
    text has none. Repeated rows stay; an input column named like `into` is replaced.
    """
    docs = docs.drop(into)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in slices(batches, text):
            found = [[dict(zip(("kind", "start", "stop", "base"), s, strict=True)) for s in find_spans(t, weights, margin)]
                     for t in pc.fill_null(batch.column(text), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(SPANS))]))


def digest(found: DataFrame, into: str = "personal") -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(into, lambda s: s["base"])
    counts = {f"n_{k}": number(k) for k in KINDS}
    return found.withColumns(counts | {"base_sha256": F.sha2(joined(base), 256), "spans": joined(F.col(into))})
