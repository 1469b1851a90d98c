"""Which of many strings a text holds, counted where the text lies.

A string without white space occurs in a text only within one of the text's words, so the
distinct words of many texts are searched once for all of them. Strings are kept by pieces of
eight bytes: from each place of the words one step for each piece is taken, by exact
comparison, however many strings begin alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = 1 << 20
TEXT_BYTES = 1 << 22  # texts whose words are searched together
PAIRS = 1 << 22  # (text, string) pairs that are counted together, one text's at least
PLACES = 20  # logarithm of the filter before a lookup
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _place(piece: np.ndarray) -> np.ndarray:
    return ((piece * FACTOR) >> np.uint64(64 - PLACES)).astype(np.int64)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its count."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class _Step:
    """From (node, piece of `size` bytes) to numbers, of which a pair may have several."""

    def __init__(self, size: int, node: np.ndarray, piece: np.ndarray, number: np.ndarray):
        self.size, self.pieces = size, np.unique(piece)
        key = node * len(self.pieces) + np.searchsorted(self.pieces, piece)
        by = np.argsort(key, kind="stable")
        self.number = number[by]
        self.keys, self.starts, self.counts = np.unique(key[by], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << PLACES, bool) if len(self.pieces) > 64 else None
        if self.filter is not None:
            self.filter[_place(self.pieces)] = True

    def taken(self, place: np.ndarray | None, node: np.ndarray | None, piece: np.ndarray):
        """Place and number of every step from the places (all, if None) at the nodes (the root, if None)."""
        piece = piece & _mask(self.size)
        at = np.arange(len(piece)) if self.filter is None else np.flatnonzero(self.filter[_place(piece)])
        rank = np.minimum(np.searchsorted(self.pieces, piece[at]), len(self.pieces) - 1)
        same = self.pieces[rank] == piece[at]
        at, found = at[same], rank[same]  # from the root, every piece is a step
        if node is not None:
            key = found + node[at] * len(self.pieces)
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[found] == key
            at, found = at[same], found[same]
        numbers = self.number[_runs(self.starts[found], self.counts[found])]
        return np.repeat(at if place is None else place[at], self.counts[found]), numbers


class Strings:
    """Byte strings, none of them empty, to be found in others."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.levels = []  # for each: steps that end strings, the step to the next level
        left, node = np.arange(len(strings)), np.zeros(len(strings), np.int64)
        while len(left):
            begin = 8 * len(self.levels)
            size = np.minimum(self.length[left] - begin, 8)
            piece = np.array([int.from_bytes(strings[i][begin:begin + 8], "little") for i in left.tolist()], np.uint64)
            last = self.length[left] <= begin + 8
            ends = [_Step(s, node[here], piece[here], left[here])
                    for s in range(1, 9) if (here := last & (size == s)).any()]
            left, node, piece = left[~last], node[~last], piece[~last]
            on = None
            if len(left):
                pairs, child = np.unique(np.stack([node.view(np.uint64), piece]), axis=1, return_inverse=True)
                on = _Step(8, pairs[0].astype(np.int64), pairs[1], np.arange(pairs.shape[1]))
                node = child.ravel().astype(np.int64)
            self.levels.append((ends, on))

    def inside(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, string) for every string that a text holds, once and in this order; texts is a binary array."""
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if len(texts) and data is not None else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        padded = np.append(raw, np.zeros(8, np.uint8))
        windows = np.ndarray((len(raw),), "<u8", padded, 0, (1,))  # eight bytes from every place
        found = [np.zeros((2, 0), np.int64)]
        for a in range(0, len(raw), CHUNK):
            place, node = None, None
            for level, (ends, on) in enumerate(self.levels):
                piece = windows[a:a + CHUNK].copy() if place is None else windows[place + a + 8 * level]
                found += [np.stack([p + a, n]) for p, n in (step.taken(place, node, piece) for step in ends) if len(p)]
                if on is None:
                    break
                place, node = on.taken(place, node, piece)
                here = place + a + 8 * (level + 1) < len(raw)
                place, node = place[here], node[here]
                if not len(place):
                    break
        place, string = np.concatenate(found, axis=1)
        text = np.searchsorted(offs, place, "right") - 1
        whole = place + self.length[string] <= offs[text + 1]  # not across two texts
        pair = _once(text[whole] * len(self.length) + string[whole])
        return pair // max(1, len(self.length)), pair % max(1, len(self.length))


def _once(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def _within_words(texts: pa.Array, strings: Strings):
    """Strings without white space inside texts: (text, string) in parts, sorted, each text in one part."""
    words = pc.ascii_split_whitespace(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    word, string = strings.inside(coded.dictionary.cast(pa.binary()))
    count = np.bincount(word, minlength=len(coded.dictionary))
    start = np.cumsum(count) - count
    pair = _once(text * max(1, len(count)) + coded.indices.to_numpy())
    text, word = pair // max(1, len(count)), pair % max(1, len(count))
    many = np.bincount(text, count[word], len(texts)).astype(np.int64)
    part = (np.cumsum(many) - many) // PAIRS
    for a, b in _cuts(part):
        u, v = np.searchsorted(text, [a, b])
        n = count[word[u:v]]
        yield np.repeat(text[u:v], n), string[_runs(start[word[u:v]], n)]


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def first_and_count(df: DataFrame, key: str, text: str, words: pa.Table, at_type: T.DataType) -> DataFrame:
    """(key, at, keyword, hits): of the words of a bounded table, the first that a text holds and how many it holds.

    ``words`` has at and keyword, in the order of ``at``. A text stays in its task, and what
    it holds is counted there.
    """
    keywords, ats = words.column("keyword").combine_chunks(), words.column("at").combine_chunks()
    encoded = [k.encode() for k in keywords.to_pylist()]
    plain = np.array([min(k) > 32 for k in encoded], bool)  # no white space
    kinds = [(np.flatnonzero(k), Strings([encoded[i] for i in np.flatnonzero(k)])) for k in (plain, ~plain)]

    def counted(texts: pa.Array):
        first, hits = np.full(len(texts), len(encoded)), np.zeros(len(texts), np.int64)
        for (number, strings), parts in zip(kinds, (_within_words, lambda t, s: [s.inside(t.cast(pa.binary()))])):
            for row, string in parts(texts, strings) if len(number) else ():
                pair = _once(row * len(encoded) + number[string])
                row = pair // len(encoded)
                begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
                first[row[begins]] = np.minimum(first[row[begins]], pair[begins] % len(encoded))
                hits += np.bincount(row, minlength=len(texts))
        return first, hits

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            part = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // TEXT_BYTES
            for a, b in _cuts(part):
                first, hits = counted(texts.slice(a, b - a))
                rows = np.flatnonzero(hits)
                at = pa.array(first[rows])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(a + rows)), ats.take(at), keywords.take(at),
                                                  pa.array(hits[rows])], names=["key", "at", "keyword", "hits"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("at", at_type),
                           T.StructField("keyword", T.StringType()), T.StructField("hits", T.LongType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
