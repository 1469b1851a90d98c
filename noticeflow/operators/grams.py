"""Texts as sets of q-grams: which texts may hold a given string.

A gram is q neighbouring characters, named by a 64-bit number. A string of q or more
characters occurs only in texts that hold all of its grams; a shorter one is one gram of its
own length. Numbers only choose candidates, which are compared afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Places of the filter that keeps grams of no interest from being sent: 128 KB, whatever the data.
PLACES = 1 << 20
CHUNK = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
ROWS = 256
HELD = 1 << 21  # counted grams that a task holds


@dataclass(frozen=True)
class Wanted:
    """A filter over gram numbers, and the gram lengths that occur."""

    bits: bytes
    sizes: tuple[int, ...]


def _numbers(text: str, sizes: tuple[int, ...]):
    """(length, numbers of all grams of that length), in runs of bounded length."""
    longest = max(sizes, default=0)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK + longest - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        number = np.zeros(len(points), np.uint64)
        for q in range(1, min(longest, len(points)) + 1):
            n = len(points) - q + 1
            number = (number[:n] ^ (points[q - 1:] + np.uint64(q))) * FACTOR
            number ^= number >> np.uint64(29)
            if q in sizes:
                yield q, number[:CHUNK]


def gram_numbers(text: str, q: int) -> list[int]:
    """The distinct grams of one string, as grams() numbers them; none of a string shorter than q."""
    parts = [n.view(np.int64) for _, n in _numbers(text, (q,))]
    return np.unique(np.concatenate(parts)).tolist() if parts else []


def _place(numbers: np.ndarray) -> np.ndarray:
    return ((numbers * FACTOR) >> np.uint64(44)).astype(np.int64)


def grams(df: DataFrame, key: str, text: str, q: int, wanted: Wanted | None = None, short: bool = False) -> DataFrame:
    """(key, gram, size): once each gram of each row's text, in time linear in the text.

    With ``wanted`` those grams, of any length, that may be in it; otherwise those of length
    q, and with ``short`` a text shorter than q as one gram. A null or empty text has none.
    """
    bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted.bits, np.uint8))

    def found(t: str | None):
        sizes = wanted.sizes if wanted else (min(q, len(t or "")) if short else q,)
        for size in sizes:
            parts = []
            for _, numbers in _numbers(t or "", (size,) if size else ()):
                if bits is not None:
                    numbers = numbers[bits[_place(numbers)] > 0]
                parts.append(np.unique(numbers))
            if parts:
                yield size, np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # a text may have as many grams as characters
                part = batch.slice(at, ROWS)
                lists = [(i, size, n) for i, t in enumerate(part.column("text").to_pylist()) for size, n in found(t)]
                counts = [len(n) for _, _, n in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(np.repeat([i for i, _, _ in lists], counts).astype(np.int64))),
                     pa.array(np.concatenate([np.zeros(0, np.uint64), *[n for _, _, n in lists]]).view(np.int64)),
                     pa.array(np.repeat([s for _, s, _ in lists], counts).astype(np.int32))], names=["key", "gram", "size"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("gram", T.LongType()),
                           T.StructField("size", T.IntegerType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def wanted_of(found: DataFrame) -> Wanted:
    """The filter over the grams of a table: at most ``PLACES`` small numbers reach the driver."""
    def places(batches):
        for batch in batches:
            place = _place(batch.column("gram").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(
                [place, PLACES + np.unique(batch.column("size").to_numpy())])))], names=["place"])

    place = found.select("gram", "size").mapInArrow(places, "place long").distinct().toArrow().column("place").to_numpy()
    bits = np.zeros(PLACES, np.uint8)
    bits[place[place < PLACES]] = 1
    return Wanted(np.packbits(bits).tobytes(), tuple(sorted(int(p) - PLACES for p in place[place >= PLACES])))


def text_counts(found: DataFrame) -> DataFrame:
    """(gram, texts): in how many rows each gram occurs; summed within tasks first."""
    return found.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))


def gram_counts(df: DataFrame, text: str, q: int, wanted: Wanted) -> DataFrame:
    """(gram, texts) of the wanted grams. A task adds up what it has found before it sends it."""
    bits = np.unpackbits(np.frombuffer(wanted.bits, np.uint8))

    def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        unique, at = np.unique(numbers, return_inverse=True)
        return unique, np.bincount(at, counts, len(unique)).astype(np.int64)

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for t in batch.slice(at, ROWS).column("text").to_pylist():
                    once = [n[bits[_place(n)] > 0] for _, n in _numbers(t or "", wanted.sizes)]
                    if once:
                        numbers = np.unique(np.concatenate(once))
                        found.append((numbers, np.ones(len(numbers), np.int64)))
                        held += len(numbers)
                if held > HELD:
                    found = [merged(found)]
                    held = 0
                    if len(found[0][0]) > HELD:
                        yield from sent(found.pop())
        if found:
            yield from sent(merged(found))

    def sent(counted):
        for at in range(0, len(counted[0]), HELD // 8):
            numbers, counts = (c[at:at + HELD // 8] for c in counted)
            yield pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64)), pa.array(counts)], names=["gram", "texts"])

    return (df.select(F.col(text).alias("text")).mapInArrow(run, "gram long, texts long")
            .groupBy("gram").agg(F.sum("texts").alias("texts")))


def literal_parts(q: str) -> list[str]:
    """The runs of a search text between wildcards, which every match must hold."""
    return [p for p in q.replace("_", "%").split("%") if p]
