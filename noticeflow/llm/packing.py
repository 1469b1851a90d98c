"""Best-fit decreasing packing of token sequences.

Every document becomes its token ids and one end id. Only a document longer than the
capacity is cut: into pieces of exactly the capacity, the first of which may be shorter.

Pieces of one length are interchangeable, so best-fit decreasing is decided on the
histogram of lengths: at most `capacity` rows, whatever the number of documents. Bins of
one remaining capacity that hold the same lengths are kept as one group, and a segment
tree over remaining capacities finds the tightest open group in logarithmic time. The
result is the packing that item-by-item best-fit decreasing gives. Ranks of pieces within
a length come from windows over hashed buckets, so no length is ranked in one task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, text_buffers
from .storage import saved

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 2_000
MOST_BUCKETS = 4_096
SPECIAL = "<|endoftext|>"
SLICE_BYTES = 1 << 20

_tokenizers: dict[str, ByteBpe] = {}


class ByteBpe:
    """Ids of the byte-level BPE vocabulary, each distinct word of a batch encoded once.

    The split before merging never crosses from a non-space character to a following
    single space, so a text is cut before its spaces, the distinct cuts are encoded as
    one string, and each begins with the one token that starts with a space. Texts with
    a space before white space or at the end are encoded whole, and texts that hold the
    special token by the tokenizer file itself.
    """

    def __init__(self, folder: str):
        import public_tokenizers
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        self.file = f"{folder}/byte_bpe_50k.json"
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.whole = re.compile(r" (?:\s|\Z)")

    @cached_property
    def full(self):
        """The tokenizer file itself: the largest part of a worker, loaded at the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain(text)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [i for i, t in enumerate(texts)
               if " " in t and not t.startswith(" ") and SPECIAL not in t and not self.whole.search(t)]
        rows: dict[int, np.ndarray] = {}
        if cut:
            parts = pc.split_pattern(pa.array([texts[i] for i in cut], pa.large_string()), " ")
            ends = parts.offsets.to_numpy()
            flat = parts.flatten().dictionary_encode()
            words = flat.dictionary.to_pylist()
            ids = self.plain(" " + " ".join(words))
            begin = np.flatnonzero(self.spaced[ids])
            assert len(begin) == len(words), "a word without its own leading token"
            length = np.diff(np.append(begin, len(ids)))
            codes = flat.indices.to_numpy()
            for i, a, b in zip(cut, ends[:-1], ends[1:], strict=True):
                c = codes[a + 1:b]
                n = length[c]
                stop = np.cumsum(n)
                at = np.repeat(begin[c] - stop + n, n) + np.arange(stop[-1])
                rows[i] = np.concatenate([self.plain(words[codes[a]]), ids[at]])
        for i, t in enumerate(texts):
            yield rows[i] if i in rows else self.encode(t)


def tokenizer(folder: str | None) -> ByteBpe:
    if folder is None:
        import os

        import public_tokenizers
        folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    if folder not in _tokenizers:
        _tokenizers[folder] = ByteBpe(folder)
    return _tokenizers[folder]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
           vocabulary: str | None = None, keep_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document.

    A null or empty text is the end id alone. Repeated rows give repeated pieces. Other
    columns are ignored. `vocabulary` is the folder of the tokenizer files.
    """
    schema = (f"doc_id {dict(docs.dtypes)[doc_id]}, piece int, start long, length long, ids_crc32 long"
              + (", ids array<int>" if keep_ids else ""))

    def run(batches):
        bpe = tokenizer(vocabulary)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            row, out, ids_out = [], [], []
            for i, ids in enumerate(bpe.encode_batch(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                data, n = ids.tobytes(), len(ids)
                starts = range(0, n, capacity) if n % capacity == 0 else [
                    0, *range(n % capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    row.append(i)
                    out.append((k, a, b - a, zlib.crc32(data[4 * a:4 * b])))
                    if keep_ids:
                        ids_out.append(ids[a:b].astype(np.int32))
            table = np.array(out, np.int64).reshape(-1, 4)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())),
                       pa.array(table[:, 0].astype(np.int32)), *map(pa.array, table[:, 1:].T.copy())]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[
                "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class OpenBins:
    """Segment tree over remaining capacities; a leaf holds the groups of bins with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.groups: dict[int, deque] = defaultdict(deque)

    def _mark(self, room: int) -> None:
        i = room + self.leaves
        self.open[i] = bool(self.groups[room])
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def put(self, room: int, first: int, bins: int) -> None:
        if bins:
            self.groups[room].append((first, bins))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].popleft()
        self._mark(room)
        return group

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least `size` that an open bin has."""
        i = size + self.leaves
        while not self.open[i]:
            while i & 1:  # a right child: nothing larger below this parent
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Best-fit decreasing over counts of lengths.

    Runs of (length, first rank, pieces per bin, first bin, offset): the pieces of that
    length with ranks from there on go to bins in order, so many into each.
    """
    bins, runs, made = OpenBins(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = bins.tightest(size)
            if room is None:
                room = capacity
                first, n = made, -(-left // (capacity // size))
                made += n
            else:
                first, n = bins.take(room)
            each = room // size
            full = min(n, left // each)
            for count, k in ((full, each), (1 if full < n and left > full * each else 0,
                                            left - full * each)):
                if count:
                    runs.append((size, rank, k, first, capacity - room))
                    bins.put(room - k * size, first, count)
                    first, n, rank, left = first + count, n - count, rank + count * k, left - count * k
            bins.put(room, first, n)
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of pieces().

    `parts` is read twice, so pass a stored table. An empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in
              parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    total = sum(counts.values())
    runs = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = (runs[:, 0] << 44) + runs[:, 1]

    buckets = min(MOST_BUCKETS, max(1, total // BUCKET_ROWS))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (parts.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
            .select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (parts.withColumn("rank", F.row_number().over(within) - 1)
              .join(base, ["bucket", "length"])
              .withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd
        size, q = length.to_numpy(), rank.to_numpy()
        run = runs[np.searchsorted(key, (size << 44) + q, "right") - 1]
        t = q - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + t // run[:, 2],
                             "offset": run[:, 4] + t % run[:, 2] * size})

    names = [c for c in parts.columns if c != "bucket"]
    return (ranked.withColumn("place", place("length", F.col("rank").cast("long")))
            .select(*names, "place.sequence_id", "place.offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """pieces() stored once, then pack()."""
    return pack(saved(pieces(docs, capacity, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids in order, from pack() of pieces(keep_ids=True)."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids")))
