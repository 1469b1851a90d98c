"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items make one automaton. Training texts stream through it word by
word; its state is the longest run of words just read that some item contains. Wherever
that run covers a whole window of an item, the window's words in the text are hit. A run
of words that no item knows leads to the root, so only runs of known words are streamed.

Items are cut into chunks that overlap by a window less one word, and dealt into blocks of
bounded size, each with its own automaton; the documents are read once for each block, and
what the blocks find is united per document. The driver holds one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, WORD_BYTES, hash_of, slices, span_hashes, text_buffers, word_bounds
from .storage import saved

WINDOW = 10
MOST_COVERAGE = 0.5
BLOCK_WORDS = 100_000
CHUNK_WORDS = 20_000
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = ("struct<n_words: long, n_hit: long, longest: long, items: array<string>, "
         "hit_words: array<int>, spans: array<struct<start: int, stop: int>>>")


class SuffixAutomaton:
    """All runs of words of the items, with the windows and the items each belongs to."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        words = sorted({w for _, ws in items for w in ws})
        hashes = hash_of(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        code = {words[j]: i for i, j in enumerate(order.tolist())}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [code[w] for w in ws]) for item, ws in items if ws]
        for _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        self.least = min((min(len(ws), window) for _, ws in coded), default=window)
        for item, ws in coded:
            state = 0
            for i, c in enumerate(ws):
                state = self.next[state][c]
                if i + 1 >= window:
                    state = self._shorten(state, window)
                    self.owners.setdefault(state, set()).update([item] if item is not None else [])
            if len(ws) < window:
                self.whole.setdefault(state, {}).setdefault(len(ws), set()).update(
                    [item] if item is not None else [])
        # The state that holds the last `window` words, and the nearest with whole short items.
        n = len(self.link)
        self.full, self.marked = [-1] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.full[s] = s if self.length[up] < window else self.full[up]
            self.marked[s] = s if s in self.whole else self.marked[up]

    def _shorten(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the runs of q that end at p's length + 1."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stream(self, codes: list[int]):
        """(index of the last word, words, longest match, items) for every window that occurs."""
        follow, link, length = self.next, self.link, self.length
        state = run = 0
        for i, c in enumerate(codes):
            while (to := follow[state].get(c)) is None and state:
                state = link[state]
                run = length[state]
            if to is None:
                continue
            state, run = to, run + 1
            if run >= self.window:
                yield i, self.window, run, self.owners[self.full[state]]
            s = self.marked[state]
            while s > 0:
                for n, items in self.whole[s].items():
                    if n <= run:
                        yield i, n, run, items
                s = self.marked[link[s]]


def scan(raw: np.ndarray, offs: np.ndarray, automaton: SuffixAutomaton):
    """Words per row, and for rows with hits (row, longest, items, hit word numbers, byte spans)."""
    raw = LOWER[raw]
    starts, ends, rows = word_bounds(raw, offs, WORD_BYTES)
    n_words = np.bincount(rows, minlength=len(offs) - 1)
    codes = automaton.codes(span_hashes(raw, starts, ends))
    known = codes >= 0
    if not known.any():
        return n_words, []
    fresh = np.flatnonzero(np.diff(rows, prepend=-1))
    edge = np.zeros(len(rows) + 1, bool)
    edge[fresh] = True
    edge[:-1][~known] = True
    edge[1:][~known] = True
    edge[-1] = True
    cuts = np.flatnonzero(edge)
    runs = np.stack([cuts[:-1], cuts[1:]], 1)
    runs = runs[known[runs[:, 0]] & (runs[:, 1] - runs[:, 0] >= automaton.least)]
    step = np.zeros(len(rows) + 1, np.int64)
    longest: dict[int, int] = {}
    items: dict[int, set[str]] = {}
    for a, b in runs.tolist():
        row = int(rows[a])
        for i, n, run, owners in automaton.stream(codes[a:b].tolist()):
            step[a + i - n + 1] += 1
            step[a + i + 1] -= 1
            longest[row] = max(run, longest.get(row, 0))
            items.setdefault(row, set()).update(owners)
    hit = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    found = []
    by_row = np.searchsorted(rows[hit], np.array([*longest, 0])[:-1])
    first_word = np.searchsorted(rows, np.arange(len(offs) - 1))
    for row, a in zip(longest, by_row.tolist(), strict=True):
        words = hit[a:a + int(np.searchsorted(rows[hit[a:]], row, "right"))]
        split = np.flatnonzero(np.diff(words) > 1) + 1
        spans = [(int(starts[w[0]] - offs[row]), int(ends[w[-1]] - offs[row]))
                 for w in np.split(words, split)]
        found.append((row, longest[row], sorted(items.get(row, ())), words - first_word[row], spans))
    return n_words, found


def code_points(text: bytes, at: list[int]) -> list[int]:
    """Code points before each byte offset."""
    first = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return first[at].tolist()


def item_chunks(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOW),
                                 F.lit(WORD), F.lit(0))
    cut = F.expr(f"""transform(sequence(0, greatest(size(words) - {window}, 0), {CHUNK_WORDS}),
                     i -> slice(words, i + 1, {CHUNK_WORDS + window - 1}))""")
    return (items.select(F.col(item_id).cast("string").alias("item"), words.alias("words"))
            .where(F.size("words") > 0)
            .select("item", F.explode(cut).alias("words")))


def _found_type() -> pa.DataType:
    return pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()),
                      ("items", pa.list_(pa.string())), ("hit_words", pa.list_(pa.int32())),
                      ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _match(docs: DataFrame, block: list, window: int, text: str, into: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS and a chunk
    position = docs.columns.index(text)

    def run(batches):
        automaton = SuffixAutomaton([(i, [w.encode() for w in ws]) for i, ws in shared.value], window)
        kind = _found_type()
        for batch in slices(batches, text):
            raw, offs = text_buffers(batch.column(position))
            n_words, found = scan(raw, offs, automaton)
            rows = [{"n_words": n, "n_hit": 0, "longest": 0, "items": [], "hit_words": [], "spans": []}
                    for n in n_words.tolist()]
            for row, longest, items, words, spans in found:
                at = code_points(raw[offs[row]:offs[row + 1]].tobytes(), [x for s in spans for x in s])
                rows[row] |= {"n_hit": len(words), "longest": longest, "items": items,
                              "hit_words": words.tolist(),
                              "spans": [{"start": a, "stop": b} for a, b in zip(at[::2], at[1::2])]}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)],
                                             names=[*batch.schema.names, into])

    kind = T._parse_datatype_string(FOUND)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, kind)]))


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
             item_id: str = "item_id", item_text: str = "text", into: str = "overlap",
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct `into`: n_words, n_hit, longest matched run, items, hit_words, spans.

    A window is `window` consecutive words of an item, or all words of an item of fewer. A
    word inside any occurrence of a window is hit; spans are runs of hit words in code
    points. A null text has no words, and neither has an item with a null text; an item
    with a null id hits words but is not listed. Repeated rows stay. Without items nothing
    is hit. An input column named like `into` is replaced.
    """
    docs = docs.drop(into)
    chunks = saved(item_chunks(items, window, item_id, item_text), "items")
    total = chunks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // block_words) or 1
    dealt = chunks.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))

    def block(b):
        return [(r["item"], list(r["words"])) for r in dealt.where(F.col("block") == b).collect()]

    if blocks == 1:
        return _match(docs, block(0), window, text, into)
    # A text is recognised by two hashes and its length, so repeated rows meet the same result.
    key = F.struct(F.xxhash64(text), F.xxhash64(F.reverse(F.col(text))), F.length(text))
    texts = docs.select(F.col(text).alias("text"), key.alias("key"))
    parts = None
    for b in range(blocks):
        part = saved(_match(texts, block(b), window, "text", "o").where("o.n_hit > 0")
                     .select("key", "o").dropDuplicates(["key"]), "overlap")
        parts = part if parts is None else parts.union(part)
    # A window lies in one block, but runs of hit words may touch: spans are made from words again.
    met = (parts.groupBy("key").agg(
        F.max("o.n_words").alias("n_words"), F.max("o.longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("o.items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("o.hit_words")))).alias("hit_words")))

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def spans_of(text, words):
        import pandas as pd
        out = []
        for t, w in zip(text, words, strict=True):
            if w is None or not len(w):
                out.append([])
                continue
            data = t.encode()
            raw = LOWER[np.frombuffer(data, np.uint8)]
            starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), WORD_BYTES)
            w = np.asarray(w)
            runs = np.split(w, np.flatnonzero(np.diff(w) > 1) + 1)
            at = code_points(data, [x for r in runs for x in (starts[r[0]], ends[r[-1]])])
            out.append([{"start": a, "stop": b} for a, b in zip(at[::2], at[1::2])])
        return pd.Series(out)

    words = F.size(F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOW),
                                        F.lit(WORD), F.lit(0))).cast("long")
    none = F.array().cast("array<string>")
    joined = docs.withColumn("_key", key).join(met.withColumnRenamed("key", "_key"), "_key", "left")
    return (joined.withColumn("_spans", spans_of(text, "hit_words"))
            .select(*docs.columns, F.struct(
                F.coalesce("n_words", words).alias("n_words"),
                F.when(F.col("hit_words").isNull(), 0).otherwise(F.size("hit_words"))
                .cast("long").alias("n_hit"),
                F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
                F.coalesce("items", none).alias("items"),
                F.coalesce("hit_words", none.cast("array<int>")).alias("hit_words"),
                F.col("_spans").alias("spans")).cast(FOUND).alias(into)))


def remove_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                    most_coverage: float = MOST_COVERAGE, text: str = "text", **options) -> DataFrame:
    """docs without the matched spans, and without documents mostly made of them.

    A document whose hit words are more than `most_coverage` of its words goes; of others
    every span of at least one whole window is cut out. Documents without hits stay as they are.
    """
    found = overlaps(docs, items, window, text, into="_overlap", **options)
    spans, hit = F.col("_overlap.spans"), F.col("_overlap.n_hit")
    # What stands before each span and behind the last one.
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substr(
        F.col(text), F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0)) + 1,
        F.coalesce(F.get(spans, i)["start"], F.length(text)) - F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))))
    return (found.where(hit <= most_coverage * F.col("_overlap.n_words"))
            .withColumn(text, F.when(hit > 0, F.array_join(kept, "")).otherwise(F.col(text)))
            .select(*docs.columns))


def digest(found: DataFrame, into: str = "overlap") -> DataFrame:
    """The columns n_words, n_hit, n_items, items_sha256, contaminated of overlaps()."""
    o = F.col(into)
    return (found.withColumn("n_words", o["n_words"]).withColumn("n_hit", o["n_hit"])
            .withColumn("n_items", F.size(o["items"]).cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(o["items"], ","), 256))
            .withColumn("contaminated", o["n_hit"] > 0))
