"""Alignment of two tokenizers over the bytes of a text.

Character offsets of the byte-level BPE (A) and the spans of the sentencepiece result (B)
are coarse cuts: they hold wherever a token ends between two characters. Tokens that end
inside a character, which A splits into parts of its bytes and B into byte-fallback pieces,
are refined with the decoded bytes of their entries. Where tokens of both end, a group ends;
two tokens whose byte ranges overlap are linked.

A space between two characters that are not white space begins a token of both
vocabularies, so a text is cut there and each distinct piece (a word) is aligned once.
Texts are aligned in slices of bounded size. A slice keeps the words of its texts as
numbers and sends each of its id pairs once with the number of its documents. Spark adds
these up over the corpus and sends a slice the totals of its own pairs only: no table of
all pairs reaches a task or the driver.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices
from .storage import saved

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 8 << 20
JOINED_CHARS = 8_000
MOST_WORDS = 300_000  # that a worker remembers from one slice to the next

#: White space of either tokenizer's rules, and what some versions count as such.
SPACES = r"\s\u180e\u200b\ufeff"
CUT = re.compile(rf"(?<=[^{SPACES}]) (?=[^{SPACES}])")
SPACE = re.compile(rf"[{SPACES}]")
ALL_SPACES = [c for c in map(chr, range(0x10000)) if SPACE.match(c)]
NONE = hashlib.sha256(b"").hexdigest()

_pairs: dict[str, TokenizerPair] = {}
_lexicons: dict[str, Lexicon] = {}


def words_of(text: str) -> list[str]:
    """The pieces between the spaces that no white space stands next to."""
    if " " in (text[0], text[-1]) or any(c in text and (f" {c}" in text or f"{c} " in text) for c in ALL_SPACES):
        return CUT.split(text)
    return text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level entries write each byte with: printable ones stand for
    themselves, the others for the code points from 256 up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_places(text: str) -> np.ndarray:
    """Where each character of a text begins in its UTF-8 bytes, and where the last ends."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(sizes)])


@dataclass(frozen=True)
class Aligned:
    """Tokens of both over one text, and the byte offsets where they end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def cuts(self) -> np.ndarray:
        """Offsets where tokens of both end."""
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, token of A and token of B of every overlap: one for each stretch without an end inside."""
        ends = np.union1d(self.a_ends, self.b_ends)
        return ends, np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)


class TokenizerPair:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{A_FILE}")
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        alphabet, size = byte_alphabet(), self.b.get_piece_size()
        entries = {i: bytes(alphabet.get(c, 0x20) for c in token)
                   for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_texts = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.a_bytes))], object)
        self.b_texts = np.array([f"{i}{end}" for end in ",;" for i in range(size)], object)

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """Each text behind one space; None where the bytes of its tokens are not those of the text."""
        spaced = [" " + t for t in texts]
        out: list[Aligned | None] = []
        for text, x, y in zip(spaced, self.a.encode_batch(spaced, add_special_tokens=False),
                              self.b.encode(texts, return_type="proto", num_threads=1), strict=True):
            n, raw = len(x), text.encode()
            a = np.fromiter(x.ids, np.int64, n)
            spans = np.fromiter(itertools.chain.from_iterable(x.offsets), np.int64, 2 * n).reshape(-1, 2)
            found = np.array([(p.id, p.end) for p in y.pieces], np.int64).reshape(-1, 2)
            b = found[:, 0]
            if (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw
                    or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw):
                out.append(None)
                continue
            # Coarse cuts, then the exact ends of tokens that stop inside a character.
            a_ends = byte_places(text)[spans[:, 1]]
            inside = np.append(spans[:-1, 1] > spans[1:, 0], False)
            a_ends[inside] = np.cumsum(self.a_sizes[a])[inside]
            b_ends = found[:, 1] + 1
            inside = np.diff(found[:, 1], prepend=0) == 0  # an empty span: a byte before the last of its character
            b_ends[inside] = np.cumsum(self.b_sizes[b])[inside]
            out.append(Aligned(a, b, a_ends, b_ends))
        return out

    def pieces(self, x: Aligned) -> list[str]:
        """The decimal ids of all groups in order, each with the sign that follows it."""
        cuts = x.cuts()
        group_a, group_b = np.searchsorted(cuts, x.a_ends), np.searchsorted(cuts, x.b_ends)
        last_a, last_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        texts = np.concatenate([self.a_texts[x.a + last_a * len(self.a_bytes)],
                                self.b_texts[x.b + last_b * len(self.b_bytes)]])
        return texts[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()


def tokenizer_pair(folder: str | None) -> TokenizerPair:
    if folder is None:
        import public_tokenizers
        folder = os.path.dirname(public_tokenizers.path(A_FILE))
    if folder not in _pairs:
        _pairs[folder] = TokenizerPair(folder)
    return _pairs[folder]


class Numbers(dict):
    """A number for every word, given when it is first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Lexicon:
    """Every word met so far: its counts, its groups as text, its links; arrays over word numbers."""

    def __init__(self, pair: TokenizerPair):
        self.pair, self.numbers = pair, Numbers()
        self.groups: list[str] = []
        self.uses = array.array("q")  # slices that held the word
        self.counts, self.pairs = array.array("q"), array.array("q")  # four counts a word; links in turn

    def learn(self) -> None:
        """Align the words that have a number but nothing else yet."""
        new, self.numbers.new = self.numbers.new, []
        for words in self.joined(new):
            self.add(words)

    @staticmethod
    def joined(words: list[str]):
        """Runs of words in order that may be encoded as one text, cut at its spaces again."""
        run, size = [], 0
        for w in words:
            alone = bool(SPACE.match(w) or SPACE.match(w[-1]))
            if run and (alone or size + len(w) > JOINED_CHARS):
                yield run
                run, size = [], 0
            run.append(w)
            size += len(w)
            if alone:
                yield run
                run, size = [], 0
        if run:
            yield run

    def add(self, words: list[str]) -> None:
        aligned, = self.pair.align([" ".join(words)])
        if aligned is None:
            if len(words) > 1:
                for w in words:
                    self.add([w])
            else:
                self.groups.append("")
                self.uses.append(0)
                self.counts.extend((-1, 0, 0, 0))
            return
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = aligned.cuts()
        if not np.isin(stops, cuts).all():
            raise ValueError("a word does not end where tokens of both end")
        ends, i, j = aligned.links()
        counts = np.stack([np.diff(np.searchsorted(x, stops, "right"), prepend=0)
                           for x in (aligned.a_ends, aligned.b_ends, cuts, ends)], 1)
        self.counts.frombytes(counts.astype(np.int64).tobytes())
        self.pairs.frombytes((aligned.a[i] << 32 | aligned.b[j]).tobytes())
        pieces, at = self.pair.pieces(aligned), 0
        for n in (counts[:, 0] + counts[:, 1]).tolist():
            self.groups.append("".join(pieces[at:at + n])[:-1])
            self.uses.append(0)
            at += n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts by word, the end of each word's links, all links."""
        counts = np.array(self.counts, np.int64).reshape(-1, 4)
        return counts, np.cumsum(counts[:, 3]), np.array(self.pairs, np.int64)


    def shrink(self, most: int) -> None:
        """Forget, when there are more than `most` words, all but the half of that used most often."""
        if len(self.groups) <= most:
            return
        counts, stops, pairs = self.arrays()
        uses = np.array(self.uses, np.int64)
        keep = np.flatnonzero(uses > 1)
        keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[:most // 2]])
        words = list(self.numbers)
        self.numbers = Numbers()
        self.numbers.update((words[i], n) for n, i in enumerate(keep.tolist()))
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.uses = array.array("q", uses[keep].tobytes())
        self.pairs = array.array("q", pairs[runs(stops[keep], counts[keep, 3])].tobytes())
        self.counts = array.array("q", counts[keep].tobytes())


def lexicon_of(pair: TokenizerPair, folder: str | None) -> Lexicon:
    """A worker's own, kept from task to task; what it gives for a word never changes."""
    return _lexicons.setdefault(folder or "", Lexicon(pair))


def runs(stops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places stop - size to stop, one run after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(stops - total, sizes)


FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
          ("groups_sha256", pa.string()), ("words", pa.list_(pa.int32())), ("link_stops", pa.list_(pa.int32())),
          ("link_pairs", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
DDL = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words array<int>, "
       "link_stops array<int>, link_pairs array<int>, pairs array<long>, docs array<int>")


def slice_columns(texts: list[str], lexicon: Lexicon) -> list[list]:
    """The columns of FIELDS for the texts of a slice, and a last row for the slice itself."""
    codes = [np.fromiter(map(lexicon.numbers.__getitem__, words := words_of(t)), np.int64, len(words)) if t
             else np.zeros(0, np.int64) for t in texts]
    lexicon.learn()
    counts, stops, pairs = lexicon.arrays()
    codes = [c if (counts[c, 0] >= 0).all() else c[:0] for c in codes]
    used = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
    np.frombuffer(lexicon.uses, np.int64)[used] += 1
    sizes = counts[used, 3]
    own, link_pairs = np.unique(pairs[runs(stops[used], sizes)], return_inverse=True)
    link_stops, docs = np.cumsum(sizes), np.zeros(len(own), np.int32)
    rows = []
    for c in codes:
        words = np.searchsorted(used, c)
        once = np.unique(words)
        docs[np.unique(link_pairs[runs(link_stops[once], sizes[once])])] += 1
        text = ";".join(map(lexicon.groups.__getitem__, c.tolist()))
        rows.append((*counts[c].sum(0).tolist(), hashlib.sha256(text.encode()).hexdigest() if len(c) else "",
                     words.astype(np.int32), None, None, None, None))
    rows.append((0, 0, 0, 0, "", None, link_stops.astype(np.int32), link_pairs.astype(np.int32), own, docs))
    return list(zip(*rows, strict=True))


def sliced(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """slice, doc_id and DDL: a row for each document and one, with its pairs, for each slice."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        pair = tokenizer_pair(vocabulary)
        lexicon, number = lexicon_of(pair, vocabulary), itertools.count(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, "text", SLICE_BYTES):
            lexicon.shrink(MOST_WORDS)
            columns = slice_columns(pc.fill_null(batch.column("text"), "").to_pylist(), lexicon)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(number)] * (batch.num_rows + 1), pa.int64()),
                 pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                 *[pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)]],
                names=["slice", "doc_id", *[n for n, _ in FIELDS]])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"slice long, doc_id {kind}, {DDL}")


@dataclass(frozen=True)
class Alignment:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    pairs: a, b, count (documents that hold the pair linked), best (none of the A id has more)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> Alignment:
    """Align all texts and count id pairs over the corpus.

    A text that is null, empty, or not spelled by the tokens of both has no tokens: zeros,
    and '' for groups_sha256. Repeated rows are documents of their own; a null doc_id
    stays; other columns are ignored; an empty table gives empty tables. A text is never
    cut across slices, so a very long one is a slice of its own. `vocabulary` is the folder
    of the tokenizer files.
    """
    rows = saved(sliced(docs, vocabulary, doc_id, text), "aligned")
    lists = (rows.where("pairs IS NOT NULL")
             .select("slice", F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
             .select("slice", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n")))
    counts = lists.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    pairs = saved(counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")
    totals = lists.select(F.col("slice").alias("of"), "pair").join(pairs, "pair").select("of", "pair", "count", "best")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        is_doc = pc.is_null(left.column("pairs"))
        docs, own = left.filter(is_doc), left.filter(pc.invert(is_doc))
        pair, count = right.column("pair").to_numpy(), right.column("count").to_numpy()
        best = right.column("best").combine_chunks().cast(pa.int64()).to_numpy() if len(right) else count
        order = np.argsort(pair)
        if own.num_rows and len(pair):
            stops, at = (own.column(c).combine_chunks().flatten().to_numpy() for c in ("link_stops", "link_pairs"))
            weights = np.stack([best[order][at], count[order][at]], 1)
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(weights, 0)])
            by_word = sums[stops] - sums[np.concatenate([[0], stops[:-1]])]
        else:
            by_word = np.zeros((0, 2), np.int64)
        words = docs.column("words").combine_chunks()
        flat, ends = words.flatten().to_numpy(), np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(by_word[flat], 0)])
        sums = total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros((0, 2), np.int64)
        return pa.table({**{c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                         "n_best": sums[:, 0], "count_sum": sums[:, 1], "groups_sha256": docs.column("groups_sha256")})

    kind = dict(docs.dtypes)[doc_id]
    documents = (rows.drop("docs").groupBy("slice").cogroup(totals.groupBy("of"))
                 .applyInArrow(weigh, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                      "n_best long, count_sum long, groups_sha256 string"))
    return Alignment(documents, pairs.select(
        F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), F.shiftright("pair", 32).alias("a"), "count", "best"))


def token_groups(docs: DataFrame, into: str = "groups", vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """docs with an array `into` of (start, stop, a, b): bytes of space + text, and the ids of both.

    A text without tokens, as in align(), has an empty array; a column named like `into` is replaced.
    """
    docs = docs.drop(into)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())),
                               ("b", pa.list_(pa.int32()))]))

    def groups(x: Aligned | None) -> list[dict]:
        if x is None:
            return []
        cuts = x.cuts()
        i, j = (np.searchsorted(ends, cuts, "right") for ends in (x.a_ends, x.b_ends))
        starts = [np.concatenate([[0], k[:-1]]) for k in (cuts, i, j)]
        return [{"start": s, "stop": e, "a": x.a[p:q], "b": x.b[r:t]} for s, e, p, q, r, t in
                zip(starts[0], cuts, starts[1], i, starts[2], j, strict=True)]

    def run(batches):
        pair = tokenizer_pair(vocabulary)
        for batch in slices(batches, text):
            texts = pc.fill_null(batch.column(text), "").to_pylist()
            found = [groups(pair.align([t])[0]) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(
        into, T._parse_datatype_string("array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"))]))
