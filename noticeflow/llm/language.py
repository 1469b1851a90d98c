"""Languages of a text as a mixture, by expectation-maximisation.

Each language has likelihoods of hashed character n-grams, counted over all training texts.
A text is cut into segments of neighbouring words; a segment is written in one language, and
the shares of the languages are found by expectation-maximisation over the segments. The set
of languages is chosen by penalised likelihood: languages leave the mixture as long as that
does not cost more than the penalty for keeping them. The largest share names the text.

Every language that is labelled is learned. Likelihoods take 2 MB for each in the driver and in
every worker, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, byte_set, mixed, slices, text_buffers
from .storage import saved

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 17
LANGUAGES_AT_ONCE = 16  # whose counts a task holds, and the driver collects, at one time
SEGMENT = 64
PENALTY = 2.0  # times log(segments) / 2 for each language kept
ROUNDS = 12
DISCOUNT = 0.25  # n-grams of one segment overlap: they count as so many independent ones
LETTERS = byte_set("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
UND = "und"


def ngrams(raw: np.ndarray, offs: np.ndarray):
    """Buckets of the n-grams that end at each letter; a run of other bytes is one space.

    Returns the bucket matrix (n-gram size, position) and the positions' rows.
    """
    low = LOWER[raw]
    letter = LETTERS[low]
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    first = np.zeros(len(raw), bool)
    first[offs[:-1][offs[1:] > offs[:-1]]] = True
    # Keep letters, and one space where a run of others begins inside a text.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]
    text = np.where(letter, low, 32)[keep].astype(np.uint64)
    row = rows[keep]
    n = len(text)
    start = np.append(True, row[1:] != row[:-1])[:n]
    grams, h = [], np.zeros(n, np.uint64)
    previous = np.full(n, 32, np.uint64)
    shifted = text
    inside = np.ones(n, bool)
    for k in SIZES:
        h = h * np.uint64(257) + shifted  # characters from the last to the k-th before it
        grams.append((mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                      & np.uint64(BUCKETS - 1)).astype(np.int32))
        inside = inside & ~start
        nxt = previous.copy()
        nxt[1:] = np.where(inside[1:], shifted[:-1], np.uint64(32))
        start = np.append(True, start[:-1])[:n]
        shifted = nxt
    return np.stack(grams) if n else np.zeros((len(SIZES), 0), np.int32), row


class Model:
    """languages and log likelihoods by (n-gram size * bucket, language)."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def segments(self, raw, offs):
        """Log likelihood of each segment and language; rows of the segments."""
        grams, row = ngrams(raw, offs)
        n = grams.shape[1]
        begin = np.searchsorted(row, np.arange(len(offs) - 1))
        within = np.arange(n) - begin[row]
        new = np.append(True, (row[1:] != row[:-1]) | (within[1:] % SEGMENT == 0))[:n]
        cut = np.flatnonzero(new)
        out = np.zeros((len(cut), len(self.languages)))
        for size, bucket in enumerate(grams):
            part = self.table[size * BUCKETS + bucket]
            out += np.add.reduceat(part, cut, 0) if n else 0
        return out * DISCOUNT, row[cut]

    def shares(self, raw, offs):
        """Share of each language in each row; rows without letters have none."""
        like, row = self.segments(raw, offs)
        n, k = len(offs) - 1, len(self.languages)
        found = np.zeros((n, k))
        if not len(row):
            return found
        cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        which, count = row[cut], np.diff(np.append(cut, len(row)))
        top = like.max(1, keepdims=True)
        scaled = np.exp(like - top)
        owner = np.repeat(np.arange(len(cut)), count)

        def run(share):
            for _ in range(ROUNDS):
                joint = scaled * share[owner]
                total = joint.sum(1, keepdims=True)
                share = np.add.reduceat(joint / np.maximum(total, 1e-300), cut, 0) / count[:, None]
            total = (scaled * share[owner]).sum(1)
            return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), cut)

        share, best = run(np.full((len(cut), k), 1.0 / k))
        cost = 0.5 * PENALTY * np.log(count + 1.0)
        # A language that explains less than a quarter of a segment is worth less than its cost.
        kept = (share * count[:, None] >= 0.25) | (share == share.max(1, keepdims=True))
        if not kept.all():
            share, best = run(share * kept / (share * kept).sum(1, keepdims=True))
        for _ in range(k - 1):  # drop the smallest language wherever that pays
            live = kept.sum(1)
            if not (live > 1).any():
                break
            least = np.where(kept, share, np.inf).argmin(1)
            trial = kept.copy()
            trial[np.arange(len(cut)), least] = live <= 1
            begin = share * trial + 1e-6 * trial
            new, value = run(begin / begin.sum(1, keepdims=True))
            better = (live > 1) & (value + cost >= best)
            if not better.any():
                break
            share[better], kept[better], best[better] = new[better], trial[better], value[better]
        found[which] = share
        return found


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """Likelihoods from all rows with a text and a language.

    A task adds up its own counts, of `LANGUAGES_AT_ONCE` languages before it sends them on; the
    driver collects BUCKETS counts for each n-gram size of so many languages at a time.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(
        F.col(text).alias("text"), F.col(language).alias("lang"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # one row a language
    code = {name: i for i, name in enumerate(names)}
    width = len(SIZES) * BUCKETS

    def run(batches):
        counts: dict[int, np.ndarray] = {}

        def sent():
            for i, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(c[at])],
                    names=["lang", "gram", "n"])
            counts.clear()

        for batch in slices(batches, "text"):
            lang = np.array([code[x] for x in batch.column("lang").to_pylist()])
            grams, row = ngrams(*text_buffers(batch.column("text")))
            for i in np.unique(lang):
                if i not in counts and len(counts) >= LANGUAGES_AT_ONCE:
                    yield from sent()
                mine = lang[row] == i
                for size, bucket in enumerate(grams):
                    part = counts.setdefault(i, np.zeros(width, np.int64))[size * BUCKETS:(size + 1) * BUCKETS]
                    part += np.bincount(bucket[mine], minlength=BUCKETS)
        yield from sent()

    table = np.zeros((width, len(names)), np.float32)
    common = np.zeros(width)
    if names:
        found = (known.mapInArrow(run, "lang int, gram long, n long").groupBy("lang", "gram")
                 .agg(F.sum("n").alias("n")))
        if len(names) > LANGUAGES_AT_ONCE:
            found = saved(found, "language-counts")
        for begin in range(0, len(names), LANGUAGES_AT_ONCE):
            part = found if len(names) <= LANGUAGES_AT_ONCE else found.where(
                F.col("lang").between(begin, begin + LANGUAGES_AT_ONCE - 1))
            part = part.toArrow()
            gram, n = part.column("gram").to_numpy(), part.column("n").to_numpy()
            table[gram, part.column("lang").to_numpy()] = n
            common += np.bincount(gram, weights=n, minlength=width)
    # Smoothed with the likelihoods of all languages together, so unseen n-grams decide little.
    for size in range(len(SIZES)):
        rows = slice(size * BUCKETS, (size + 1) * BUCKETS)
        shared = (common[rows] + 0.01) / (common[rows].sum() + 0.01 * BUCKETS)
        for i in range(len(names)):
            one = table[rows, i] + 20.0 * shared
            table[rows, i] = np.log(one / one.sum())
    return Model(names, table)


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "lang_pred",
             score: str = "score", mixture: str = "mixture") -> DataFrame:
    """docs with the main language, its share as a score, and a map of all languages kept.

    A null text, or one without a letter, is "und" with score 0 and no mixture, and so is
    every text if nothing was learned. Equal shares go to the language that sorts first.
    Input columns of these names are replaced.
    """
    docs = docs.drop(into, score, mixture)
    position = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each n-gram size

    def run(batches):
        model = shared.value
        for batch in slices(batches, text, 1 << 19):
            column = batch.column(position)
            raw, offs = text_buffers(column)
            letter = [any(c.isalpha() for c in t) if t else False for t in column.to_pylist()]
            names, scores, maps = [UND] * batch.num_rows, np.zeros(batch.num_rows), [[]] * batch.num_rows
            if model.languages:
                share = model.shares(raw, offs)
                best = share.argmax(1)
                for i, b in enumerate(best.tolist()):
                    if letter[i] and share[i, b] > 0:
                        names[i], scores[i] = model.languages[b], min(1.0, share[i, b])
                        maps[i] = [(model.languages[j], float(share[i, j])) for j in np.flatnonzero(share[i] > 1e-3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names), pa.array(scores),
                 pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=[*batch.schema.names, into, score, mixture])

    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField(into, T.StringType()), T.StructField(score, T.DoubleType()),
        T.StructField(mixture, T.MapType(T.StringType(), T.DoubleType()))]))
