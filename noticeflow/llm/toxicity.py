"""Toxicity by multiple-instance learning.

A document is toxic if one of its sentences is: with p(s) for a sentence, the document has
1 - prod(1 - p(s)) (noisy-or). Only documents are labelled; the gradient of the document
likelihood reaches the sentences, so the same weights score documents and point at
sentences. Features are hashed words and hashed beginnings of words.

Fitting uses a bounded sample: at most `most_labelled` documents of each label, those with
the least hashes of their ids. Frequencies of features are counted by Spark; the driver gets
the best `features` of them and, for the sample, only the sentences that hold one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, WORD_BYTES, byte_set, slices, span_hashes, text_buffers, word_bounds
from .decontamination import code_points
from .storage import saved

MOST_LABELLED = 6_000
FEATURES = 3_000
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 8)
STOPS = byte_set(".!?\n")
SPANS = "array<struct<start: int, stop: int, score: double>>"


def features_of(raw: np.ndarray, offs: np.ndarray):
    """(feature, sentence) pairs, row and byte bounds of each sentence that has a word."""
    starts, ends, rows = word_bounds(LOWER[raw], offs, WORD_BYTES)
    before = np.searchsorted(np.flatnonzero(STOPS[raw]), starts)
    new = (np.diff(before, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0)
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[:len(first)] - 1
    low = LOWER[raw]
    ids = [span_hashes(low, starts, ends)]
    ids += [span_hashes(low, starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in BEGINNINGS]
    feature = (np.concatenate(ids) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return feature, np.tile(sentence, len(ids)), rows[first], starts[first], ends[last]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


class NoisyOr:
    """Weights by bucket and a bias; fitted on sentences as rows of (doc, feature) entries."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = -20.0):
        self.weights = np.zeros(BUCKETS, np.float32) if weights is None else weights
        self.bias = bias

    def fit(self, labels, plain, doc_of, entry_sentence, entry_feature, kept, steps=250, rate=0.15,
            penalty=3e-4):
        """labels by document, plain: number of its sentences without entries, doc_of: document of
        each other sentence; entries give a sentence and an index into `kept` buckets. Adam."""
        n, m = len(labels), len(doc_of)
        w, b = np.zeros(len(kept)), -3.0
        state = np.zeros((2, len(kept) + 1))
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
        for t in range(1, steps + 1):
            z = b + np.bincount(entry_sentence, w[entry_feature], m)
            total = plain * softplus(np.float64(b)) + np.bincount(doc_of, softplus(z), n)
            # d loss / d total: 1 for label 0, -q / (1 - q) for label 1, where q = exp(-total).
            q = np.exp(-np.maximum(total, 1e-9))
            up = weight * np.where(labels == 1, -q / (1 - q), 1.0)
            gz = up[doc_of] / (1 + np.exp(-np.clip(z, -700, 700)))
            gb = gz.sum() + (up * plain).sum() / (1 + np.exp(-b))
            g = np.append(np.bincount(entry_feature, gz[entry_sentence], len(kept)) + penalty * w, gb)
            state[0] += 0.1 * (g - state[0])
            state[1] += 0.01 * (g * g - state[1])
            move = rate * state[0] / (1 - 0.9 ** t) / (np.sqrt(state[1] / (1 - 0.99 ** t)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        self.weights = np.zeros(BUCKETS, np.float32)
        self.weights[kept] = w
        self.bias = float(b)
        return self

    def score(self, raw, offs):
        """Score of each row, and (row, start, stop, score) of its sentences in bytes."""
        feature, sentence, row, start, stop = features_of(raw, offs)
        z = self.bias + np.bincount(sentence, self.weights[feature], len(row))
        total = np.bincount(row, softplus(z), len(offs) - 1)
        return -np.expm1(-total), (row, start, stop, 1 / (1 + np.exp(-np.clip(z, -700, 700))))


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label of at most `most` documents of each label."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              for y in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return (texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # at most 2 * most ids
            .select("doc_id", "text", "_y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_labelled: int = MOST_LABELLED,
        features: int = FEATURES) -> NoisyOr:
    """A model from labels(doc_id, label 0/1) and docs(doc_id, text).

    Null labels and texts are left out; a document labelled twice counts as toxic if any
    label says so. With no toxic or no other document the model scores everything 0.
    """
    train = saved(sample(docs, labels, label, most_labelled), "labelled")
    sizes = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return NoisyOr()

    def frequencies(batches):
        """Documents of each label that hold a feature; each task adds up its own first."""
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in slices(batches, "text"):
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            feature, sentence, row, *_ = features_of(*text_buffers(batch.column("text")))
            pair = np.unique((row[sentence].astype(np.int64) << 20) + feature)
            for v in (0, 1):
                counts[v] += np.bincount(pair[y[pair >> 20] == v] & (BUCKETS - 1),
                                         minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *map(pa.array, counts[:, at])],
                                         names=["bucket", "n0", "n1"])

    share = [(F.col(f"n{v}") + 0.5) / (sizes[v] + 1.0) for v in (0, 1)]
    # Documents set apart times how sharply: information of a feature about the label.
    gain = F.abs(share[1] - share[0]) * F.abs(F.log(share[1] / share[0]))
    best = (train.select("text", "_y").mapInArrow(frequencies, "bucket long, n0 int, n1 int")
            .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
            .where(F.col("n0") + F.col("n1") >= 3)
            .orderBy(gain.desc(), "bucket").limit(features).select("bucket"))
    kept = np.array(sorted(r["bucket"] for r in best.collect()), np.int64)
    index = np.full(BUCKETS, -1, np.int32)
    index[kept] = np.arange(len(kept))

    def sentences(batches):
        for batch in slices(batches, "text"):
            feature, sentence, row, *_ = features_of(*text_buffers(batch.column("text")))
            known = np.flatnonzero(index[feature] >= 0)
            known = known[np.argsort(sentence[known], kind="stable")]
            hits = [[] for _ in range(batch.num_rows)]
            at = sentence[known]
            for part in np.split(known, np.flatnonzero(np.diff(at)) + 1) if len(known) else []:
                hits[row[sentence[part[0]]]].append(index[feature[part]].tolist())
            plain = np.bincount(row, minlength=batch.num_rows) - [len(h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y"), pa.array(plain.astype(np.int64)),
                 pa.array(hits, pa.list_(pa.list_(pa.int32())))], names=["y", "plain", "hits"])

    rows = (train.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).select("text", "_y")
            .mapInArrow(sentences, "y int, plain long, hits array<array<int>>").toArrow())
    hits = rows.column("hits").combine_chunks()
    per_doc = np.diff(hits.offsets.to_numpy())
    inner = hits.flatten()
    per_sentence = np.diff(inner.offsets.to_numpy())
    return NoisyOr().fit(
        rows.column("y").to_numpy(), rows.column("plain").to_numpy(),
        np.repeat(np.arange(len(per_doc)), per_doc),
        np.repeat(np.arange(len(per_sentence)), per_sentence), inner.flatten().to_numpy(), kept)


def score(docs: DataFrame, model: NoisyOr, text: str = "text", into: str = "score",
          sentences: str | None = None, least: float = 0.5) -> DataFrame:
    """docs with the score of each whole text, and with the offending sentences if a column is named.

    A null text, or one without words, scores 0. Sentences are (start, stop, score) in code
    points, those that score `least` or more. Input columns of these names are replaced.
    """
    docs = docs.drop(into, *([sentences] if sentences else []))
    position = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS floats
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        own = NoisyOr(*shared.value)
        for batch in slices(batches, text):
            raw, offs = text_buffers(batch.column(position))
            scores, parts = own.score(raw, offs)
            columns, names = [pa.array(scores)], [into]
            if sentences:
                out = [[] for _ in range(batch.num_rows)]
                for r, a, b, p in zip(*(x[parts[3] >= least].tolist() for x in parts), strict=True):
                    o = int(offs[r])
                    a, b = code_points(raw[o:offs[r + 1]].tobytes(), [a - o, b - o])
                    out[r].append({"start": a, "stop": b, "score": p})
                columns, names = [*columns, pa.array(out, kind)], [*names, sentences]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    fields = [*docs.schema.fields, T.StructField(into, T.DoubleType())]
    if sentences:
        fields.append(T.StructField(sentences, T._parse_datatype_string(SPANS)))
    return docs.mapInArrow(run, T.StructType(fields))
