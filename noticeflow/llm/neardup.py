"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A text is the multiset of its runs of five words. Every shingle owns Poisson processes, one
for each dyadic range of weights [0, 1), [1, 2), [2, 4), ...; a shingle that occurs w times
takes part with the points below w. The earliest point in each register is the signature:
two texts agree in a register with probability sum(min) / sum(max), their weighted Jaccard
similarity. Points are drawn in order of time only until all registers are filled, so their
number per text depends on the registers, not on the length.

Bands of registers propose pairs, and every link is verified on the whole multisets. Equal
texts are one node. In a round every bucket has one representative, and its nodes are
compared with it; buckets whose nodes are then connected are done, so the pairs of a round
are at most the rows of the buckets. The first round takes the first few bands alone: they
connect most of a family, and the buckets of its other bands are then done unseen. The next
takes all bands that are left. After the rounds, nodes outside the largest class of
their bucket are compared with all nodes of other classes there, each pair in one of the
buckets it shares, so no link is lost. Pairs are made only if the similarity is possible: by
their lengths and by parities of their shingles, two bounds that no linked pair breaks.
Classes are connected components over stored tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, WORD_BYTES, mixed, slices, span_hashes, text_buffers, word_bounds
from .storage import saved

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5  # a pair at 0.8 shares no band once in 300,000
ROUNDS = 3
FIRST_BANDS = 4
PARITY_BITS = 1024
SLICE_BYTES = 1 << 20
U64 = np.uint64


def shingles(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE):
    """Row, hash and count of every distinct run of `size` lower-case words, in order of row.

    A text of fewer words, but not none, is one run.
    """
    raw = LOWER[raw]
    starts, ends, rows = word_bounds(raw, offs, WORD_BYTES)
    words = span_hashes(raw, starts, ends)
    n = len(words)
    per_row = np.bincount(rows, minlength=len(offs) - 1)
    left = np.cumsum(per_row)[rows] - np.arange(n)  # words from here to the end of the row
    h = np.zeros(n, U64)
    for j in range(size):
        factor = mixed(np.array([j + 1], U64))[0] | U64(1)
        part = np.zeros(n, U64)
        part[:max(0, n - j)] = words[j:] * factor
        h += np.where(left > j, part, U64(0))
    at = np.flatnonzero((left >= size) | (left == per_row[rows]))
    h, rows = mixed(h[at]), rows[at]
    key = mixed(h + rows.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    count = np.diff(np.append(new, len(key)))
    first = order[new]
    by_row = np.argsort(rows[first], kind="stable")
    return rows[first][by_row], h[first][by_row], count[by_row]


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(rows, hashes, counts, n: int, registers: int) -> np.ndarray:
    """The earliest point of each row in each register; inf where a row has no shingle."""
    out = np.full(n * registers, np.inf)
    total = np.bincount(rows, counts, n)
    owner, source, rate, floor, limit = [], [], [], [], []
    level = 0
    while True:  # the dyadic ranges of weights that reach below a shingle's count
        low = 0 if level == 0 else 1 << (level - 1)
        pick = np.flatnonzero(counts > low)
        if not len(pick):
            break
        owner.append(rows[pick])
        source.append(mixed(hashes[pick] + U64(level)))
        rate.append(np.full(len(pick), float(max(1, low))))
        floor.append(np.full(len(pick), float(low)))
        limit.append(counts[pick].astype(np.float64))
        level += 1
    if not owner:
        return out.reshape(n, registers)
    owner, source, rate, floor, limit = map(np.concatenate, (owner, source, rate, floor, limit))
    horizon = (np.log(registers) + 3.0) / np.maximum(total, 1)
    pending = np.ones(n, bool)
    while True:
        live = np.flatnonzero(pending[owner])
        o, s, r, f, w = owner[live], source[live], rate[live], floor[live], limit[live]
        end = horizon[o]
        t = np.zeros(len(live))
        drawn, block = 0, 1
        while len(o):
            # Later points of a process do not depend on how many rows still need them.
            step = mixed(s[:, None] + U64(0xD1342543DE82EF95) * np.arange(drawn, drawn + block).astype(U64))
            times = -np.log(uniform(step)) / (registers * r[:, None])
            times[:, 0] += t
            times = np.cumsum(times, 1)
            where = mixed(step + U64(1))
            good = times <= end[:, None]
            partial = np.flatnonzero(w < f + r)
            if len(partial):
                good[partial] &= (f[partial, None] + np.floor(uniform(mixed(where[partial]))
                                                              * r[partial, None]) < w[partial, None])
            a, b = np.nonzero(good)
            slot = o[a] * registers + (where[a, b] % U64(registers)).astype(np.int64)
            np.minimum.at(out, slot, times[a, b])
            t = times[:, -1]
            more = t < end
            o, s, r, f, w, end, t = o[more], s[more], r[more], f[more], w[more], end[more], t[more]
            drawn += block
            block = min(64, 2 * block)
        pending = (total > 0) & np.isinf(out.reshape(n, registers)).any(1)
        if not pending.any():
            return out.reshape(n, registers)
        horizon = np.where(pending, horizon * 2, horizon)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature[:, :bands * rows].copy().view(U64).reshape(len(signature), bands, rows)
    h = np.arange(1, bands + 1, dtype=U64)[None, :].repeat(len(signature), 0)
    for j in range(rows):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return h.view(np.int64)


def long_lists(table: np.ndarray) -> pa.Array:
    n, width = table.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, max(1, width), dtype=np.int32)[:n + 1],
                                    pa.array(table.reshape(-1)))


def parities(rows, hashes, counts, n: int) -> np.ndarray:
    """For each row the parity of its shingles, copies told apart, in each of PARITY_BITS slots.

    Where two rows differ there is a shingle that only one of them has, so the slots that
    differ are never more than the shingles that do.
    """
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    h = mixed(np.repeat(hashes, counts) + copy.astype(U64) * U64(0xD1342543DE82EF95))
    slot = np.repeat(rows, counts) * PARITY_BITS + (h % U64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, PARITY_BITS // 64)


def node_of(text: str):
    return F.unhex(F.md5(F.col(text)))


def sketch(docs: DataFrame, text: str = "text", size: int = SHINGLE, bands: int = BANDS,
           rows: int = ROWS) -> DataFrame:
    """node, n (shingles), bands (hashes) and parity of every text that has a word."""
    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            row, h, count = shingles(*text_buffers(batch.column("text")), size)
            n = np.bincount(row, count, batch.num_rows).astype(np.int64)
            sig = signatures(row, h, count, batch.num_rows, bands * rows)
            keep = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(keep)), pa.array(n[keep]),
                 long_lists(band_hashes(sig[keep], bands, rows)),
                 long_lists(parities(row, h, count, batch.num_rows)[keep])],
                names=["node", "n", "bands", "parity"])

    return (docs.where(F.col(text).isNotNull()).select(node_of(text).alias("node"), F.col(text).alias("text"))
            .mapInArrow(run, "node binary, n long, bands array<long>, parity array<long>"))


def overlap(a: pa.Array, b: pa.Array, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of the multisets of two columns of texts."""
    n = len(a)
    ra, ha, ca = shingles(*text_buffers(a), size)
    rb, hb, cb = shingles(*text_buffers(b), size)
    odd = U64(0x9E3779B97F4A7C15)
    ka, kb = mixed(ha + ra.astype(U64) * odd), mixed(hb + rb.astype(U64) * odd)
    order = np.argsort(kb)
    kb, cb_sorted = kb[order], cb[order]
    at = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
    both = np.minimum(ca, np.where(kb[at] == ka, cb_sorted[at], 0)) if len(kb) else np.zeros(len(ka))
    common = np.bincount(ra, both, n)
    total = np.bincount(ra, ca, n) + np.bincount(rb, cb, n)
    return common / np.maximum(total - common, 1)


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar. `texts` has each node once."""
    def run(batches):
        for big in batches:
            for batch in slices(iter([big]), "text_a", SLICE_BYTES):
                good = overlap(batch.column("text_a"), batch.column("text_b"), size) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    side = {x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"}
    return (pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (a, b).

    Large-star and small-star rounds over stored tables: each hangs neighbours on the least
    node seen, until nothing moves. A star's centre may have any number of neighbours: its
    minimum is aggregated before the shuffle and the join back is split if it is skewed.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))

    links = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a != b").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return (links.select(F.col("a").alias("node"), F.col("b").alias("label"))
                    .union(links.select("b", "b")).distinct())
        before = state
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(least(both), "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        small = large.join(least(large), "a")
        links = saved(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b")
                      .where("a != b").distinct(), "links")


def odd_slots(parity: list[str]):
    return F.expr(" + ".join(f"bit_count({p} ^ {p}_b)" for p in parity))


def apart_pairs(rest: DataFrame, side: list, alike) -> DataFrame:
    """Rows of rest outside the largest class of their bucket with the rows of other classes there, as `side`.

    Two nodes may meet in many buckets: they are paired in the one of the least key, in one order.
    """
    size_of = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = size_of.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    keys = rest.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most one for each band
    here = saved(rest.join(main, "key").join(keys, "node"), "apart")
    rep = here.where("label != main").select("key", *side, F.col("keys").alias("keys_b"))
    once = (((F.col("label") == F.col("main")) | (F.col("node") < F.col("node_b")))
            & (F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key")))
    return here.join(rep, "key").where((F.col("label") != F.col("label_b")) & alike & once)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
            least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
            rounds: int = ROUNDS, first_bands: int = FIRST_BANDS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links of every row of docs.

    Two texts are linked if they are equal or their multisets of shingles have a weighted
    Jaccard similarity of at least `least`; a class is what links connect. `n_links` counts
    the verified links of a text to other texts: not all links within a class are looked
    for. A text without words is linked to equal texts only; a null text is a class of its
    own. Repeated rows are returned as often as they occur. A null doc_id names no class
    unless all ids of the class are null.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parity = [f"p{i}" for i in range(PARITY_BITS // 64)]
    drawn = saved(sketch(docs, "text", size, bands, rows), "sketch").dropDuplicates(["node"])
    buckets = saved(drawn.select("node", F.posexplode("bands").alias("band", "key")), "buckets")
    # Keys that occur once cannot link: they go before anything is joined.
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = saved(buckets.join(shared, "key", "left_semi")
                .join(drawn.select("node", "n", *[F.get("parity", F.lit(i)).alias(p) for i, p in enumerate(parity)]),
                      "node"), "met")
    alike = ((F.least("n", "n_b") >= least * F.greatest("n", "n_b"))
             & (odd_slots(parity) <= (F.col("n") + F.col("n_b")) * ((1 - least) / (1 + least)) + 1e-6))
    side = [F.col(c).alias(f"{c}_b") for c in ("node", "n", *parity, "label")]
    ordered = [F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")]
    # Whole texts move once; hints keep their joins alike at every size.
    texts = saved(docs.where(F.col("text").isNotNull()).select(node_of("text").alias("node"), "text")
                  .dropDuplicates(["node"])
                  .join(met.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), "texts")

    def verify(pairs):
        wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
        few = saved(texts.join(wanted.hint("shuffle_hash"), "node", "left_semi"), "texts")
        return saved(verified(pairs, few, size, least), "verified")

    links = checked = label = None
    rest = met.withColumn("label", F.col("node"))
    for turn in range(rounds + 1):
        if turn < rounds:
            # One representative for each bucket, another one each round.
            here = rest.where(F.col("band") < first_bands) if turn == 0 and rounds > 1 else rest
            rep = (here.groupBy("key").agg(F.min(F.struct(
                F.xxhash64("node", F.lit(turn)).alias("h"), *side)).alias("rep")).select("key", "rep.*"))
            pairs = (here.join(rep, "key").where((F.col("label") != F.col("label_b")) & alike)
                     .select(*ordered).distinct())
        else:
            pairs = apart_pairs(rest, side, alike).select(*ordered)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        checked = pairs if checked is None else checked.union(pairs)
        new = verify(pairs)
        links = new if links is None else links.union(new)
        label = components(links)
        if turn < rounds:
            named = (rest.drop("label").join(label, "node", "left")
                     .withColumn("label", F.coalesce("label", "node")))
            named = saved(named, "named")
            # Two nodes that were compared are done; bands not seen yet stay.
            unseen = F.col("band") >= (first_bands if turn == 0 and rounds > 1 else bands)
            open_keys = (named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"),
                                                  F.count(F.lit(1)).alias("c"), F.max(unseen).alias("unseen"))
                         .where("x != y and (c > 2 or unseen)").select("key"))
            rest = saved(named.join(open_keys, "key", "left_semi"), "rest")
    degree = links.select("a").union(links.select("b")).groupBy("a").count().toDF("node", "n_links")
    node = docs.select("doc_id", node_of("text").alias("node"))
    named = (node.where("node is not null").join(label, "node", "left").join(degree, "node", "left")
             .select("doc_id", F.coalesce("label", "node").alias("label"),
                     F.coalesce("n_links", F.lit(0)).alias("n_links")))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    out = named.join(ids, "label").select("doc_id", "class_id", "n_links")
    return out.union(node.where("node is null").select("doc_id", "doc_id", F.lit(0).cast("long")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each class: the one with the least doc_id.

    Of repeated rows one stays. Rows with a null doc_id stay, as they cannot be told apart.
    """
    found = classes(docs.where(F.col(doc_id).isNotNull()), doc_id, text, **options)
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return (docs.join(kept, doc_id, "left_semi").dropDuplicates([doc_id])
            .unionByName(docs.where(F.col(doc_id).isNull())).select(*docs.columns))
