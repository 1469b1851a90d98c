"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations are grouped into weighted sequences with the list of their ids.
A sequence that is a proper prefix of another is found by an anti-join; the rest are the
leaves. Weighted prefixes of the distinct sequences are then aggregated into nodes.

A prefix is named by its depth and four running sums of 32 bits each, drawn from a hash of
(depth, digest of the turn): 128 bits that a window adds up, so a prefix is never built as
a text and no text is moved. Ordering, numbering and the sums run in blocks of a
conversation, so that one conversation may hold a large share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

BLOCK_TURNS = 4_096
BLOCK_IDS = 256
GROUP = 100
MOST_SHARED = 6
KEY = ("k1", "k2", "k3", "k4")
PARENT = ("p1", "p2", "p3", "p4")


def turn_digest(role: Column, text: Column) -> Column:
    """A 256-bit digest of a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, at (from 1), digest, chars: the turns of each conversation in order, stored.

    A null turn comes first; turns of one number are ordered by digest, so repeated rows
    stay and the order never depends on the input's. Rows without a conv_id belong to no
    conversation and are left out. Rows are dealt by ranges of (conv_id, turn, digest) and
    numbered within each range, so a conversation of any length is spread.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        turn_digest(F.col(role), F.col(text)).alias("digest"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars")).where("conv_id IS NOT NULL")
    dealt = saved(rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest")
                  .withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    return saved(dealt.withColumn("rank", F.row_number().over(within))
                 .join(before, ["conv_id", "part"])
                 .select("conv_id", (F.col("rank") + F.col("before")).alias("at"), "digest", "chars"), "order")


def rebuilt(turns: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their first turns: (turns with depth and last, conversations with length).

    Conversation c takes the first h turns of c - c % group, h = crc32(decimal c) % most,
    and then its own after the first h. A conversation may end up without turns; one whose
    base is absent borrows none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = (turns.groupBy("conv_id").agg(F.max("at").alias("own"))
             .withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}))
    heads = (turns.where((F.col("conv_id") % group == 0) & (F.col("at") < most))
             .groupBy(F.col("conv_id").alias("base"))  # at most `most` - 1 turns each
             .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("heads")))
    convs = saved(convs.join(heads, "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h"))
        .alias("borrowed"), "own").withColumn("b", F.size("borrowed"))
        .withColumn("length", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    taken = convs.select("conv_id", "length", F.posexplode("borrowed").alias("pos", "t")).select(
        "conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "t.digest", "t.chars", "length")
    kept = (turns.join(convs.select("conv_id", "h", "b", "length"), "conv_id").where("at > h")
            .select("conv_id", (F.col("at") - F.col("h") + F.col("b")).alias("depth"), "digest", "chars", "length"))
    rows = taken.unionByName(kept).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return rows, convs.select("conv_id", "length")


def running(df: DataFrame, by: str, at: str, sums: Sequence[str], down: bool = False,
            block: int = BLOCK_TURNS) -> DataFrame:
    """The columns `sums` replaced by their sums up to each row in the order of `at` within `by`.

    Sums run within blocks of `at`; the totals of earlier blocks are added by a join.
    """
    order = F.desc if down else F.asc
    df = df.withColumn("_block", F.expr(f"`{at}` div {block}"))
    within = Window.partitionBy(by, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(by, "_block").agg(*[F.sum(c).alias(c) for c in sums])
    before = totals.select(by, "_block", *[F.sum(c).over(earlier).alias(f"_{c}") for c in sums])
    return (df.withColumns({c: F.sum(c).over(within) for c in sums})
            .join(before.where(f"`_{sums[0]}` IS NOT NULL"), [by, "_block"], "left")
            .withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums})
            .drop("_block", *[f"_{c}" for c in sums]))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, last, chars with the key of the prefix that ends there and its parent's, stored."""
    a, b = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(7))
    low = F.lit(0xFFFFFFFF)
    own = {"k1": a.bitwiseAND(low), "k2": F.shiftrightunsigned(a, 32),
           "k3": b.bitwiseAND(low), "k4": F.shiftrightunsigned(b, 32)}
    rows = rows.withColumns(own)
    rows = rows.withColumns({p: F.col(k) for p, k in zip(PARENT, KEY, strict=True)}).drop("digest")
    rows = running(rows, "conv_id", "depth", KEY)
    return saved(rows.withColumns({p: F.col(k) - F.col(p) for p, k in zip(PARENT, KEY, strict=True)}), "prefixes")


def end_lists(ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by` and ends_sha256: the digest of the ascending decimal conv_ids, joined by commas.

    Ids are first joined in blocks of neighbouring ids; the blocks of a list then pass one
    after the other through the digest, which is never held as one text.
    """
    block = F.floor(F.col("conv_id") / BLOCK_IDS)
    parts = (ends.groupBy(*by, block.alias("block"))
             .agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
             .repartition(*by).sortWithinPartitions(*by, "block"))
    schema = ", ".join([*[f"{c} long" for c in by], "ends_sha256 string"])

    def run(batches):
        at, digest, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*by, "ids")], strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield table(out)
                out = []
        if at is not None:
            out.append((*at, digest.hexdigest()))
        yield table(out)

    def table(out):
        columns = list(zip(*out, strict=True)) or [()] * (len(by) + 1)
        kinds = [pa.int64()] * len(by) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=[*by, "ends_sha256"])

    return parts.mapInArrow(run, schema)


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct whole sequences, stored: depth, key, weight, conv_id (least of its members), leaf.

    `rows` is from prefixes(), `convs` holds every conversation with its length; those
    without turns are the empty sequence. leaf: no other sequence goes on from it.
    """
    empty = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"),
                                             *[F.lit(0).cast("long").alias(k) for k in KEY])
    ends = rows.where("last").select("conv_id", "depth", *KEY).unionByName(empty)
    whole = (ends.groupBy("depth", *KEY)
             .agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")))
    inner = (rows.select((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)])
             .distinct().withColumn("longer", F.lit(True)))
    leaves = whole.join(inner, ["depth", *KEY], "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    goes_on = whole.join(inner.drop("longer"), ["depth", *KEY], "left_semi").withColumn("leaf", F.lit(0).cast("long"))
    return saved(leaves.unionByName(goes_on), "sequences")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `rows` (conv_id, depth from 1 without gaps, last, digest, chars) and `convs` (conv_id,
    length) as rebuilt() gives them, or any other sequences of that form. Every node is a
    distinct prefix, the root included; an empty table has no nodes. A node is named by its
    least member; n_leaves counts the childless nodes below, itself included;
    saved_tokens adds (n_convs - 1) * chars over the nodes below, itself included.
    """
    rows = prefixes(rows)
    whole = sequences(rows, convs)
    zero = [F.lit(0).cast("long").alias(c) for c in (*KEY, *PARENT)]
    roots = whole.select("conv_id", "weight", "leaf", F.lit(0).cast("long").alias("depth"),
                         F.lit(0).cast("long").alias("chars"), *zero)
    paths = (whole.select("conv_id", "weight", "leaf").join(rows.drop("last"), "conv_id").unionByName(roots))
    paths = saved(paths, "paths")

    node = ["depth", *KEY]
    nodes = saved(paths.groupBy(*node).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"),
        F.max("chars").alias("chars"), *[F.max(p).alias(p) for p in PARENT]), "nodes")

    # What a node saves lies on the path of its least member; every path adds up what lies below.
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    laid = (paths.select("conv_id", *node).join(own, ["conv_id", "depth"], "left")
            .withColumn("own", F.coalesce("own", F.lit(0))))
    below = (running(laid, "conv_id", "depth", ["own"], down=True)
             .groupBy(*node).agg(F.sum("own").alias("saved_tokens")))

    above = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"),
                                            *[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)])
    children = above.groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"))
    # A parent may have very many children: the children are the side that is split when skewed.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for p, k in zip(PARENT, KEY, strict=True)],
                           F.col("conv_id").alias("parent_conv_id"))
    ends = end_lists(rows.where("last").select("conv_id", *node).unionByName(
        convs.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in node])), node)
    return (nodes.join(parents, ["depth", *PARENT], "left")
            .join(below, node).join(children, node, "left").join(ends, node, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs",
                    F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """ordered(), rebuilt() and trie() of a table of conv_id, turn, role, text; other columns are ignored."""
    return trie(*rebuilt(ordered(conversations), group, most))
