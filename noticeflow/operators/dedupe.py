"""First-wins deduplication without windows over whole rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.chars import text_or_empty
from ..session import shared_dir


def _firsts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Smallest ``order`` per key; a map-side partial minimum on narrow rows."""
    return df.groupBy(*keys).agg(F.min(order).alias(order)).select(*keys, order)


def _pick(df: DataFrame, chosen: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    named = chosen.toDF(*[f"_w_{c}" for c in (*keys, order)])
    on = reduce(lambda a, b: a & b,
                [df[c].eqNullSafe(named[f"_w_{c}"]) for c in keys]
                + [df[order] == named[f"_w_{order}"]])
    return df.join(named, on, "left_semi")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` per key.

    Only keys and order are aggregated, so a key that holds a third of all
    rows costs one row per map task. The wide rows are then picked by (key,
    order), which spreads a hot key evenly: ``order`` is unique within a key.
    """
    return _pick(df, _firsts(df, keys, order), keys, order)


def unseen(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet.

    Only keys are read of what is stored. Where it is laid out by key, as the urls of
    ``sources.state`` are, pass the part that the keys of ``df`` can be in.
    """
    return df.join(stored.select(*keys), list(keys), "left_anti")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of ``new`` to append: unseen keys, the first row of each.

    Both decisions are made on (key, order) alone; the wide rows are then picked by both.
    """
    return _pick(new, unseen(_firsts(new, keys, order), old, keys), keys, order)


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows over the named columns that exist."""
    return df.select(*[c for c in cols if c in df.columns]).distinct()


#: Rounds that settle first rows only; short chains, nearly all there are, end within them.
PLAIN_ROUNDS = 2


def _settled_chains(undecided: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` and the kept rows of all chains that lead to it (t, u, o).

    A row with exactly one earlier undecided neighbour is kept if that one is dropped, so
    whether it is kept follows from the end of its chain and the parity of the way there. Ways
    are doubled each step: a chain of n rows takes log n steps. A row is the earlier neighbour
    of at most two such rows, so no key of these joins is hot.
    """
    by_title = undecided.groupBy("t").agg(F.min("o").alias("t1"))
    by_url = undecided.groupBy("u").agg(F.min("o").alias("u1"))
    ranked = undecided.join(by_title, "t").join(by_url, "u").checkpoint()
    second_t = ranked.filter(F.col("o") > F.col("t1")).groupBy("t").agg(F.min("o").alias("o"))
    second_u = ranked.filter(F.col("o") > F.col("u1")).groupBy("u").agg(F.min("o").alias("o"))
    single = (ranked.filter("o = u1 AND o > t1").join(second_t, ["t", "o"]).select("t", "u", "o", F.col("t1").alias("p"))
              .unionByName(ranked.filter("o = t1 AND o > u1").join(second_u, ["u", "o"]).select("t", "u", "o", F.col("u1").alias("p"))))
    single = single.checkpoint()
    way = single.select("o", "p", F.lit(True).alias("odd"))
    while True:
        ahead = way.select(F.col("o").alias("p"), F.col("p").alias("p2"), F.col("odd").alias("odd2"))
        longer = way.join(ahead, "p", "left").checkpoint()
        if longer.filter("p2 IS NOT NULL").isEmpty():
            break
        way = longer.select("o", F.coalesce("p2", "p").alias("p"),
                            (F.col("odd") != F.coalesce("odd2", F.lit(False))).alias("odd"))
    even = way.filter(~F.col("odd")).join(chosen.select(F.col("o").alias("p")), "p", "left_semi")
    return chosen.unionByName(single.join(even, "o", "left_semi").select("t", "u", "o"))


def dedupe_either(df: DataFrame, order: str, title: str = "title", url: str = "url",
                  max_rounds: int | None = None) -> DataFrame:
    """Drop a row when its title or its url equals that of an earlier *kept* row.

    Works on (title, url, first order) only; ``order`` is unique. Each round keeps every
    undecided row that is first in both its title group and its url group and drops the
    rows that share a title or url with one just kept. What the first two rounds leave hangs
    together in chains: later rounds also settle every row that one earlier row alone decides,
    however long the chain. Rounds are written to the shared checkpoint folder, so lineage
    stays short. With ``max_rounds`` it raises when rows are left undecided after so many.
    """
    spark = df.sparkSession
    shared_dir(spark)
    # Later copies of one (title, url) pair are dropped whatever happens to
    # the first, so one row per pair is enough to decide.
    undecided = (df.select(text_or_empty(F.col(title)).alias("t"),
                           text_or_empty(F.col(url)).alias("u"), F.col(order).alias("o"))
                 .groupBy("t", "u").agg(F.min("o").alias("o"))).checkpoint()
    kept: list[DataFrame] = []
    while max_rounds is None or len(kept) < max_rounds:
        first_of_title = undecided.groupBy("t").agg(F.min("o").alias("o"))
        first_of_url = undecided.groupBy("u").agg(F.min("o").alias("o"))
        chosen = first_of_title.join(first_of_url, "o").select("t", "u", "o").checkpoint()
        if len(kept) >= PLAIN_ROUNDS:
            chosen = _settled_chains(undecided, chosen).checkpoint()
        kept.append(chosen)
        undecided = (undecided.join(chosen.select("t"), "t", "left_anti")
                     .join(chosen.select("u"), "u", "left_anti")).checkpoint()
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError(f"rows still undecided after {max_rounds} rounds")
    chosen = reduce(DataFrame.unionByName, kept).select(F.col("o").alias("_kept"))
    return df.join(chosen, df[order] == chosen["_kept"], "left_semi")
