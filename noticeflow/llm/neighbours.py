"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of bounded size by hash. Within a shard points join a graph in
growing batches: greedy searches from the middle propose neighbours, and pruning with a
relaxed distance keeps an edge only if no kept one leads nearly as close. Queries run a beam
search on every shard, in blocks, and the shards' best are merged. The largest inner product
is nearness; graphs are built with one more coordinate that makes all norms equal, where the
order by distance is the order by inner product. Equal vectors are one point: of a group only
the least ids can be among the nearest, and those are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

SHARD = 4_096
DEGREE = 40
BUILD_BEAM = 72
BEAM = 112
RELAX = 1.2
QUERY_BLOCK = 1_024
SALT_ROWS = 10_000
CHUNK = 256
BATCH = 1_024


def top_beam(graph: np.ndarray, points: np.ndarray, queries: np.ndarray, start: int, beam: int):
    """Ids and distances (B, beam), nearest first, that a greedy search from `start` meets.

    Distance is minus the inner product with (points, |points|^2 / 2), which orders as the
    Euclidean one. Missing places have id -1 and distance inf.
    """
    n, b = len(points), len(queries)
    half = (points * points).sum(1) / 2
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, points.dtype)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # column n stands for a missing neighbour
    seen[:, n] = True
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = half[start] - queries @ points[start]
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        open_at = np.where(done[live], np.inf, dist[live]).argmin(1)
        has = ~done[live, open_at]
        live, open_at = live[has], open_at[has]
        if not len(live):
            break
        done[live, open_at] = True
        near = graph[ids[live, open_at]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        r, c = np.nonzero(fresh)
        new = np.full(near.shape, np.inf, points.dtype)
        target = near[r, c]
        new[r, c] = half[target] - np.einsum("ij,ij->i", queries[live[r]], points[target])
        all_ids = np.concatenate([ids[live], near], 1)
        all_dist = np.concatenate([dist[live], new], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        keep = np.argpartition(all_dist, beam - 1, 1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        dist[live] = np.take_along_axis(all_dist, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1) | np.isinf(dist[live])
    ids[np.isinf(dist)] = -1
    order = dist.argsort(1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most `degree` of the candidates of each point: the nearest, then the nearest that no
    chosen one is `relax` times closer to. Candidates are ids, -1 where there is none."""
    b, c = candidates.shape
    candidates = np.sort(candidates, 1)
    bad = (candidates < 0) | (candidates == own[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    there = points[np.maximum(candidates, 0)] - points[own][:, None]
    square = (there * there).sum(2)
    dist = np.where(bad, np.inf, square)
    inner = there @ there.transpose(0, 2, 1)
    out = np.full((b, degree), -1, np.int64)
    for k in range(degree):
        pick = dist.argmin(1)
        got = np.flatnonzero(np.isfinite(dist[np.arange(b), pick]))
        if not len(got):
            break
        chosen = candidates[got, pick[got]]
        out[got, k] = chosen
        at = pick[got]
        between = square[got] + square[got, at][:, None] - 2 * inner[got, at]
        gone = relax * relax * between <= dist[got]
        gone[np.arange(len(got)), pick[got]] = True
        dist[got] = np.where(gone, np.inf, dist[got])
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
    """The neighbours of each point (-1: none) and the point all searches start from."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for factor in (1.0, relax):
        at = 1 if factor == 1.0 else 0
        while at < n:
            size = min(n - at, max(1, at) if factor == 1.0 else n, BATCH)
            own = order[at:at + size]
            fresh = graph[own]
            for a in range(0, size, CHUNK):
                some = own[a:a + CHUNK]
                met, _ = top_beam(graph, points, points[some], start, beam)
                fresh[a:a + CHUNK] = prune(points, some, np.concatenate([met, graph[some]], 1), degree, factor)
            graph[own] = fresh
            # Each new edge is offered back; a point with too many prunes them again.
            src, dst = np.repeat(own, degree), graph[own].reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            targets, first, count = np.unique(dst[by], return_index=True, return_counts=True)
            offered = np.full((len(targets), int(count.max(initial=0))), -1, np.int64)
            col = np.arange(len(by)) - np.repeat(first, count)
            offered[np.repeat(np.arange(len(targets)), count), col] = src[by]
            both = np.concatenate([graph[targets], offered], 1)
            for a in range(0, len(targets), CHUNK):
                graph[targets[a:a + CHUNK]] = prune(points, targets[a:a + CHUNK], both[a:a + CHUNK],
                                                    degree, factor)
            at += size
    return graph, start


def with_equal_norms(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One more coordinate; single precision does for walking the graph."""
    rest = np.maximum(largest - (vectors * vectors).sum(1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1).astype(np.float32)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v: finite, complete vectors that are not zero, each (id, vector) once."""
    v = F.col(embedding).cast("array<double>")
    good = (F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(v, lambda x: x != 0))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(vec_id).alias("vec_id"), v.alias("v")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id",
            embedding: str = "embedding", shard_rows: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `vectors` to each of `queries`.

    Nearness is the largest inner product in double precision; ties go to the smaller id. A
    query's own id is no candidate. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, and neither do rows with a null id; repeated rows
    count once. Vectors of different lengths are never compared.
    """
    points = saved(usable(vectors, vec_id, embedding), "points")
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    salts = 1 + stats["n"] // SALT_ROWS
    # The k + 1 least ids of each distinct vector: within salts first, so no group is gathered.
    some = (points.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"))
            .agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids")))
    groups = saved(some.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1)
                                         .alias("ids")).withColumn("rep", F.col("ids")[0]), "groups")
    dims = [(r["d"], -(-r["n"] // shard_rows)) for r in
            groups.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not dims:
        dims = [(0, 1)]
    shards = F.create_map(*[F.lit(x).cast("int") for pair in dims for x in pair])
    dealt = groups.select("rep", "v", F.size("v").alias("d")).withColumn(
        "shard", F.pmod(F.xxhash64("rep"), F.element_at(shards, F.col("d"))).cast("int"))
    largest = float(stats["norm"] or 0.0)

    def make(key, frame):
        frame = frame.sort_values("rep")
        x = np.stack(frame["v"].to_numpy())
        graph, start = build(with_equal_norms(x, largest))
        return pd.DataFrame({"d": [key[0]], "shard": [key[1]], "start": [start], "reps":
                             [frame["rep"].to_numpy(np.int64).tobytes()], "points": [x.tobytes()],
                             "graph": [graph.astype(np.int32).tobytes()]})

    index = saved(dealt.groupBy("d", "shard").applyInPandas(
        make, "d int, shard int, start int, reps binary, points binary, graph binary"), "index")

    wanted = saved(usable(queries, vec_id, embedding), "queries")
    blocks = 1 + wanted.count() // QUERY_BLOCK
    asked = (wanted.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("d"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
             .where(F.col("d").isin([d for d, _ in dims]))
             .groupBy("d", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(shards, F.col("d")) - 1))))

    def search(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                reps = np.frombuffer(row.reps, np.int64)
                x = np.frombuffer(row.points).reshape(len(reps), -1)
                graph = np.frombuffer(row.graph, np.int32).reshape(len(reps), -1)
                q_ids = np.array([a["query_id"] for a in row.asked], np.int64)
                q = np.stack([a["v"] for a in row.asked]).astype(float)
                flat = with_equal_norms(x, largest)
                for a in range(0, len(q), CHUNK):
                    own = np.concatenate([q[a:a + CHUNK], np.zeros((len(q[a:a + CHUNK]), 1))], 1).astype(np.float32)
                    ids, _ = top_beam(graph, flat, own, row.start, max(beam, k + 1))
                    r, c = np.nonzero(ids >= 0)
                    score = (q[a + r] * x[ids[r, c]]).sum(1)
                    rep = reps[ids[r, c]]
                    order = np.lexsort((rep, -score, r))
                    r, rep, score = r[order], rep[order], score[order]
                    first = np.searchsorted(r, np.arange(len(own)))
                    keep = np.arange(len(r)) - first[r] <= k
                    yield pd.DataFrame({"query_id": q_ids[a + r[keep]], "rep": rep[keep], "score": score[keep]})

    found = (asked.join(index, ["d", "shard"]).select("asked", "start", "reps", "points", "graph")
             .mapInPandas(search, "query_id long, rep long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    close = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (close.join(groups.select("rep", "ids"), "rep")
            .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
