"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Distinct vectors are dealt to shards by a hash; each shard is one graph. Points enter in batches: a greedy
beam search on the graph so far proposes neighbours, and relaxed distance pruning keeps those that no kept
neighbour is much closer to, so edges stay diverse; reverse edges are added and pruned alike. A second
pass over all points prunes with the relaxed factor. Graphs are a table (one row for each vector with its
edges), which searches read: every query walks every shard of its dimension with a beam,
the beams' best are joined, and the exact cosine of the original vectors in double precision ranks them.

Equal vectors are one point of the graph, which carries the ``k + 1`` smallest ids of its copies; copies
beyond those cannot be among ``k`` results, because equal scores go to smaller ids. That is a window
group limit, which cuts a very common vector inside every task.

A shard has about ``SHARD_ROWS`` vectors and queries come in blocks of ``QUERY_ROWS``, so a task holds one
shard and one block, whatever the size of the table.

Defined results: NULL or empty vectors, zero vectors and vectors with a NULL or non-finite component take no part, nor do
rows with a NULL id; vectors meet those of the same dimension only; rows that repeat an id are one row if
their vectors are equal, else each takes part; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

SHARD_ROWS = 4096
QUERY_ROWS = 2048
DEGREE = 28
BEAM = 48
RELAXED = 1.2
BATCH = 512


def beam_search(vectors: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest points that a greedy walk meets, nearest first, and their distances.

    All queries take their steps together: each opens its nearest unopened point. -1 fills short beams.
    """
    n, q = len(vectors), len(queries)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    opened = np.zeros((q, beam), bool)
    ids[:, 0] = entry
    far[:, 0] = 1 - queries @ vectors[entry]
    seen = np.zeros((q, n + 1), bool)
    seen[:, entry] = True
    seen[:, n] = True
    while True:
        waiting = np.where(opened | (ids < 0), np.inf, far)
        pick = waiting.argmin(1)
        live = np.flatnonzero(np.isfinite(waiting[rows, pick]))
        if not len(live):
            return ids, far
        at = ids[live, pick[live]]
        opened[live, pick[live]] = True
        near = edges[at]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        distance = np.full(near.shape, np.inf, np.float32)
        i, j = np.nonzero(fresh)
        distance[i, j] = 1 - np.einsum("ij,ij->i", queries[live[i]], vectors[near[i, j]])
        both_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        both_far = np.concatenate([far[live], distance], axis=1)
        both_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
        order = np.argpartition(both_far, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(both_ids, order, 1)
        far[live] = np.take_along_axis(both_far, order, 1)
        opened[live] = np.take_along_axis(both_open, order, 1)


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, relaxed: float, degree: int) -> np.ndarray:
    """Up to ``degree`` edges of each point: the nearest candidate stays and strikes out those it is closer to than the point is."""
    own = vectors[points]
    valid = (candidates >= 0) & (candidates != points[:, None])
    there = vectors[np.maximum(candidates, 0)]
    distance = np.where(valid, 1 - np.einsum("pd,pcd->pc", own, there), np.inf)
    # a candidate that is listed twice counts once
    order = np.argsort(candidates, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(candidates, order, 1)
    twice = np.concatenate([np.zeros((len(points), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], axis=1)
    np.put_along_axis(distance, order, np.where(twice, np.inf, np.take_along_axis(distance, order, 1)), 1)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    between = 1 - np.einsum("pcd,ped->pce", there, there, optimize=True)
    for slot in range(degree):
        best = distance.argmin(1)
        live = np.isfinite(distance[rows, best])
        if not live.any():
            break
        out[live, slot] = candidates[rows, best][live]
        struck = relaxed * between[rows, best] <= distance
        distance[struck & live[:, None]] = np.inf
        distance[rows[live], best[live]] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relaxed: float = RELAXED, seed: int = 0) -> tuple[np.ndarray, int]:
    """Edges (-1 where a point has fewer) and the entry point of unit vectors."""
    n = len(vectors)
    edges = np.full((n, degree), -1, np.int64)
    entry = int((vectors @ vectors.mean(0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    for factor in (1.0, relaxed):
        at, size = 0, 16
        while at < n:
            points = order[at:at + min(size, BATCH)]
            at += len(points)
            size *= 2
            found, _ = beam_search(vectors, edges, vectors[points], entry, beam)
            # points of one batch may be near each other before the graph knows them
            peers = np.broadcast_to(points, (len(points), len(points))) if len(points) <= 64 else np.zeros((len(points), 0), np.int64)
            mine = np.concatenate([found, edges[points], peers], axis=1)
            edges[points] = robust_prune(vectors, points, mine, factor, degree)
            _add_reverse(vectors, edges, points, factor, degree)
    return edges, entry


def _add_reverse(vectors: np.ndarray, edges: np.ndarray, points: np.ndarray, relaxed: float, degree: int) -> None:
    source = np.repeat(points, degree)
    target = edges[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    keys, begins, counts = np.unique(target, return_index=True, return_counts=True)
    width = int(counts.max()) if len(counts) else 0
    for low in range(0, len(keys), BATCH):
        k, b, c = keys[low:low + BATCH], begins[low:low + BATCH], counts[low:low + BATCH]
        extra = np.full((len(k), min(width, int(c.max()))), -1, np.int64)
        inside = np.arange(extra.shape[1])[None] < c[:, None]
        extra[inside] = source[(b[:, None] + np.arange(extra.shape[1])[None])[inside]]
        extra[(extra[:, :, None] == edges[k][:, None, :]).any(2)] = -1
        every = np.concatenate([edges[k], extra], axis=1)
        room = (every >= 0).sum(1) <= degree
        packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
        edges[k[room]] = packed[room][:, :degree]
        if (~room).any():
            edges[k[~room]] = robust_prune(vectors, k[~room], packed[~room], relaxed, degree)


def unit(vectors: list) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in vectors])
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that have a direction."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some)


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Table (dim, shard, node, embedding, vec_ids, edges, entry), one row for each distinct vector."""
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable(vectors).distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    points = cut(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")))
    shards = max(1, round(points.count() / shard_rows))
    dealt = points.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_ids", key=lambda s: s.map(lambda x: x[0]), ignore_index=True)
        edges, entry = build_graph(unit(group["embedding"]))
        return group.assign(node=np.arange(len(group)), edges=[e[e >= 0].tolist() for e in edges], entry=entry)[
            ["dim", "shard", "node", "embedding", "vec_ids", "edges", "entry"]]

    schema = "dim int, shard bigint, node bigint, embedding array<double>, vec_ids array<bigint>, edges array<bigint>, entry bigint"
    return cut(dealt.groupBy("dim", "shard").applyInPandas(build, schema))


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each (query_id, embedding), own row excluded."""
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    blocked = queries.select("query_id", F.col("embedding").alias("query"), F.size("embedding").alias("dim"),
                             F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    shards = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard")).distinct()
    asked = blocked.join(shards, F.col("dim") == F.col("_dim")).select("query_id", "query", "dim", F.col("_shard").alias("of"), "block")
    there = blocked.select(F.col("dim").alias("_dim"), F.col("block").alias("of_block")).distinct()
    every = index.join(there, F.col("dim") == F.col("_dim")).drop("_dim")

    def walk(points: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if points.empty or mine.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        points = points.sort_values("node", ignore_index=True)
        vectors = unit(points["embedding"])
        edges = np.full((len(points), max(map(len, points["edges"]))), -1, np.int64)
        for i, e in enumerate(points["edges"]):
            edges[i, :len(e)] = e
        out = []
        raw = np.stack(points["embedding"].to_numpy())
        sizes = np.sqrt((raw * raw).sum(1))
        for at in range(0, len(mine), 512):
            part = mine.iloc[at:at + 512]
            asked_raw = np.stack(part["query"].to_numpy())
            found, _ = beam_search(vectors, edges, unit(part["query"]), int(points["entry"][0]), min(beam, max(len(points), k + 1)))
            lengths = np.sqrt((asked_raw * asked_raw).sum(1))
            for i, query in enumerate(part["query_id"]):
                nodes = found[i][found[i] >= 0]
                scores = (raw[nodes] * asked_raw[i]).sum(1) / (sizes[nodes] * lengths[i])
                rows = [(-s, v) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True)
                        for v in points["vec_ids"][node] if v != query]
                out += [(query, v, -s) for s, v in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    near = every.groupBy("dim", "shard", "of_block").cogroup(asked.groupBy("dim", "of", "block")).applyInPandas(
        walk, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Nearest found vectors of every row whose id is divisible by ``every``."""
    asked = usable(vectors.where(F.col("vec_id") % every == 0)).distinct()
    return search(build_index(vectors, k), cut(asked.select(F.col("vec_id").alias("query_id"), "embedding")), k)
