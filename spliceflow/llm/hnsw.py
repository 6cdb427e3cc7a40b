"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged.

Vectors that are equal are one node that carries its smallest ids. Inner products become distances
on a sphere by one more component, so that graphs are built and searched on vectors of one norm. A
graph's layers are flat neighbour arrays; each layer is filled in batches, whose members also see
each other, with neighbours picked for diversity. Queries go in blocks against every shard; scores
are then taken in double precision from the original vectors and the shards' best are merged.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no
part; vectors of different lengths do not meet; rows that repeat a vec_id count once (the least
vector); ties go to the smaller vec_id; with fewer candidates all are given; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import in_batches, table

#: Vectors a shard, links a node (twice that on the lowest layer), search widths, queries a block.
SHARD, LINKS, BUILD_WIDTH, SEARCH_WIDTH, BLOCK = 4096, 16, 96, 128, 512


def _top(ids: np.ndarray, sims: np.ndarray, done: np.ndarray, width: int):
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    pick = lambda x: np.take_along_axis(x, order, 1)
    return pick(ids), pick(sims), pick(done)


def beam(vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int, step: int = 4):
    """(ids, similarities), best first and -1 where there are fewer, of a best-first search per query."""
    q, n = len(queries), len(vectors)
    ids = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -np.inf, np.float32)
    done = np.ones((q, width), bool)
    seen = np.zeros(q * n, bool)
    ids[:, 0], done[:, 0] = entry, False
    sims[:, 0] = np.einsum("ij,ij->i", vectors[entry], queries)
    seen[np.arange(q) * n + entry] = True
    while True:
        open_sims = np.where(done, -np.inf, sims)
        if not (open_sims > -np.inf).any():
            return ids, sims
        k = min(step, width)
        at = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
        row = np.repeat(np.arange(q), k)
        ok = np.take_along_axis(open_sims, at, 1).ravel() > -np.inf
        row, col = row[ok], at.ravel()[ok]
        done[row, col] = True
        near = links[ids[row, col]]
        key = (row[:, None] * n + near)[near >= 0]
        key = np.unique(key[~seen[key]])
        if not len(key):
            continue
        seen[key] = True
        who, node = key // n, key % n
        sim = np.einsum("ij,ij->i", vectors[node], queries[who])
        first = np.searchsorted(who, np.arange(q))
        nth = np.arange(len(who)) - first[who]
        more = int(nth.max()) + 1
        x = np.full((q, more), -1, np.int64)
        y = np.full((q, more), -np.inf, np.float32)
        x[who, nth], y[who, nth] = node, sim
        ids, sims, done = _top(np.hstack([ids, x]), np.hstack([sims, y]), np.hstack([done, x < 0]), width)


def diverse(vectors: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first) up to ``most`` that lie nearer to the base than to one picked."""
    rows, width = ids.shape
    out = np.full((rows, most), -1, np.int64)
    count = np.zeros(rows, np.int64)
    closest = np.full((rows, width), -np.inf, np.float32)
    cand = vectors[np.maximum(ids, 0)]
    spare = np.zeros((rows, width), bool)
    for j in range(width):
        valid = (ids[:, j] >= 0) & (count < most)
        good = valid & (closest[:, j] < sims[:, j])
        spare[:, j] = valid & ~good
        r = np.flatnonzero(good)
        if len(r):
            out[r, count[r]] = ids[r, j]
            count[r] += 1
            closest[r] = np.maximum(closest[r], np.einsum("rwd,rd->rw", cand[r], cand[r, j]))
    for j in range(width):  # free places go to the best of those passed over
        r = np.flatnonzero(spare[:, j] & (count < most))
        out[r, count[r]] = ids[r, j]
        count[r] += 1
    return out


def _layer(vectors: np.ndarray, members: np.ndarray, entries, most: int) -> np.ndarray:
    """Flat neighbour array (all nodes x most) of one layer over ``members``."""
    links = np.full((len(vectors), most), -1, np.int64)
    placed, size = 0, 32
    while placed < len(members):
        new = members[placed : placed + size]
        v = vectors[new]
        inside = v @ v.T
        np.fill_diagonal(inside, -np.inf)
        k = min(most, len(new) - 1)
        ids = np.full((len(new), 0), -1, np.int64)
        sims = np.full((len(new), 0), -np.inf, np.float32)
        if k:
            at = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            ids, sims = new[at], np.take_along_axis(inside, at, 1).astype(np.float32)
        if placed:
            start = entries(v)
            a, b = beam(vectors, links, np.where(np.isin(start, members[:placed]), start, members[0]), v, BUILD_WIDTH)
            ids, sims = np.hstack([ids, a]), np.hstack([sims, b])
        if ids.shape[1]:
            ids, sims, _ = _top(ids, sims, np.zeros(ids.shape, bool), BUILD_WIDTH)
            picked = diverse(vectors, v, ids, sims, max(1, most // 2))
            links[new, : picked.shape[1]] = picked
            ok = picked >= 0
            to, back = picked[ok], np.repeat(new, ok.sum(1))
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            count = np.diff(np.r_[first, len(to)])
            target = to[first]
            extra = np.full((len(target), int(count.max())), -1, np.int64)
            extra[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            both = np.hstack([links[target], extra])
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.where(both >= 0, np.einsum("rwd,rd->rw", vectors[np.maximum(both, 0)], vectors[target]), -np.inf).astype(np.float32)
            both, near, _ = _top(both, near, np.zeros(both.shape, bool), both.shape[1])
            links[target] = diverse(vectors, vectors[target], both, near, most)
        placed += len(new)
        size = int(min(512, max(32, placed // 4)))
    return links


class Graph:
    """Layers from the top down; every layer's members are a subset of the next one's."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], start: int):
        self.vectors, self.layers, self.start = vectors, layers, start

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        graph = cls(vectors, [], int(np.argmax(level)))
        for k in range(int(level.max()), -1, -1):
            members = np.flatnonzero(level >= k)
            members = members[np.argsort(-level[members], kind="stable")]
            graph.layers.append(_layer(vectors, members, graph.entry, 2 * LINKS if k == 0 else LINKS))
        return graph

    def entry(self, queries: np.ndarray) -> np.ndarray:
        at = np.full(len(queries), self.start, np.int64)
        for links in self.layers:
            at = beam(self.vectors, links, at, queries, 4, 1)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        upper = Graph(self.vectors, self.layers[:-1], self.start)
        return beam(self.vectors, self.layers[-1], upper.entry(queries), queries, width)[0]


def on_sphere(x: np.ndarray) -> np.ndarray:
    """One more component gives all vectors the largest norm; inner products with (query, 0) stay."""
    squares = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]]).astype(np.float32)


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def _index(group: pd.DataFrame) -> pd.DataFrame:
    x = np.stack([np.asarray(v, np.float64) for v in group["embedding"]])
    graph = Graph.build(on_sphere(x / max(1e-300, np.sqrt(np.einsum("ij,ij->i", x, x).max()))))
    return pd.DataFrame({
        "shard": [int(group["shard"].iloc[0])], "dim": [x.shape[1]], "start": [graph.start], "original": [x.tobytes()],
        "layers": [[g.astype(np.int32).tobytes() for g in graph.layers]], "ids": [[list(map(int, i)) for i in group["ids"]]],
    })


def nearest(rows: DataFrame, is_query: Column, k: int = 20, shard_size: int = SHARD, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score for each query's ``k`` nearest among all other rows."""
    clean = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("embedding"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    clean = table(clean, "vectors")
    # Of equal vectors the k + 1 smallest ids can appear in a result.
    few = clean.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = table(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_size))
    split = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    index = nodes.select("embedding", "ids", split("embedding", shards).alias("shard"), F.size("embedding").alias("dim")).groupBy("shard", "dim").applyInPandas(
        _index, "shard int, dim int, start int, original binary, layers array<binary>, ids array<array<long>>"
    )
    index = table(index, "index")
    queries = clean.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    block = queries.select(split("vec_id", blocks).alias("block"), F.size("embedding").alias("dim"), F.struct("vec_id", "embedding").alias("q")).groupBy("block", "dim").agg(F.collect_list("q").alias("qs"))
    block = block.select("dim", "qs", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["original"], np.float64).reshape(-1, row["dim"])
                scaled = on_sphere(x / max(1e-300, np.sqrt(np.einsum("ij,ij->i", x, x).max())))
                graph = Graph(scaled, [np.frombuffer(g, np.int32).reshape(len(x), -1).astype(np.int64) for g in row["layers"]], row["start"])
                q = np.array([z["embedding"] for z in row["qs"]], np.float64)
                unit = q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
                found = graph.search(np.hstack([unit, np.zeros((len(q), 1))]).astype(np.float32), max(width, 2 * k))
                out: tuple[list, list, list] = ([], [], [])
                for i, z in enumerate(row["qs"]):
                    nodes_ = found[i][found[i] >= 0]
                    scores = (x[nodes_] * q[i]).sum(1)
                    best = sorted((-float(s), int(v)) for s, n in zip(scores, nodes_) for v in row["ids"][n] if v != z["vec_id"])[:k]
                    out[0].extend([z["vec_id"]] * len(best)), out[1].extend(v for _, v in best), out[2].extend(-s for s, _ in best)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    # Few rows a batch: each holds a shard's graph.
    met = block.join(index, ["shard", "dim"]).repartition(max(1, min(shards * blocks, 4096)), "shard", F.monotonically_increasing_id())
    best = in_batches(met.select("qs", "dim", "start", "original", "layers", "ids")).mapInArrow(work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
