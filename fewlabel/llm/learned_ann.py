"""Nearest neighbours by learned partitions.

Fit (on a bounded sample): the sample's neighbour graph is cut into balanced parts by
recursive bisection (the graph's second eigenvector split at its median, then swaps that
lower the cut); a small network learns, from a vector alone, how the vector's neighbours
spread over the parts.  The least probability mass that a query must cover is calibrated
on sample rows kept out of training, so that ``TARGET_RECALL`` of their neighbours lie in
the covered parts.

Index: every vector goes to its likeliest part; parts of more than ``BLOCK`` rows are
dealt to several blocks, so no task holds more.  Search: a query goes to its likeliest
parts until they cover the calibrated mass; each block returns its nearest exactly, and
the lists are merged.

Distances are Euclidean in double precision on the original vectors.  Equal vectors are
collapsed first, keeping the ``k + 1`` smallest ids (no query can need more of them).

Defined results: vectors that are null, zero, or hold null or non-finite components, or
whose dimension is not the most frequent one (the larger of equals), take no part, nor do
null ids; rows that repeat an id and vector count once, an id with several vectors keeps
them all as candidates, and its query is the vector that sorts first; fewer candidates
than ``k`` give them all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.llm.common import importable, pick, written

#: Most vectors that a fit reads.
SAMPLE_ROWS = 8_192
#: Rows a part should hold, most parts, and most rows in a block (one task's candidates).
PART_ROWS, MAX_PARTS, BLOCK = 4_096, 256, 4_096
GRAPH_K, HIDDEN, EPOCHS, TARGET_RECALL = 10, 128, 24, 0.97


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of every row."""
    sq = (x * x).sum(axis=1)
    out = []
    for i in range(0, len(x), 512):
        d = sq[None, :] - 2 * x[i:i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.vstack(out)


def _bisect(nodes: np.ndarray, graph: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``nodes`` falls into the second of two halves of equal size."""
    local = np.full(n, -1)
    local[nodes] = np.arange(len(nodes))
    to = local[graph[nodes]]
    src, dst = np.nonzero(to >= 0)[0], to[to >= 0]
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    m = len(nodes)
    deg = np.maximum(np.bincount(src, minlength=m), 1)
    v = np.random.default_rng(len(nodes)).standard_normal(m)
    for _ in range(60):  # power iteration for the second eigenvector of the lazy random walk
        v = 0.5 * v + 0.5 * np.bincount(src, weights=v[dst], minlength=m) / deg
        v -= (v * deg).sum() / deg.sum()
        v /= max(np.linalg.norm(v), 1e-300)
    second = np.zeros(m, bool)
    second[np.lexsort((np.arange(m), v))[m // 2:]] = True
    for _ in range(8):  # swap the pairs that gain most
        there = np.bincount(src, weights=second[dst], minlength=m)
        gain = np.where(second, deg - 2 * there, 2 * there - deg)
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        c = min(len(a), len(b))
        swap = np.flatnonzero(gain[a[:c]] + gain[b[:c]] > 2)
        if not len(swap):
            break
        take = max(1, len(swap) // 2)  # not all: swapped neighbours change each other's gain
        second[a[:take]], second[b[:take]] = True, False
    return second


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """The part of every node; ``parts`` is a power of two, parts differ by one row per cut at most."""
    n = len(graph)
    part = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            new[nodes] += _bisect(nodes, graph, n)
        part = new
    return part


@dataclass
class Router:
    """Vector -> probability of each part to hold a neighbour; ``mass`` is what a query must cover."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    mass: float = 1.0

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def routes(self, p: np.ndarray, mass: float | None = None) -> list[np.ndarray]:
        """The likeliest parts of each row, until they cover the mass."""
        order = np.argsort(-p, axis=1, kind="stable")
        covered = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        need = (covered < (self.mass if mass is None else mass) - 1e-12).sum(axis=1) + 1
        return [o[:m] for o, m in zip(order, np.minimum(need, self.parts))]


def fit_router(x: np.ndarray, n_rows: int) -> Router:
    """Parts, network and calibrated mass from a sample (rows in a fixed order)."""
    n, dim = x.shape
    parts = 1
    while parts < min(MAX_PARTS, max(1, n_rows / PART_ROWS)) and n // (2 * parts) >= 32:
        parts *= 2
    scale = 1 / max(float(np.sqrt((x * x).mean())), 1e-300)
    rng = np.random.default_rng(11)
    r = Router(rng.standard_normal((dim, HIDDEN)) * math.sqrt(2 / dim), np.zeros(HIDDEN),
               np.zeros((HIDDEN, parts)), np.zeros(parts), scale)
    if parts == 1:
        return r
    k = min(GRAPH_K, n - 1)
    graph = _nearest(x, k)
    part = balanced_parts(graph, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), k + 1), part[np.hstack([graph, np.arange(n)[:, None]])].ravel()), 1 / (k + 1))
    kept_out = np.arange(n) % 5 == 0
    train = np.flatnonzero(~kept_out)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (r.w1, r.b1, r.w2, r.b2)]
    xs, step = x * scale, 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        for i in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            a = xs[i] @ r.w1 + r.b1
            h = np.maximum(a, 0)
            z = h @ r.w2 + r.b2
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i)
            gh = g @ r.w2.T * (a > 0)
            step += 1
            for w, grad, (m, v) in zip((r.w1, r.b1, r.w2, r.b2), (xs[i].T @ gh + 1e-5 * r.w1, gh.sum(0), h.T @ g + 1e-5 * r.w2, g.sum(0)), state):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    p = r.probabilities(x)
    home, out = p.argmax(axis=1), np.flatnonzero(kept_out)
    for mass in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0):
        r.mass = mass
        hit = [np.isin(home[graph[i]], route).mean() for i, route in zip(out, r.routes(p[out], mass))]
        if np.mean(hit) >= TARGET_RECALL:
            break
    return r


def usable(v: Column) -> Column:
    """Whether a vector takes part: all components there and finite, not all zero."""
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda c: c != 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def nearest_neighbours(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    importable(spark)
    v = pick(vectors, **{id_col: "bigint", vector_col: "array<double>"}).toDF("id", "v")
    v = v.where(F.col("id").isNotNull() & usable(F.col("v")))
    dims = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if dims is None:
        return empty
    dim, n_rows = int(dims["d"]), int(dims["n"])
    v = v.where(F.size("v") == dim)
    sample = v.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).select("v").toArrow()
    x = np.unique(_matrix(sample.column("v").combine_chunks(), dim), axis=0)
    router = fit_router(x[np.random.default_rng(3).permutation(len(x))], n_rows)

    # equal vectors: one row with its k + 1 smallest ids; the group limit works in the map tasks, so a hot vector is no hot task
    of_vector = Window.partitionBy("v").orderBy("id")
    firsts = v.distinct().withColumn("r", F.row_number().over(of_vector)).where(F.col("r") <= k + 1)
    index = firsts.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home = router.probabilities(_matrix(b.column("v"), dim)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), pa.array(home.astype(np.int32))], names=["v", "ids", "part"])

    index = written(index.mapInArrow(homes, "v array<double>, ids array<bigint>, part int"), "ann-index")
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per part
    blocks = {p: max(1, -(-n // BLOCK)) for p, n in sizes.items()}

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                routes = router.routes(router.probabilities(_matrix(b.column("v"), dim)))
                rows, part, block = [], [], []
                for i, route in enumerate(routes):
                    for p in route.tolist():
                        for j in range(blocks.get(p, 0)):
                            rows.append(i)
                            part.append(p)
                            block.append(j)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("v").take(at), pa.array(part, pa.int32()), pa.array(block, pa.int32())],
                    names=["query_id", "v", "part", "block"])

    queries = v.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.mapInArrow(routed, "query_id bigint, v array<double>, part int, block int")
    dealt = F.create_map(*[F.lit(x) for p, n in blocks.items() for x in (p, n)])
    index = index.withColumn("block", F.pmod(F.xxhash64("v"), dealt[F.col("part")]).cast("int"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "ids": [], "score": []}
        if len(q) and len(c):
            x, ids = np.vstack(c["v"].to_list()), c["ids"].to_list()
            sq = (x * x).sum(axis=1)
            for i in range(0, len(q), 256):
                y, qid = np.vstack(q["v"].iloc[i:i + 256].to_list()), q["query_id"].iloc[i:i + 256].to_list()
                d = sq[None, :] - 2 * y @ x.T + (y * y).sum(axis=1)[:, None]
                m = min(k + 1, len(x))
                edge = np.partition(d, m - 1, axis=1)[:, m - 1]
                for row, (dist, e) in enumerate(zip(d, edge)):
                    near = np.flatnonzero(dist <= e + 1e-9 * (1 + abs(e)))  # rounding must not lose a tie
                    exact = np.sqrt(((x[near] - y[row]) ** 2).sum(axis=1))
                    out["query_id"] += [qid[row]] * len(near)
                    out["ids"] += [ids[j] for j in near]
                    out["score"] += exact.tolist()
        return pd.DataFrame(out)

    key = ["part", "block"]
    found = queries.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(search, "query_id bigint, ids array<bigint>, score double")
    pairs = (found.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
             .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
