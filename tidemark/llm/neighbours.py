"""Approximate nearest neighbours by collision counting.

Each block of vectors is indexed by `PROJECTIONS` random lines: per line one sorted array of all projections. A query opens
a window around its own projection on every line; vectors inside a window collide with it on that line. Virtual rehashing
widens all windows by one factor at a time, so that only the newly covered ends of the sorted arrays are read. A vector that
has collided on at least `THRESHOLD` of the lines is verified by its exact distance. A query is done in a block when its
k verified best lie within the radius for which the windows are sized (a neighbour inside this radius has had well over a
99 % chance of being counted), or when the windows cover the block. Nothing caps the number of verified vectors.

Every vector is in exactly one block, by a hash of its id; queries meet all blocks, in parts of bounded size, and the best
of all blocks are merged per query. Vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without an id. Vectors of other length than the query's aren't compared with it. Equal distances go to the smaller id."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS, WIDTH, THRESHOLD, GROWTH = 64, 2.72, 0.7, 1.25
BLOCK_VECTORS, PART_QUERIES, LEAST_BLOCKS = 1 << 16, 1 << 14, 12


class Lines:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.lines = rng.normal(size=(vectors.shape[1], PROJECTIONS))
        self.vectors = vectors
        projected = vectors @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def search(self, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the verified vectors that can be among the k best; `own` marks what is left out."""
        n, lines = len(self.vectors), range(PROJECTIONS)
        centre = query @ self.lines
        middle = [int(np.searchsorted(self.sorted[j], centre[j])) for j in lines]
        reach = [min(self.sorted[j, min(n - 1, middle[j] + k // 2)] - centre[j], centre[j] - self.sorted[j, max(0, middle[j] - 1 - k // 2)]) for j in lines]
        radius = max(2 * float(np.median(np.abs(reach))) / WIDTH, 1e-9 * float(1 + np.abs(centre).max()))
        low, high = np.array(middle), np.array(middle)
        count = np.zeros(n, np.int32)
        verified = own.copy()
        ids, distances = np.zeros(0, np.int64), np.zeros(0)
        needed = int(np.ceil(THRESHOLD * PROJECTIONS))
        while True:
            half = radius * WIDTH / 2
            fresh = []
            for j in lines:
                begin, end = np.searchsorted(self.sorted[j], (centre[j] - half, centre[j] + half))
                begin, end = min(int(begin), low[j]), max(int(end), high[j])
                fresh += [self.order[j, begin:low[j]], self.order[j, high[j]:end]]
                low[j], high[j] = begin, end
            count += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            new = np.flatnonzero((count >= needed) & ~verified)
            if len(new):
                verified[new] = True
                ids = np.concatenate([ids, new])
                distances = np.concatenate([distances, np.sqrt(((self.vectors[new] - query) ** 2).sum(1))])
            covered = bool((low == 0).all() and (high == n).all())
            if covered or len(ids) >= k and np.partition(distances, k - 1)[k - 1] <= radius:
                return ids, distances
            radius *= GROWTH


def _search_block(k: int):
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
                flat = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64)
                return np.asarray(table.column("vec_id"), np.int64), flat.reshape(table.num_rows, -1)

            vectors = vectors.sort_by("vec_id")
            names, block = matrix(vectors)
            index = Lines(block)
            for name, query in zip(*matrix(queries)):
                ids, distances = index.search(query, names == name, k)
                best = np.lexsort((names[ids], distances))[:k]
                out["query_id"].append(np.full(len(best), name))
                out["vec_id"].append(names[ids[best]])
                out["score"].append(distances[best])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, float if c == "score" else np.int64) for c, v in out.items()})

    return run


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. Both frames are as `usable` gives them."""
    blocks = max(LEAST_BLOCKS, -(-vectors.count() // BLOCK_VECTORS))
    parts = max(1, -(-queries.count() // PART_QUERIES))
    placed = vectors.select(
        "vec_id", "vector", F.size("vector").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = queries.select(
        "vec_id", "vector", F.size("vector").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    keys = ["size", "block", "part"]
    found = placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
