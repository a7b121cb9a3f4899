"""Attention over vectors that stay in their table.

An ask is an event, the id of its query's vector and the id of one step's vector. Asks and vectors meet in *tiles*: a tile holds a share of the
events, one block of vectors for queries and one for steps, so ids travel with every step and a vector once per tile, whatever the planner would
broadcast. A tile returns one row per event: the highest score, the sum of exponentials below it and the weighted sums. Rows of an event that met
several blocks are brought to the highest score of all."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK, TILE, CHUNK = 1 << 16, 1 << 20, 1 << 15
#: A vector weighs about as much as so many asks.
WEIGHT = 10
PARTS = "top array<double>, total array<double>, sums array<double>, width int"


def attend_rows(asks: DataFrame, vectors: DataFrame, heads: int = 1, by: str = "narration_id", entries: Sequence[int] | None = None,
                most: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per event the ``attended`` vector and ``top_weight``, the largest weight of each head: as ``attend``, for asks ``(by, query_id, step_id)``
    that name vectors ``(id, vector)``. A null or unknown step is none, an unknown query has no scores; an event without scores has zeros.

    ``entries`` (default: all) says which entries of the attended vector are wanted; scores take whole vectors. Vectors are counted at once, asks
    too unless ``most`` bounds their number. There are as many tiles as shuffle partitions, fewer where vectors would weigh more than asks, more
    where a tile would hold over a million asks. Where the vectors are so many that tiles take more copies of them than there are asks, they join
    the asks one by one instead."""
    stored = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", F.col("vector").alias("stored"))
    n = vectors.count()
    most = asks.count() if most is None else most
    blocks = max(1, math.ceil(n / block))
    tiles = min(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // (WEIGHT * max(1, n)))
    shares = math.ceil(max(1, tiles, math.ceil(most / TILE)) / blocks ** 2)
    schema = f"{by} {dict(asks.dtypes)[by]}, "
    if n * shares * (2 * blocks - 1) > most:
        for name in ("step_id", "query_id"):
            asks = asks.join(stored.select(F.col("id").alias(name), F.col("stored").alias(f"_{name}")), name, "left")
        parts = asks.select(by, "_query_id", "_step_id").mapInArrow(scored_steps(by, heads, entries), schema + PARTS)
    else:
        def dealt(column: str, n: int):
            return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

        def numbers(n: int):
            return F.sequence(F.lit(0), F.lit(n - 1))

        def tile(share, query, step):
            return ((share.cast("long") * blocks + query) * blocks + step).alias("_tile")

        sent = asks.select(by, "query_id", "step_id", tile(dealt(by, shares), dealt("query_id", blocks), dealt("step_id", blocks)))
        own, places, share = dealt("id", blocks), numbers(blocks), F.col("_share")
        tiles_of = F.array_union(F.transform(places, lambda i: tile(share, own, i)), F.transform(places, lambda i: tile(share, i, own)))
        met = stored.withColumn("_share", F.explode(numbers(shares))).select("id", "stored", F.explode(tiles_of).alias("_tile"))
        parts = sent.groupBy("_tile").cogroup(met.groupBy("_tile")).applyInArrow(scored_tile(by, heads, entries), schema + PARTS)
    gathered = parts.groupBy(by).agg(F.collect_list(F.struct("top", "total", "sums", "width")).alias("parts"))
    return gathered.mapInArrow(joined(by, heads, entries), schema + "attended array<double>, top_weight array<double>")


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * width), pa.array(rows.ravel(), pa.float64()))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of equal length; null and empty ones become zeros."""
    some = np.asarray(lists.value_lengths().fill_null(0))
    width = int(some.max(initial=0)) if width is None else width
    out = np.zeros((len(lists), width))
    out[some > 0] = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(-1, width or 1)[:, :width]
    return out


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _partial(query: np.ndarray, value: np.ndarray, ok: np.ndarray, begin: np.ndarray, heads: int, entries: Sequence[int] | None):
    """Per event (rows from ``begin`` on): the highest score, the sum of exponentials, the weighted sums of ``entries``."""
    n, dims = value.shape
    if dims % heads:
        raise ValueError("heads must divide the length of the vectors")
    width = dims // heads
    taken = np.arange(dims) if entries is None else np.asarray(entries, dtype=int)
    # NaN in a step without a score must not reach the sums
    value, query = np.where(ok[:, None], value, 0.0), np.where(ok[:, None], query, 0.0)
    score = (value * query).reshape(n, heads, width).sum(axis=2) / np.sqrt(max(1, width))
    score = np.where(ok[:, None], score, -np.inf)
    top = np.maximum.reduceat(score, begin, axis=0)
    count = np.diff(np.append(begin, n))
    e = np.where(ok[:, None], np.exp(score - np.repeat(np.where(np.isfinite(top), top, 0.0), count, axis=0)), 0.0)
    weighted = e[:, taken // width] * value[:, taken] if dims else np.zeros((n, len(taken)))
    return top, np.add.reduceat(e, begin, axis=0), np.add.reduceat(weighted, begin, axis=0)


def _parts(names: pa.Array, found: list[tuple], width: int, heads: int, entries: Sequence[int] | None) -> list[pa.Array]:
    none = (np.zeros((0, heads)), np.zeros((0, heads)), np.zeros((0, len(entries or ()))))
    top, total, sums = (np.concatenate(x) for x in zip(*found)) if found else none
    return [names, _lists(top), _lists(total), _lists(sums), pa.array(np.full(len(top), width, "int32"))]


def scored_tile(by: str, heads: int, entries: Sequence[int] | None):
    """Arrow function ``(asks, vectors) -> (by, top, total, sums, width)`` of a tile, one row per event. Rows of an event are brought together by
    one sort of numbers, and vectors are looked up for some thousand rows at a time."""
    def run(asks: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = np.asarray(_one(vectors, "id"))
        order = np.argsort(ids, kind="stable")
        ids, stored = ids[order], _matrix(_one(vectors, "stored"))[order]
        stored = np.concatenate([stored, np.zeros((1, stored.shape[1]))])  # the last row: no vector

        def places(name: str) -> np.ndarray:
            column = _one(asks, name)
            wanted, none = np.asarray(column.fill_null(0)), np.asarray(column.is_null())
            at = np.searchsorted(ids, wanted)
            return np.where(none | (at == len(ids)) | (np.append(ids, 0)[at] != wanted), len(ids), at)

        events = _one(asks, by).dictionary_encode(null_encoding="encode")
        codes = np.asarray(events.indices)
        order = np.argsort(codes, kind="stable")
        codes, query, value = codes[order], places("query_id")[order], places("step_id")[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(codes) + CHUNK, CHUNK)))
        found = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            some = slice(starts[a], starts[z] if z < len(starts) else len(codes))
            q, v = query[some], value[some]
            found.append(_partial(stored[q], stored[v], (q < len(ids)) & (v < len(ids)), starts[a:z] - starts[a], heads, entries))
        arrays = _parts(events.dictionary.take(pa.array(codes[starts])), found, stored.shape[1] // heads, heads, entries)
        return pa.Table.from_arrays(arrays, names=[by, "top", "total", "sums", "width"])

    return run


def scored_steps(by: str, heads: int, entries: Sequence[int] | None):
    """Arrow mapper ``(by, query, step)`` with the vectors themselves ``-> (by, top, total, sums, width)``, one row per step."""
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q, v = batch.column(1), batch.column(2)
            width = max(int(np.asarray(x.value_lengths().fill_null(0)).max()) for x in (q, v))
            found = [_partial(_matrix(q, width), _matrix(v, width), np.asarray(q.is_valid()) & np.asarray(v.is_valid()),
                              np.arange(batch.num_rows), heads, entries)]
            yield pa.RecordBatch.from_arrays(_parts(batch.column(0), found, width // heads, heads, entries), names=[by, "top", "total", "sums", "width"])

    return run


def joined(by: str, heads: int, entries: Sequence[int] | None):
    """Arrow mapper ``(by, parts) -> (by, attended, top_weight)``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = batch.column(1).flatten()
            count = np.asarray(batch.column(1).value_lengths())
            begin = np.concatenate([[0], np.cumsum(count)[:-1]])
            top, total, sums = (_matrix(parts.field(x)) for x in ("top", "total", "sums"))
            most = np.maximum.reduceat(top, begin, axis=0)
            scale = np.where(total == 0, 0.0, np.exp(top - np.repeat(np.where(np.isfinite(most), most, 0.0), count, axis=0)))
            width = max(1, int(np.asarray(parts.field("width")).max()))
            head = (np.arange(sums.shape[1]) if entries is None else np.asarray(entries, dtype=int)) // width
            total, sums = np.add.reduceat(total * scale, begin, axis=0), np.add.reduceat(sums * scale[:, np.minimum(head, heads - 1)], begin, axis=0)
            some = total != 0
            total = np.where(some, total, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sums / total[:, np.minimum(head, heads - 1)]), _lists(np.where(some, 1.0 / total, 0.0))],
                                             names=[by, "attended", "top_weight"])

    return run
