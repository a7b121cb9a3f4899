"""Sum-of-squares packing of token sequences.

A document's tokens end with one end-of-text id. Documents of over `capacity` tokens are cut into pieces of `capacity`,
of which the first may be shorter, so each document leaves at most one piece that shares a sequence. Such pieces are
placed, longest first, into the open bin that leaves the sum over all gaps of (open bins with this gap) squared smallest;
equal sums go to the tighter bin, and a bin is opened only where none has room.

Blocks of documents are packed where they are read. Bins that stay open in a block are few; they are packed once more
with those of other blocks, as pieces of their filled length, in groups of bounded size. No text is shuffled.

Null texts count as empty (one token), documents are told apart by `doc_id` and, if it repeats, by row; further columns
are ignored; an empty table gives no rows."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .pretokens import PieceMemory
from .words import as_strings, slices

CAPACITY = 1024
BLOCK = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, gap long"


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to `capacity`), and the gap of each bin."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1)
    standing: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size = int(sizes[i])
        change = 2 * (count[:capacity - size] - count[size:capacity] + 1)
        change[:1] = 1 - 2 * count[size:size + 1][:len(change)]  # a full bin counts no more
        change[count[size:capacity] == 0] = np.inf
        best = int(np.argmin(change)) if len(change) else 0
        if len(change) and change[best] < np.inf:
            gap = best + size
            bin_ = standing[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_ = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = bin_, capacity - gap
        gaps[bin_] = gap - size
        if gap > size:
            standing[gap - size].append(bin_)
            count[gap - size] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pieces_of(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be short."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((start, capacity) for start in range(first, total, capacity))]


def _packed_blocks(make: Callable[[], PieceMemory], end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, rows, next_bin = make(), [], TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()

        def block() -> pa.RecordBatch:
            nonlocal next_bin
            columns = [np.array(c, np.int64) for c in zip(*rows)]
            bins, offsets, gaps = sum_of_squares(columns[3], capacity)
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:]),
                 pa.array(bins + next_bin), pa.array(offsets), pa.array(gaps[bins])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "gap"])
            next_bin += len(gaps)
            rows.clear()
            return out

        for part in slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), as_strings(part.column("text")).to_pylist()):
                ids = memory.ids(text) + end
                for number, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    rows.append((doc, number, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            if len(rows) >= BLOCK:
                yield block()
        if rows:
            yield block()

    return run


def _repack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        names = np.asarray(table.column("bin"))
        bins, offsets, _ = sum_of_squares(np.asarray(table.column("filled")), capacity)
        leader = np.zeros(len(names), np.int64)
        leader[bins[offsets == 0]] = names[offsets == 0]  # a sequence is called after the bin at its head
        return pa.table({"bin": names, "sequence_id": leader[bins], "base": offsets})

    return run


def pack(docs: DataFrame, make: Callable[[], PieceMemory], end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `make` builds the encoder on a worker. The pieces (no texts or tokens) are kept in the checkpoint folder, so that
    their bins are the same for every reader."""
    placed = checkpointed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                          .mapInArrow(_packed_blocks(make, end_id, capacity), PIECES))
    open_bins = placed.where("gap > 0").groupBy("bin").agg((capacity - F.max("gap")).alias("filled"))
    groups = max(1, -(-placed.where("gap > 0 AND at = 0").count() // BLOCK))
    moved = (open_bins.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("part"))
             .applyInArrow(_repack(capacity), "bin long, sequence_id long, base long"))
    return placed.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))
