"""Compression of vectors to codes of one codebook entry per part, with codebooks found by pruned exact assignment (LAESA pivots).

1. Components x become integers floor(4096 * x); a vector is cut into `PARTS` equal consecutive parts. Codebooks start as the
   parts of the vectors with the `ENTRIES` smallest ids.
2. `PIVOTS` entries of each first codebook, chosen far from each other, are its fixed pivots. The distances of every part to its pivots
   are computed once and stored with the integers.
3. A round only computes the distances from pivots to entries. By the triangle inequality |d(part, pivot) - d(entry, pivot)| bounds the
   distance of part and entry from below; per part the entries are visited by rising bound, exact squared distances are evaluated in
   integers, and what has a bound above the best distance so far is never evaluated. Pivot distances are rounded down to integers
   and the bounds lowered by one for it, so that no rounding ever drops the nearest entry; ties go to the lower index.
4. Each task adds up its parts per entry, Spark adds up the tasks, and the driver sees entries only (parts x entries x length of a part).

Rows whose vector is null or holds null or non-finite components are dropped. Of vectors of different lengths only those of the most frequent
length take part (ties: the longer), and none if this length is no multiple of the number of parts. Rows without an id take part but
start no codebook before those that have one; of rows with one id the one with the smaller vector comes first. With fewer rows than entries the
codebooks are as short. Integers saturate at 2 ** 52; where products could exceed a long, Python integers are used, and an error that no
long can hold is null."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from ..sources.scratch import fresh_folder
from .whitening import matrix, of_one_length

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
LIMIT = float(1 << 52)
SLICE_ROWS = 4096


def integer_rows(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and x (array of longs) of the rows without null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(SCALE), F.lit(LIMIT)), F.lit(-LIMIT))))
    return vectors.where(v.isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))


def _wide(*arrays: np.ndarray) -> bool:
    """Whether squared distances of these rows could exceed a long."""
    top = max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays)
    return 4 * top * top * arrays[0].shape[-1] >= 1 << 61


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as longs, or as Python integers where a long could be too small."""
    difference = a.astype(object) - b.astype(object) if a.dtype == object or _wide(a, b) else a - b
    return (difference * difference).sum(-1)


def floor_roots(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(values)
    roots = np.sqrt(values.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > values
    return roots + ((roots + 1) * (roots + 1) <= values)


def far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """`count` of the entries: the first, then always the one farthest from those chosen (ties: the first such)."""
    chosen = [0] if len(entries) else []
    while len(chosen) < min(count, len(entries)):
        nearest = np.min([squared(entries, entries[None, c]) for c in chosen], axis=0)
        chosen.append(int(np.argmax(nearest)))
    return entries[chosen]


def assign(part: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row, its squared distance, and how many distances were evaluated."""
    if _wide(part, book):
        part, to_pivots, book, pivots = (a.astype(object) for a in (part, to_pivots, book, pivots))
    between = floor_roots(np.stack([squared(book, pivot[None]) for pivot in pivots], 1))
    gap = np.maximum(np.abs(to_pivots[:, None, :] - between[None]).max(2) - 1, 0)
    bound = gap * gap
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(part))
    which = order[:, 0].astype(np.int64)
    best = squared(part, book[which])
    evaluated = len(rows)
    for turn in range(1, len(book)):
        entry = order[rows, turn]
        near = bound[rows, entry] <= best[rows]  # an equal one may have the lower index
        rows, entry = rows[near], entry[near]  # later entries have greater bounds: a row that stops has stopped
        if not len(rows):
            break
        distance = squared(part[rows], book[entry])
        evaluated += len(rows)
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < which[rows]))
        which[rows[better]], best[rows[better]] = entry[better], distance[better]
    return which, best, evaluated


def _with_pivots(width: int, pivots: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                pieces = np.split(matrix(part.column("x"), width), PARTS, axis=1)
                roots = np.stack([floor_roots(np.stack([squared(piece, pivot[None]) for pivot in own], 1)) for piece, own in zip(pieces, pivots)], 1)
                flat = pa.array(roots.reshape(-1).astype(np.int64))
                each = PARTS * len(pivots[0])
                offsets = pa.array(np.arange(0, (part.num_rows + 1) * each, each, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*part.schema.names, "to_pivots"])

    return run


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    for begin in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(begin, SLICE_ROWS)
        to_pivots = np.asarray(part.column("to_pivots").flatten(), np.int64).reshape(part.num_rows, PARTS, -1)
        yield part, np.split(matrix(part.column("x"), width), PARTS, axis=1), to_pivots


def _round(rows: DataFrame, width: int, books: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The books whose entries are the floors of the means of the parts next to them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(book.shape, object) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        for batch in batches:
            for _, pieces, to_pivots in _pieces(batch, width):
                for p, piece in enumerate(pieces):
                    which, _, _ = assign(piece, to_pivots[:, p], books[p], pivots[p])
                    fits = len(piece) * max(int(piece.max()), -int(piece.min())) < 1 << 62
                    few = np.zeros(books[p].shape, np.int64 if fits else object)
                    np.add.at(few, which, piece if fits else piece.astype(object))
                    sums[p] += few
                    counts[p] += np.bincount(which, minlength=len(books[p]))
        columns = [(p, e, i, int(counts[p][e]), Decimal(int(sums[p][e, i])))
                   for p in range(PARTS) for e in range(len(books[p])) if counts[p][e] for i in range(books[p].shape[1])]
        if columns:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), kinds)], names=["p", "e", "i", "n", "total"])

    parts = rows.select("x", "to_pivots").mapInArrow(run, "p int, e int, i int, n long, total decimal(38,0)")
    new = [book.copy() for book in books]
    for r in parts.groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # bounded: the size of the books
        new[r["p"]][r["e"], r["i"]] = int(r["total"]) // r["n"]
    return new


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


OUTPUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def codes(rows: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, code, error, label_error, codebooks_sha256 for every row of `rows` (as `integer_rows` gives them), and the codebooks.
    The integers with their pivot distances, and the last assignment, are stored in the shared folder."""
    spark = rows.sparkSession
    rows, width = of_one_length(rows)
    if not width or width % PARTS:
        return spark.createDataFrame([], OUTPUT), []
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()  # ENTRIES rows
    books = np.split(np.array([r["x"] for r in first], np.int64), PARTS, axis=1)
    pivots = [far_apart(book, PIVOTS) for book in books]
    folder = fresh_folder(spark, "vector-parts")
    kind = rows.schema["label"].dataType.simpleString()
    rows.mapInArrow(_with_pivots(width, pivots), f"vec_id long, label {kind}, x array<long>, to_pivots array<long>").write.parquet(folder)
    stored = spark.read.parquet(folder)
    for _ in range(ROUNDS):
        books = _round(stored, width, books, pivots)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pieces, to_pivots in _pieces(batch, width):
                found = [assign(piece, to_pivots[:, p], books[p], pivots[p]) for p, piece in enumerate(pieces)]
                entry = np.stack([which for which, _, _ in found], 1).astype(np.uint8)
                error = [Decimal(int(e)) for e in sum(best.astype(object) for _, best, _ in found)]
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id"), part.column("label"), pa.array([row.tobytes().hex() for row in entry]),
                    pa.array(error, pa.decimal128(38, 0))], names=["vec_id", "label", "code", "error"])

    assigned = checkpointed(stored.mapInArrow(last, f"vec_id long, label {kind}, code string, error decimal(38,0)"))
    totals = assigned.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = assigned.join(totals, assigned["label"].eqNullSafe(totals["of_label"]))
    whole = lambda c: F.when(F.col(c) <= (1 << 63) - 1, F.col(c)).cast("long").alias(c)
    return joined.select("vec_id", "code", whole("error"), whole("label_error"), F.lit(digest(books)).alias("codebooks_sha256")), books
