"""Token counts from flat token files by a scan for separators.

`write_token_files` lays tokens out as training sets are often kept: one file per partition, nothing but token ids of two
or four bytes, each document followed by the end-of-document id, no index. `count_tokens` reads such files in blocks of
bounded size, each block a row of a Spark table. A block is searched at once with numpy; it tells the documents that end in
it and how many tokens follow its last separator. A document may lie across many blocks: per file, a prefix scan over the
blocks (a window of one row per block) gives the number of documents ended before each block and the tokens carried into it.

Files are written and read through Arrow's file systems, so the folder may be any store Arrow knows; a repeated or
speculative task writes under its own name first and then moves the file to the partition's name.

An empty file, or one without documents, gives no rows; tokens after the last separator are a document that never ended and
are reported with `ended` false. Null texts count as empty: no tokens and one separator."""
from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpointed
from .pretokens import PieceMemory
from .words import as_strings, slices

BLOCK_TOKENS = 1 << 20


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str, make: Callable[[], PieceMemory], end_id: int, width: int = 2) -> DataFrame:
    """Write one flat file per partition of `docs` and return which document is which of each file: file, place (from 0), doc_id.
    The documents' order stands nowhere in the files. The returned table is stored, so the files are written once."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.tok"
        own = posixpath.join(base, f"_{uuid.uuid4().hex}")
        store.create_dir(base, recursive=True)
        memory, place = make(), 0
        with store.open_output_stream(own) as out:
            for part in slices(batches):
                ids = b"".join(memory.ids(text) + b"\xff\xff\xff\xff" for text in as_strings(part.column("text")).to_pylist())
                tokens = np.frombuffer(ids, "<u4").copy()
                tokens[tokens == 0xFFFFFFFF] = end_id
                out.write(tokens.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), pa.array(np.arange(place, place + part.num_rows)), part.column("doc_id")],
                                                 names=["file", "place", "doc_id"])
                place += part.num_rows
        store.move(own, posixpath.join(base, name)) if place else store.delete_file(own)

    return checkpointed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, place long, doc_id long"))


def blocks_of(spark: SparkSession, folder: str, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, offset and length in bytes: a row for each block of each file. The folder is listed by Spark's reader."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size")))
    last = F.floor((F.col("size") - 1) / (block * width))
    return (files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
            .select("file", "block", (F.col("block") * block * width).alias("offset"),
                    F.least(F.lit(block * width), F.col("size") - F.col("block") * block * width).alias("length")))


def _scan(folder: str, end_id: int, width: int):
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(posixpath.join(base, row["file"])) as file:
                    tokens = np.frombuffer(file.read_at(row["length"], row["offset"]), kind)
                ends = np.flatnonzero(tokens == end_id)
                inner = np.diff(ends, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["block"]]), pa.array([inner.tolist()], pa.list_(pa.int64())),
                     pa.array([len(ends)], pa.int64()), pa.array([len(tokens) - 1 - (int(ends[-1]) if len(ends) else -1)], pa.int64())],
                    names=["file", "block", "counts", "ended", "tail"])

    return run


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the flat files in `folder`: file, place (from 0), n_tokens (without the separator), ended."""
    blocks = blocks_of(spark, folder, width, block)
    found = blocks.repartition(F.col("file"), F.col("block")).mapInArrow(
        _scan(folder, end_id, width), "file string, block long, counts array<long>, ended long, tail long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # tokens carried into a block: all tails since (and with) the last block that held a separator
    total = F.coalesce(F.sum("tail").over(before), F.lit(0))
    settled = F.coalesce(F.max(F.when(F.col("ended") > 0, F.col("tails_before"))).over(before), F.lit(0))
    rows = (found.withColumn("tails_before", total).withColumn("first", F.coalesce(F.sum("ended").over(before), F.lit(0)))
            .withColumn("carried", F.col("tails_before") - settled)
            .withColumn("last", F.lead("block").over(order).isNull()))
    ended = (rows.select("file", "first", "carried", F.posexplode("counts").alias("i", "count"))
             .select("file", (F.col("first") + F.col("i")).alias("place"),
                     F.when(F.col("i") == 0, F.col("count") + F.col("carried")).otherwise(F.col("count")).alias("n_tokens"), F.lit(True).alias("ended")))
    rest = F.col("tail") + F.when(F.col("ended") == 0, F.col("carried")).otherwise(0)
    open_ = rows.where("last").select("file", (F.col("first") + F.col("ended")).alias("place"), rest.alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(open_)
