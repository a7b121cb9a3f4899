"""A corpus run in stages, each working on all that the stage before it has kept.

Toxic documents go; later copies of lines go, also where a line is repeated alone; of near-duplicates (five-word shingles, similarity 0.8 or more) the one
with the smallest id stays; passages of 50 words or more that an earlier document has go; what is left is packed into sequences.
Documents from which lines or passages took every word go as well. `n_chars` follows the text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from tidemark.llm.queries import english_pieces
from tidemark.sources.scratch import fresh_folder


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of `docs`, with the number of code points as it is now."""
    return changed.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = line_dedup.dedup(docs, least=1).where(r"n_removed = 0 OR text RLIKE '[^ \\t\\n\\x0B\\f\\r]'")
    return _like(docs, rest)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, substring_dedup.remove(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, english_pieces, 2)


STAGES = [("toxicity", toxic_documents), ("line dedup", repeated_lines), ("near-duplicates", near_copies), ("substring dedup", repeated_passages), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
