"""Comparing two tables: coverage, field mismatches, order and timelines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def audit(actual: DataFrame, expected: DataFrame, on: str, compare: Sequence[str], file_flag: str | None = None) -> DataFrame:
    """One row: how well ``actual`` covers ``expected``, with duplicates, unknown ids, rows whose
    fields differ and (with a boolean ``file_flag``) rows whose file is missing.

    ``expected`` must have unique keys; repeated keys in ``actual`` only repeat their own row."""
    right = expected.select(on, *[F.col(c).alias(f"_{c}") for c in compare], F.lit(True).alias("_known"))
    left = actual.select(on, *compare, F.lit(True).alias("_given"),
                         (F.col(file_flag) if file_flag else F.lit(True)).alias("_file"))
    j = left.join(right, on, "full_outer")
    given, known = F.col("_given").isNotNull(), F.col("_known").isNotNull()
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    per = j.groupBy(on).agg(F.count("_given").alias("n"), F.max(known).alias("known"),
                            F.count_if(given & known & differs).alias("wrong"),
                            F.count_if(given & ~F.col("_file")).alias("lost"))
    here = F.col("n") > 0
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(here).alias("unique_events"),
                   F.count_if("known").alias("annotation_events"), F.count_if(here & F.col("known")).alias("covered_events"),
                   F.count_if(~here).alias("missing_events"), F.coalesce(F.sum(F.when(here, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
                   F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("unknown_rows"),
                   F.coalesce(F.sum("wrong"), F.lit(0)).alias("mismatched_rows"),
                   F.coalesce(F.sum("lost"), F.lit(0)).alias("missing_files"))


def audit_rows(actual: DataFrame, expected: DataFrame, on: str, compare: Sequence[str]) -> DataFrame:
    """The ids behind ``audit`` as violations: duplicate, unknown, mismatched and missing."""
    right = expected.select(on, *[F.col(c).alias(f"_{c}") for c in compare], F.lit(True).alias("_known"))
    j = actual.select(on, *compare, F.lit(True).alias("_given")).join(right, on, "full_outer")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    given, known = F.col("_given").isNotNull(), F.col("_known").isNotNull()
    per = j.groupBy(on).agg(F.count("_given").alias("n"), F.max(known).alias("known"),
                            F.count_if(given & known & differs).alias("wrong"))
    found = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate"), F.when(~F.col("known"), "unknown"),
                                    F.when(F.col("wrong") > 0, "mismatched"), F.when(F.col("n") == 0, "missing")))
    return per.select(F.explode(found).alias("check"), F.col(on).cast("string").alias("id"),
                      F.concat(F.lit("rows "), F.col("n")).alias("detail"))


def same_order(left: DataFrame, right: DataFrame, keys: Sequence[str], position: Sequence[str] = ("position",)) -> DataFrame:
    """Both tables must hold the same key values at the same positions."""
    r = right.select(*position, *[F.col(c).alias(f"_{c}") for c in keys], F.lit(True).alias("_r"))
    j = left.select(*position, *keys, F.lit(True).alias("_l")).join(r, list(position), "full_outer")
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    for c in keys:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.where(bad).select(F.lit("order").alias("check"), F.concat_ws("/", *position).alias("id"),
                               F.concat_ws(" ", keys[0], F.lit("against"), f"_{keys[0]}").alias("detail"))


def same_timeline(bank_a: DataFrame, bank_b: DataFrame) -> DataFrame:
    """Two banks must hold the same clip times per video."""
    a = bank_a.select("video_id", "t_end_s").distinct().withColumn("_a", F.lit(True))
    b = bank_b.select("video_id", "t_end_s").distinct().withColumn("_b", F.lit(True))
    j = a.join(b, ["video_id", "t_end_s"], "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return j.select(F.lit("timeline").alias("check"), F.col("video_id").alias("id"),
                    F.concat(F.lit("time "), F.col("t_end_s"), F.when(F.col("_a").isNull(), " only in second").otherwise(" only in first")).alias("detail"))
