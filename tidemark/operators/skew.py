"""Finding and splitting groups that hold too many rows, and running sums over long groups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PART_ROWS = 1_000_000


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int | None = None, weight: Column | None = None) -> DataFrame:
    """Into how many parts of ``rows`` rows to split each group (``_parts``), for those that need more
    than one, however many they are. ``weight`` lets one row of ``df`` stand for several. The counting
    is one partial aggregation, and almost always finds nothing."""
    rows = PART_ROWS if rows is None else rows
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    return counts.where(F.col("_n") > rows).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))


def spread_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], copied: Column, spread: Sequence[str]) -> DataFrame:
    """Add ``_part``: a row of a hot group goes to one part, by a hash of ``spread``, or to all of them
    where ``copied`` holds. Rows of other groups have part 0. The planner joins ``hot`` by its size."""
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    one = F.array(F.pmod(F.xxhash64(*spread), parts).cast("int"))
    targets = F.when(copied, F.sequence(F.lit(0), parts - 1)).otherwise(one)
    return df.join(hot, list(keys), "left").withColumn("_part", F.explode(targets)).drop("_parts")


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, value: Column | None = None,
            descending: bool = False) -> DataFrame:
    """Add ``_before`` (sum of ``value`` over earlier rows of the group) and ``_total`` (whole group).

    ``bucket`` must not decrease along ``order`` (not increase when ``descending``). Each bucket is
    summed first, so the only window over a whole group runs on one row per bucket, and rows are
    sorted within (group, bucket)."""
    value = F.lit(1) if value is None else value
    keys = list(by)
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    along = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
                       F.sum("_sum").over(whole).alias("_total"))
    local = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(sums, keys + ["_bucket"])
            .withColumn("_before", F.col("_base") + F.coalesce(F.sum("_value").over(local), F.lit(0)))
            .drop("_bucket", "_value", "_base"))
