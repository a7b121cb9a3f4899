"""One pass over several sorted sides of a timeline.

Sides (questions, clips, actions, frames) are cut into buckets of time and put on *shelves*: a hash of the group's keys and its
bucket. A shelf goes through one Arrow function, which sorts its sides once and answers every kind of question of every group on
it by merging, so that a plan has one shuffle however many sides it matches. A row lies in each bucket in which it can matter, and no
pairs are produced. Groups with more questions than `skew.PART_ROWS` are split into parts, to which their facts are copied; whether there are any is
looked up when the plan is built, by one aggregation over the questions' times."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .skew import hot_groups, spread_hot

SHELVES_PER_TASK = 4


def buckets(lo: Column, hi: Column, width: float) -> Column:
    """Buckets from `lo` to `hi`; a single null bucket where either is null or not finite, so that the row isn't lost."""
    w, top = F.lit(float(width)), F.lit(float("inf"))
    sound = (F.abs(lo) < top) & (F.abs(hi) < top) & (lo <= hi)
    return F.when(F.coalesce(sound, F.lit(False)), F.sequence(F.floor(lo / w), F.floor(hi / w))).otherwise(F.array(F.lit(None).cast("long")))


def swept(asks: DataFrame, facts: Sequence[DataFrame], by: Sequence[str], kernel: Callable[[pa.Table], pa.Table], schema: str,
          weight: int = 1, hot_rows: int | None = None, spread: Sequence[str] = ("narration_id",)) -> DataFrame:
    """`kernel` over shelves of all sides. Every side has `by` and `_b`; the sides' other columns are null in the rows of the others,
    `_side` is 0 for `asks` and counts `facts` from 1. An ask stands for `weight` questions."""
    group = [*by, "_b"]
    rows = asks.withColumn("_side", F.lit(0))
    for side, fact in enumerate(facts, 1):
        rows = rows.unionByName(fact.withColumn("_side", F.lit(side)), allowMissingColumns=True)
    hot = hot_groups(asks.select(*group), group, hot_rows, F.lit(weight))
    if hot.isEmpty():
        rows = rows.withColumn("_part", F.lit(0))
    else:
        rows = spread_hot(rows, hot, group, F.col("_side") > 0, list(spread))
    shelves = SHELVES_PER_TASK * int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shelf = F.pmod(F.xxhash64(*group, "_part"), F.lit(shelves)).alias("_shelf")
    return rows.groupBy(shelf).applyInArrow(kernel, schema)


def group_ids(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each row, the same for rows that agree on all keys."""
    ids = np.zeros(table.num_rows, np.int64)
    for key in keys:
        column = table.column(key).combine_chunks()
        codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices).astype(np.int64)
        ids = ids * (codes.max(initial=0) + 1) + codes
        ids = np.unique(ids, return_inverse=True)[1]
    return ids


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """Doubles with NaN for null."""
    values = table.column(column).combine_chunks()
    return np.asarray(values.cast(pa.float64()).fill_null(float("nan")))


def last_before(fact_group: np.ndarray, fact_time: np.ndarray, group: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Position of the last fact of the group at or before each time, -1 for none. Of facts at one time the one that comes last in the
    arrays is taken; NaN asks nothing."""
    n = len(fact_time)
    order = np.lexsort((np.repeat([0, 1], [n, len(time)]), np.concatenate([fact_time, time]), np.concatenate([fact_group, group])))
    last = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))
    asked = np.flatnonzero(order >= n)
    fact = np.where(last[asked] >= 0, order[last[asked]], -1)
    found = np.full(len(time), -1)
    found[order[asked] - n] = fact
    some = found >= 0
    some[some] = fact_group[found[some]] == group[some]
    return np.where(some & ~np.isnan(time), found, -1)


def first_after(fact_group: np.ndarray, fact_time: np.ndarray, group: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Position of the first fact of the group at or after each time, -1 for none; of facts at one time the first in the arrays."""
    found = last_before(fact_group[::-1], -fact_time[::-1], group, -time)
    return np.where(found >= 0, len(fact_time) - 1 - found, -1)
