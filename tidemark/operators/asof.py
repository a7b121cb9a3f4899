"""As-of matching: the last fact at or before a time, or the first at or after it.

Time is cut into buckets of ``width`` seconds, so a long or busy timeline is spread over many tasks
instead of one. Facts are reduced to one per time before anything else; a bucket with very many
probes is split further and its (bounded) facts are copied to each part. No pairs are produced: each
probe takes its match from one sorted pass over its bucket.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import hot_groups, spread_hot


@dataclass(frozen=True)
class Grid:
    """``n`` ascending times per row; ``at`` gives the time of slot 0..n-1 from the row's columns."""
    n: int
    at: Callable[[Column], Column]


def asof(probes: DataFrame, facts: DataFrame, by: Sequence[str], probe_time: str | Grid, fact_time: str,
         payload: Sequence[str] = (), width: float = 64.0, lookback: float | None = None,
         direction: str = "backward", tie: str | None = None, strict: bool = False,
         hot_rows: int | None = None, load: tuple[DataFrame, str, float, int] | None = None) -> DataFrame:
    """Add ``before`` and / or ``after``: a struct ``(time, *payload)`` of the matched fact, or NULL.

    ``probe_time`` is a time column or a ``Grid``: then every row asks ``n`` times, and the result has
    one row per ask with its ``slot`` and ``time``. Grids are expanded only after the shuffle, so a
    row travels once per bucket it touches, not once per ask.

    ``lookback`` (at most ``width``) says that facts further away are of no use; without it, matches
    may lie any number of buckets away. Facts at the same time: the largest ``tie`` wins looking
    back, the smallest looking ahead. ``strict`` ignores facts at exactly the probe time.

    Busy buckets are found by counting the probes, which runs their plan once more. ``load = (table,
    time column, seconds, n)`` replaces that by a cheaper bound: every row of the table makes at most
    ``n`` probes within ``seconds`` before its time."""
    if lookback is not None and lookback > width:
        raise ValueError("width must be at least lookback")
    by = list(by)
    group = by + ["_b"]
    back, ahead = direction in ("backward", "both"), direction in ("forward", "both")
    if not (back or ahead):
        raise ValueError("direction is backward, forward or both")
    w = F.lit(float(width))
    many = isinstance(probe_time, Grid)
    original = probes.columns

    if many:
        lo, hi = (F.floor(probe_time.at(F.lit(i)) / w) for i in (0, probe_time.n - 1))
        few = F.transform(F.sequence(F.lit(0), F.lit(probe_time.n - 1)), lambda i: F.floor(probe_time.at(i) / w))
        cells = F.when(hi - lo < probe_time.n, F.sequence(lo, hi)).otherwise(F.array_distinct(few))
        p = probes.withColumn("_b", F.explode(cells))
        weight = F.lit(probe_time.n)
    else:
        p = probes.withColumn("_t", F.col(probe_time)).withColumn("_b", F.floor(F.col("_t") / w))
        weight = None
    entry = F.struct(F.col(fact_time).alias("time"), *[F.col(c) for c in payload])
    rank = F.col(tie) if tie else F.lit(0)
    picks = [F.max_by(entry, rank).alias("_last")] if back else []
    picks += [F.min_by(entry, rank).alias("_first")] if ahead else []
    f = (facts.where(F.col(fact_time).isNotNull() & ~F.isnan(F.col(fact_time).cast("double")))
         .groupBy(*by, F.col(fact_time).alias("_t")).agg(*picks)
         .withColumn("_b", F.floor(F.col("_t") / w)))

    if lookback is not None:
        near = F.lit(float(lookback))
        cells = [F.col("_b")]
        if back:
            cells.append(F.when(F.col("_t") + near >= (F.col("_b") + 1) * w, F.col("_b") + 1))
        if ahead:
            cells.append(F.when(F.col("_t") - near <= F.col("_b") * w, F.col("_b") - 1))
        f = f.withColumn("_b", F.explode(F.array_compact(F.array(*cells))))
    else:
        f = f.unionByName(_carried(f, p, by, back, ahead), allowMissingColumns=True)

    hot = hot_groups(p, group, hot_rows, weight) if load is None else _busy(load, by, w, width, hot_rows)
    probe_side, fact_side = (0, 1) if strict else (1, 0)
    rows = (p.withColumn("_side", F.lit(probe_side))
            .unionByName(f.withColumn("_side", F.lit(fact_side)), allowMissingColumns=True))
    rows = spread_hot(rows, hot, group, F.col("_side") == fact_side, [c for c in original if c not in by] or by)
    if many:
        is_probe = F.col("_side") == probe_side
        slots = F.sequence(F.lit(0), F.when(is_probe, F.lit(probe_time.n - 1)).otherwise(F.lit(0)))
        # a fixed number of partitions: the rows about to be expanded look small to adaptive coalescing
        tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = (rows.repartition(tasks, *group, "_part").withColumn("_slot", F.explode(slots))
                .withColumn("_t", F.when(is_probe, probe_time.at(F.col("_slot"))).otherwise(F.col("_t")))
                .where(~is_probe | F.floor(F.col("_t") / w).eqNullSafe(F.col("_b"))))

    cell = Window.partitionBy(*group, "_part")
    frame = (Window.unboundedPreceding, Window.currentRow)
    found = []
    if back:
        forwards = cell.orderBy("_t", "_side").rowsBetween(*frame)
        found.append(F.last("_last", ignorenulls=True).over(forwards).alias("before"))
    if ahead:
        backwards = cell.orderBy(F.col("_t").desc(), F.col("_side")).rowsBetween(*frame)
        found.append(F.last("_first", ignorenulls=True).over(backwards).alias("after"))
    asks = [F.col("_slot").alias("slot"), F.col("_t").alias("time")] if many else []
    return rows.select("*", *found).where(F.col("_side") == probe_side).select(*original, *asks, *[
        name for name, on in (("before", back), ("after", ahead)) if on])


def _busy(load, by: list[str], w, width: float, hot_rows: int | None) -> DataFrame:
    table, time, seconds, n = load
    reach = math.ceil(seconds / width)
    counted = table.groupBy(*by, F.floor(F.col(time) / w).alias("_b")).agg((F.count(F.lit(1)) * n).alias("_w"))
    spread = counted.select(*by, F.explode(F.sequence(F.col("_b") - reach, F.col("_b"))).alias("_b"), "_w")
    return hot_groups(spread, by + ["_b"], hot_rows, F.col("_w"))


def _carried(f: DataFrame, p: DataFrame, by: list[str], back: bool, ahead: bool) -> DataFrame:
    """For every bucket with probes, the nearest fact of an earlier (later) bucket as an extra fact.

    Works on one row per occupied bucket, so its size follows the length of the timelines."""
    edges = []
    if back:
        edges.append(F.max_by(F.struct("_t", "_last"), F.col("_t")).alias("_end"))
    if ahead:
        edges.append(F.min_by(F.struct("_t", "_first"), F.col("_t")).alias("_begin"))
    cells = (f.groupBy(*by, "_b").agg(*edges)
             .unionByName(p.groupBy(*by, "_b").agg(F.lit(True).alias("_wanted")), allowMissingColumns=True)
             .groupBy(*by, "_b").agg(F.max("_wanted").alias("_wanted"),
                                     *[F.max(e).alias(e) for e, on in (("_end", back), ("_begin", ahead)) if on]))
    along = Window.partitionBy(*by).orderBy("_b")
    extra = []
    if back:
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        extra.append(F.last("_end", ignorenulls=True).over(earlier).alias("_prev"))
    if ahead:
        later = along.rowsBetween(1, Window.unboundedFollowing)
        extra.append(F.first("_begin", ignorenulls=True).over(later).alias("_next"))
    cells = cells.select(*by, "_b", "_wanted", *extra).where(F.col("_wanted"))
    out = None
    for on, col, name in ((back, "_prev", "_last"), (ahead, "_next", "_first")):
        if on:
            part = (cells.where(F.col(col).isNotNull())
                    .select(*by, "_b", F.col(f"{col}._t").alias("_t"), F.col(f"{col}.{name}").alias(name)))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
