"""Positions, ranks and samples that need an order, without sorting everything in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed, with_scalar
from .chains import greedy
from .skew import running

EPS = 1e-6


def assign_rows(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """Contiguous numbers 0..n-1 along ``order``.

    Rows are range-partitioned on the whole order, so even one huge group is cut over many tasks.
    The sorted rows are checkpointed once: partition sizes and rows then come from the same data,
    also when executors are lost in between. Only one offset per partition is broadcast."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = (df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id()).withColumn("_local", local))
    ranged = checkpointed(ranged)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long")).drop("_pid", "_local", "_offset"))


def dedupe_times(bank: DataFrame, eps: float = EPS, width: float = 64.0) -> tuple[DataFrame, DataFrame]:
    """Usable clips, and counts of what was left out.

    Clips that could not be decoded (end NULL, negative or not finite) go first. Then, per video in
    time order, a clip within ``eps`` of the last kept one is dropped; equal times keep the lowest
    row. Runs of clips that close are resolved by pointer doubling over buckets (``chains``), so neither a run nor a video is
    ever in one task."""
    t = F.col("t_end_s")
    usable = F.coalesce((t >= 0) & (t < F.lit(float("inf"))), F.lit(False))
    best = (bank.where(usable).groupBy("video_id", "t_end_s").agg(F.min("row").alias("row")))
    kept = greedy(best, ["video_id"], "t_end_s", "row", eps, max(width, 16 * eps))
    scanned = bank.agg(F.count(F.lit(1)).alias("_all"), F.count_if(~usable).alias("undecodable"))
    dropped = (with_scalar(scanned, kept.agg(F.count(F.lit(1)).alias("_kept")))
               .select("undecodable", (F.col("_all") - F.col("undecodable") - F.col("_kept")).alias("duplicate_time")))
    return kept, dropped


def round_robin(events: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` events spread over as many videos as possible: one of each video before a second of any.

    Never more than ``n`` events of a video can be chosen, which the ranking filter pushes below
    the shuffle."""
    video = F.md5(F.concat(F.lit(f"{seed}:"), F.col("video_id")))
    event = F.md5(F.concat(F.lit(f"{seed}:"), F.col("narration_id")))
    turn = F.row_number().over(Window.partitionBy("video_id").orderBy(event, "narration_id"))
    return (events.withColumn("turn", turn).where(F.col("turn") <= n)
            .withColumn("_v", video).orderBy("turn", "_v", "video_id").limit(n).drop("_v"))


def inspection_sample(events: DataFrame, n: int, position: str = "position", enough: float = 5.0) -> DataFrame:
    """Up to ``n`` rows to look at: the first without history, the first with a cutoff of at least
    ``enough`` seconds, then evenly spaced positions. ``position`` numbers rows 0..N-1."""
    if n < 1:
        raise ValueError("need at least one row")
    pos, c = F.col(position), F.col("sta_cutoff")
    stats = events.agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(c < 0, pos)).alias("_cold"),
                       F.min(F.when(c >= enough, pos)).alias("_warm"))
    m = F.least(F.lit(n), F.col("_n"))
    step = F.when(m > 1, (F.col("_n") - 1) / (m - 1)).otherwise(F.lit(0.0))
    spaced = F.transform(F.sequence(F.lit(0), (m - 1).cast("int")),
                         lambda i: F.when((i == m - 1) & (m > 1), F.col("_n") - 1).otherwise(F.floor(i * step)).cast("long"))
    wanted = F.slice(F.array_distinct(F.array_compact(F.concat(
        F.array(F.col("_cold").cast("long"), F.col("_warm").cast("long")), spaced))), 1, n)
    chosen = (stats.where(F.col("_n") > 0).select(F.slice(wanted, 1, n).alias("w"))
              .select(F.posexplode("w").alias("sample_rank", position)))
    return events.join(F.broadcast(chosen), position)


def uniform_positions(df: DataFrame, partition: Sequence[str], order: Sequence[str], n: int, bucket: Column) -> DataFrame:
    """``n`` rows per group at positions ``int(i * count / n)``; a group of at most ``n`` rows gives
    all of them and repeats the last. Adds ``slot``. ``bucket`` cuts long groups along the order."""
    ranked = running(df, partition, [F.col(c) for c in order], bucket)
    pos, total = F.col("_before").cast("long"), F.col("_total").cast("long")
    first = F.ceil(pos * n / total).cast("int")
    last = F.ceil((pos + 1) * n / total).cast("int") - 1
    step = total / F.lit(float(n))
    spread = F.filter(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.lit(n - 1))),
                      lambda i: F.floor(step * i) == pos)
    short = F.when(pos == total - 1, F.sequence(pos.cast("int"), F.lit(n - 1))).otherwise(F.array(pos.cast("int")))
    slots = F.when(total <= n, short).otherwise(spread)
    return ranked.withColumn("slot", F.explode(slots)).withColumn("position", pos).drop("_before", "_total")


def ema(steps: DataFrame, value: str, valid: str, alpha: float = 0.8, by: str = "narration_id", order: str = "k") -> DataFrame:
    """Per event, ``q <- alpha * p + (1 - alpha) * q`` over its valid steps in order, from zero.

    An event has a fixed number of steps, so its array is short. Vectors travel as they are stored and become doubles where they are added up."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(valid).alias("ok"), F.col(value).alias("p"))))

    def step(q, s):
        fresh = F.zip_with(s["p"].cast("array<double>"), q, lambda x, y: F.lit(alpha) * x + F.lit(1 - alpha) * y)
        return F.when(s["ok"], fresh).otherwise(q)

    start = F.transform(F.col("_s")[0]["p"], lambda x: F.lit(0.0))
    return (steps.groupBy(by).agg(items.alias("_s"))
            .select(by, F.aggregate("_s", start, step).alias("ema")))


def best_epoch(log: DataFrame, metric: str, patience: int, by: str = "run") -> DataFrame:
    """Best epoch under early stopping: training stops once ``patience`` epochs in a row did not
    beat the best score; later epochs do not count. Runs are short, so one window per run is fine."""
    order = Window.partitionBy(by).orderBy("epoch")
    prior_best = F.coalesce(F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    better = F.col(metric) > F.greatest(prior_best, F.lit(-1.0))
    marked = log.withColumn("_i", F.row_number().over(order)).withColumn("improved", better)
    last = F.max(F.when(F.col("improved"), F.col("_i"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    waited = F.col("_i") - F.coalesce(last, F.lit(0))
    marked = marked.withColumn("waited", waited)
    stop = F.min(F.when(F.col("waited") >= patience, F.col("_i"))).over(Window.partitionBy(by))
    used = marked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop")))
    return used.groupBy(by).agg(
        F.max_by("epoch", F.when(F.col("improved"), F.col("_i"))).alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col(metric))).alias("best_score"),
        F.max_by("waited", F.col("_i")).alias("epochs_since_best"),
        F.max("epoch").alias("last_epoch"), F.max(F.col("_stop").isNotNull()).alias("stopped_early"))
