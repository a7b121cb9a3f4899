"""Sliding clip bank over a stream of frame times."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


ORIGIN = 86_400_000_000  # microseconds; the first watermark is the epoch, so time zero must lie after it


def with_event_time(df: DataFrame, seconds: str, name: str = "ts") -> DataFrame:
    """Seconds from the video origin as an event-time column (the origin is one day past the epoch)."""
    micros = F.round(F.greatest(F.col(seconds), F.lit(0.0)) * 1_000_000).cast("long")
    return df.withColumn(name, F.timestamp_micros(micros + ORIGIN))


def clip_bank_stream(frames: DataFrame, length: float = 2.0, stride: float = 1.0, lateness: str = "10 seconds",
                     num_frames: int | None = 16) -> DataFrame:
    """Clips ``[e - length, e]`` with at least one frame, emitted once the watermark passes ``e``.

    Spark windows are half open; one microsecond more makes their closed twins, while the slide
    stays the stride. Windows without frames never appear in a stream (the batch bank lists them)."""
    size, step = round(length * 1_000_000), round(stride * 1_000_000)
    timed = with_event_time(frames.where(F.col("pts") >= 0), "pts").withWatermark("ts", lateness)
    window = F.window("ts", f"{size + 1} microseconds", f"{step} microseconds", f"{(ORIGIN - size) % step} microseconds")
    end = (F.unix_micros(F.col("w.start")) + (size - ORIGIN)) / 1_000_000
    begin = F.greatest(F.lit(0.0), end - F.lit(float(length)))
    if num_frames is None:
        chosen = F.max("pts")
    else:
        target = begin + (end - begin) * F.lit((num_frames - 0.5) / num_frames)
        chosen = F.min_by("pts", F.struct(F.abs(F.col("pts") - target), F.col("pts")))
    grouped = timed.withColumn("w", window).groupBy("video_id", "w").agg(
        F.count(F.lit(1)).alias("frames"), F.max("pts").alias("last_pts"), chosen.alias("t_end_s"))
    return (grouped.where(end >= F.lit(float(stride)))
            .select("video_id", (F.round(end / F.lit(float(stride))).cast("long") - 1).alias("row"),
                    end.alias("window_end"), "frames", "last_pts", "t_end_s"))
