"""Frame times to a checked, consolidated clip bank and event-feature index."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.checks import check_event_features, enforce
from ..operators.sampling import assign_rows
from ..operators.temporal import check_action_clips, clip_bank, event_clip_ends
from ..session import checkpointed
from ..sources.features import consolidate, event_feature_index


def build_bank(frames: DataFrame, events: DataFrame, path: str, length: float = 2.0, stride: float = 1.0) -> DataFrame:
    """Sliding clips of every video up to its last frame or event, numbered and stored; returns the
    metadata row."""
    ends = events.select("video_id", F.col("stop").alias("min_end"))
    clips = clip_bank(frames, length, stride, ends).drop("row")
    return consolidate(clips, path, ("video_id", "window_end"), {"bank_stride_s": float(stride)})


def build_event_features(frames: DataFrame, events: DataFrame, path: str, context: float = 5.0, num_frames: int = 16) -> DataFrame:
    """The event-feature index from frame times, numbered by video and start and stored; returns it as `read_event_features` does. An
    action without a frame is an error, and so is a clip that ends after its event's cutoff."""
    index = checkpointed(event_clip_ends(events, frames, context, num_frames))
    enforce(check_action_clips(index))
    rows = assign_rows(index, ["video_id", "action_start_s", "narration_id"], "row").withColumnRenamed("use_prior", "sta_use_prior")
    rows.write.mode("errorifexists").parquet(path)
    return event_feature_index(index.sparkSession.read.parquet(path))


def check_features(index: DataFrame, events: DataFrame, require_all: bool = True) -> None:
    """Raise when a feature index disagrees with the annotations."""
    enforce(check_event_features(index, events, require_all))
