"""Annotations to split, manifests and statistics on disk."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import checks as C, splits as SP, stats as S
from ..session import checkpointed
from ..sources.annotations import read_events, write_manifests, write_split, write_summary
from ..sources.files import file_fingerprint, file_index


def _with_test(split: DataFrame, spark: SparkSession, test_csv: str | None, gap: float) -> DataFrame:
    if test_csv is None:
        return split
    hidden = read_events(spark, test_csv, labeled=False, gap=gap)
    C.enforce(C.check_overlap(split, hidden, "narration_id", "train_test_overlap"))
    return split.unionByName(hidden.withColumn("subset", F.lit("test")))


def _statistics(split: DataFrame, num_verbs: int, num_nouns: int) -> dict[str, DataFrame]:
    train = split.where(F.col("subset") == "train")
    counts = S.class_counts(train, num_verbs, num_nouns)
    return {"splits": S.split_summary(split), "priors": S.prior(counts), "members": S.split_members(split),
            "class_counts": S.class_counts(split, num_verbs, num_nouns, keep=["subset"])}


def _parameters(spark: SparkSession, **values) -> DataFrame:
    """One row per setting of the job: its name and its value as JSON text."""
    return spark.createDataFrame([(name, json.dumps(value)) for name, value in values.items()], "name string, value string")


def prepare_grouped(spark: SparkSession, train_csv: str, out: str, videos: str | None = None, test_csv: str | None = None,
                    fraction: float = 0.2, seed: int = 42, context: float = 5.0, gap: float = 1.0, num_verbs: int = 97,
                    num_nouns: int = 300, allow_missing_videos: bool = False) -> DataFrame:
    """Hold out whole videos and write manifests, the split table and a summary below ``out``. With a
    video folder, referenced videos without a file raise unless allowed."""
    events = read_events(spark, train_csv, gap=gap, num_verbs=num_verbs, num_nouns=num_nouns)
    split = checkpointed(_with_test(SP.grouped_split(events, fraction, seed), spark, test_csv, gap))  # decided once, for all gates and writes
    C.enforce(C.check_disjoint(split.where(F.col("subset") != "test")))
    if videos is not None:
        index = file_index(spark, videos, "mp4")
        C.enforce(C.check_unique(index, "stem", "duplicate_video_file"))
        lost = C.missing_keys(split, index.select(F.col("stem").alias("video_id")), "video_id")
        if not allow_missing_videos:
            C.enforce(lost.select(F.lit("missing_video").alias("check"), F.col("video_id").alias("id"), F.lit("").alias("detail")))
    write_manifests(split, f"{out}/manifests", context)
    write_split(split, f"{out}/split")
    parameters = _parameters(spark, split_type="grouped", split_unit="video_id", validation_video_fraction=fraction, seed=seed,
                             sta_context_seconds=context, hidden_test_provided=test_csv is not None)
    extra = {"parameters": parameters} | ({"missing_videos": lost} if videos is not None else {})
    write_summary(f"{out}/summary", source=file_fingerprint(spark, train_csv), **extra, **_statistics(split, num_verbs, num_nouns))
    return split


def prepare_hybrid(spark: SparkSession, train_csv: str, out: str, test_csv: str | None = None,
                   unseen: Sequence[str] | None = None, unseen_fraction: float = 0.06, seen_fraction: float = 0.08,
                   seen_max_fraction: float = 0.15, context: float = 5.0, head_share: float = 0.8, gap: float = 1.0,
                   num_verbs: int = 97, num_nouns: int = 300) -> DataFrame:
    """Unseen participants plus latest videos; adds coverage, tail classes and the cold-start prior."""
    events = read_events(spark, train_csv, gap=gap, num_verbs=num_verbs, num_nouns=num_nouns)
    labelled = checkpointed(SP.hybrid_split(events, unseen, unseen_fraction, seen_fraction, seen_max_fraction))
    C.enforce(C.check_disjoint(labelled, labelled.where(F.col("subset") == "val_unseen").select("participant_id").distinct()))
    split = _with_test(labelled, spark, test_csv, gap)
    train = labelled.where(F.col("subset") == "train")
    counts = S.class_counts(train, num_verbs, num_nouns)
    tail = S.tail_classes(counts, head_share)
    write_manifests(split, f"{out}/manifests", context)
    write_split(labelled, f"{out}/split")
    parameters = _parameters(spark, split_type="hybrid_seen_unseen", unseen_participants_given=sorted(unseen or []), unseen_fraction=unseen_fraction,
                             seen_fraction=seen_fraction, seen_max_fraction=seen_max_fraction, sta_context_seconds=context, head_share=head_share,
                             hidden_test_provided=test_csv is not None)
    write_summary(f"{out}/summary", source=file_fingerprint(spark, train_csv), parameters=parameters, coverage=S.coverage(labelled, head_share),
                  tail=tail, tail_action_events=S.tail_action_events(labelled, tail),
                  cold_start_prior=S.cold_start_prior(train, num_verbs, num_nouns), **_statistics(split, num_verbs, num_nouns))
    return split
