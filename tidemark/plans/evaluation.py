"""From events and a bank to scores per subset."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import checks as C, metrics as M, stats as S, temporal as T
from ..session import checkpointed


def validation_history(split: DataFrame, bank: DataFrame, steps: int = 16, stride: float = 1.0) -> DataFrame:
    """History of every event, stored once, after the gates that nothing used lies past its cutoff and that every event
    with a cutoff has a video with clips (it must not fall back to the prior for want of a file)."""
    lost = C.missing_keys(split.where("sta_cutoff >= 0"), bank, "video_id")
    C.enforce(lost.select(F.lit("video_without_clips").alias("check"), F.col("video_id").alias("id"), F.lit("").alias("detail")))
    rows = checkpointed(T.history(split, bank, steps, stride, keep=("subset",)))
    C.enforce(C.check_before_cutoff(rows))
    return rows


def anticipation_scores(split: DataFrame, history_rows: DataFrame, scored: DataFrame, num_verbs: int = 97, num_nouns: int = 300,
                        window_s: float = 5.0) -> DataFrame:
    """Seen / unseen / tail scores of the validation events. Events without history get the cold-start
    prior of the training split. ``scored`` needs ``narration_id, verb_output, noun_output``."""
    train = split.where(F.col("subset") == "train")
    counts = S.class_counts(train, num_verbs, num_nouns)
    prior = M.prior_arrays(S.cold_start_prior(train, num_verbs, num_nouns, window_s), "prior", log=True)
    val = split.where(F.col("subset").startswith("val")).select("narration_id", "subset", "verb", "noun")
    outputs = val.join(scored.select("narration_id", "verb_output", "noun_output"), "narration_id")
    full = M.with_prior_fallback(outputs, history_rows, prior)
    return M.evaluate_breakdown(full, "STA", S.tail_classes(counts), F.col("subset") == "val_unseen", num_nouns=num_nouns)
