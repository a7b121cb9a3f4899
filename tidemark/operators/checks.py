"""Integrity gates. Every check returns the offending rows as ``(check, id, detail)``; ``enforce``
raises when there are any. Nothing is dropped silently."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import all_finite

EPS = 1e-6


class IntegrityError(AssertionError):
    """Raised by ``enforce``; names each failing check, its row count and the first ids."""


def enforce(*violations: DataFrame) -> None:
    every = reduce(DataFrame.unionByName, violations)
    counts = every.groupBy("check").agg(F.count(F.lit(1)).alias("n")).orderBy("check").collect()
    if not counts:
        return
    parts = []
    for row in counts:
        first = [r["id"] for r in every.where(F.col("check") == row["check"]).select("id").limit(5).collect()]
        parts.append(f"{row['check']}: {row['n']} rows, first {first}")
    raise IntegrityError("; ".join(parts))


def failing(df: DataFrame, id_col: str, rules: dict[str, Column], detail: dict[str, Column] | None = None) -> DataFrame:
    """One violation per row and broken rule, in one pass. A rule that is NULL counts as broken."""
    detail = detail or {}
    named = [F.when(F.coalesce(bad, F.lit(True)),
                    F.struct(F.lit(name).alias("check"),
                             detail.get(name, F.lit("")).cast("string").alias("detail")))
             for name, bad in rules.items()]
    return (df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.array_compact(F.array(*named))).alias("v"))
            .select("v.check", "id", "v.detail"))


def _as_violation(df: DataFrame, check: str, id_col: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(id_col).cast("string").alias("id"),
                     (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def check_unique(df: DataFrame, key: str, check: str | None = None) -> DataFrame:
    """Empty and repeated keys."""
    name = check or f"unique_{key}"
    empty = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _as_violation(counted.where(empty | (F.col("_n") > 1)), name, key, F.concat(F.lit("count "), F.col("_n")))


def check_overlap(left: DataFrame, right: DataFrame, key: str, check: str | None = None) -> DataFrame:
    """Keys present on both sides."""
    return _as_violation(left.select(key).intersect(right.select(key)), check or f"overlap_{key}", key)


def check_disjoint(split: DataFrame, unseen: DataFrame | None = None, train: str = "train") -> DataFrame:
    """A split must keep videos and events on one side, and unseen participants out of training."""
    side = F.when(F.col("subset") == train, 1).otherwise(0)

    def mixed(key):
        both = (split.groupBy(key).agg(F.min(side).alias("_lo"), F.max(side).alias("_hi"),
                                       F.count(F.lit(1)).alias("_n")))
        return both.where(F.col("_lo") != F.col("_hi")), both

    video_mixed, _ = mixed("video_id")
    event_mixed, per_event = mixed("narration_id")
    out = [_as_violation(video_mixed, "video_on_both_sides", "video_id"),
           _as_violation(event_mixed, "event_on_both_sides", "narration_id"),
           _as_violation(per_event.where(F.col("_n") > 1), "event_assigned_twice", "narration_id")]
    if unseen is not None:
        leaked = (split.where(F.col("subset") == train).select("participant_id").distinct()
                  .join(unseen.select("participant_id"), "participant_id", "left_semi"))
        out.append(_as_violation(leaked, "unseen_participant_in_train", "participant_id"))
    return reduce(DataFrame.unionByName, out)


def interval_rules(num_verbs: int, num_nouns: int, labeled: bool) -> dict[str, Column]:
    finite = [F.abs(F.col(c)) < F.lit(float("inf")) for c in ("start", "stop", "sta_cutoff")]
    rules = {
        "empty_id": F.trim(F.col("narration_id")) == "",
        "empty_participant": F.trim(F.col("participant_id")) == "",
        "empty_video": F.trim(F.col("video_id")) == "",
        "bad_time": ~(finite[0] & finite[1] & finite[2]),
        "bad_interval": ~((F.col("start") >= 0) & (F.col("stop") > F.col("start"))),
    }
    if labeled:
        rules["bad_verb"] = ~F.col("verb").between(0, num_verbs - 1)
        rules["bad_noun"] = ~F.col("noun").between(0, num_nouns - 1)
    return rules


def check_events(events: DataFrame, num_verbs: int = 97, num_nouns: int = 300, labeled: bool = True) -> DataFrame:
    """Identifier, time, interval and label violations, and repeated ids."""
    rows = failing(events, "narration_id", interval_rules(num_verbs, num_nouns, labeled))
    return rows.unionByName(check_unique(events.where(F.trim(F.col("narration_id")) != ""), "narration_id", "duplicate_id"))


def check_event_features(index: DataFrame, events: DataFrame, require_all: bool = True, eps: float = EPS) -> DataFrame:
    """A feature index against the annotations: repeated or unknown events, repeated rows, events
    without features, clips that end late, and prior flags that disagree with the cutoff.

    One violation per event (or row) and rule, from a single aggregation: every index row is counted under its event and under its row
    number, every annotation under its event, and what the rules need of them (extremes and flags) adds up before the shuffle, so that an
    id that is repeated very often meets in one short record."""
    end, prior = F.col("sta_clip_end_s"), F.coalesce(F.col("use_prior"), F.lit(False))
    listed = index.select(F.explode(F.array(F.struct(F.lit("event").alias("kind"), F.col("narration_id").cast("string").alias("key")),
                                            F.struct(F.lit("row").alias("kind"), F.col("row").cast("string").alias("key")))).alias("_k"),
                          end.cast("double").alias("end"), prior.alias("prior"), F.lit(1).alias("listed"))
    known = events.select(F.lit("event").alias("kind"), F.col("narration_id").cast("string").alias("key"), F.col("sta_cutoff").cast("double").alias("cutoff"), F.lit(1).alias("known"))
    rows = listed.select("_k.kind", "_k.key", "end", "prior", "listed").unionByName(known, allowMissingColumns=True)
    clip = F.col("listed").isNotNull() & ~F.col("prior")
    found = rows.groupBy("kind", "key").agg(
        F.count("listed").alias("listed"), F.count("known").alias("known"), F.max("cutoff").alias("c"), F.max("prior").alias("some_prior"),
        F.max(clip).alias("some_clip"), F.max(F.when(clip, F.col("end"))).alias("last"), F.min(F.when(clip, F.col("end"))).alias("first"),
        F.max(clip & (F.col("end").isNull() | F.isnan("end"))).alias("no_end"), F.max(F.coalesce(F.col("end") >= 0, F.lit(False))).alias("some_end"))
    event, c = F.col("kind") == "event", F.col("c")
    both = event & (F.col("listed") > 0) & (F.col("known") > 0)
    rules = {
        "unknown_event": event & (F.col("known") == 0),
        "prior_flag_wrong": both & (c < 0) & (F.col("some_clip") | F.col("some_end")),
        "history_marked_prior": both & (c >= 0) & F.col("some_prior"),
        "late_clip": both & (c >= 0) & F.col("some_clip") & (F.col("no_end") | (F.col("last") > c + eps) | (F.col("first") < 0)),
    }
    if require_all:
        rules["event_without_features"] = event & (F.col("listed") == 0)
    empty = F.col("key").isNull() | (F.trim(F.col("key")) == "")
    for name, kind in (("duplicate_event", "event"), ("duplicate_row", "row")):
        rules[name] = (F.col("kind") == kind) & (F.col("listed") > 0) & (empty | (F.col("listed") > 1))
    rules = {name: F.coalesce(bad, F.lit(False)) for name, bad in rules.items()}
    count = F.concat(F.lit("count "), F.col("listed"))
    detail = {"late_clip": F.concat_ws(" ", F.lit("end"), "last", F.lit("cutoff"), c), "duplicate_event": count, "duplicate_row": count}
    return failing(found, "key", rules, detail)


def check_predictions(pred: DataFrame, ids: DataFrame, num_verbs: int = 97, num_nouns: int = 300) -> DataFrame:
    """Exactly one prediction per expected event, each two finite float32 vectors of the right length."""
    limit = F.lit(3.4028234663852886e38)

    def fits(name, count):
        v = F.col(name).cast("array<double>")
        return ((F.size(v) == count) & all_finite(v) & F.forall(v, lambda x: F.abs(x) <= limit))

    rules = {"bad_verb_output": ~fits("verb_output", num_verbs), "bad_noun_output": ~fits("noun_output", num_nouns)}
    # one aggregation counts both sides of every id; an id that is null matches none
    given, wanted = (df.select(F.col("narration_id").alias("key"), F.lit(1).alias(side)) for df, side in ((pred, "given"), (ids, "expected")))
    found = given.unionByName(wanted, allowMissingColumns=True).groupBy("key").agg(F.count("given").alias("given"), F.count("expected").alias("expected"))
    no_key, is_given, is_expected = F.col("key").isNull(), F.col("given") > 0, F.col("expected") > 0
    empty = no_key | (F.trim(F.col("key").cast("string")) == "")
    coverage = {"missing_prediction": is_expected & (no_key | ~is_given), "unexpected_prediction": is_given & (no_key | ~is_expected),
                "duplicate_prediction": is_given & (empty | (F.col("given") > 1)), "duplicate_expected_id": is_expected & (empty | (F.col("expected") > 1))}
    detail = {"duplicate_prediction": F.concat(F.lit("count "), "given"), "duplicate_expected_id": F.concat(F.lit("count "), "expected")}
    return failing(pred, "narration_id", rules).unionByName(failing(found, "key", coverage, detail))


def check_manifest(manifest: DataFrame, gap: float = 1.0, eps: float = EPS) -> DataFrame:
    """STA windows must end at ``start - gap``; a negative cutoff must have an empty window."""
    c, w = F.col("sta_cutoff"), "observation"
    sta = manifest.where(F.col("task") == "STA")
    ends_late = (F.abs(c - (F.col("start") - gap)) > eps) | (F.col(f"{w}.end") > c + eps)
    return failing(sta, "narration_id", {"window_after_cutoff": ends_late,
                                         "negative_cutoff_not_empty": ~ends_late & (c < 0) & ~F.col(f"{w}.empty")})


def check_before_cutoff(rows: DataFrame, time: str = "used_time", eps: float = EPS) -> DataFrame:
    """Observed times (NULL or NaN means none) must not pass the event's cutoff; a negative cutoff
    allows none at all."""
    t, c = F.col(time), F.col("sta_cutoff")
    seen = t.isNotNull() & (F.abs(t) < F.lit(float("inf")))
    late = F.coalesce(seen & ((c < 0) | (t > c + eps)), F.lit(False))
    return failing(rows, "narration_id", {"after_cutoff": late},
                   {"after_cutoff": F.concat_ws(" ", F.lit("time"), t, F.lit("cutoff"), c)})


# Fixed value: how far the sum of probabilities may be from one.
SUM_TOLERANCE = 2e-5


def check_scores(df: DataFrame, scores: str, classes: int, kind: str = "logits") -> DataFrame:
    """Score vectors must be finite and of one width; probabilities non-negative with sum one."""
    if kind not in ("logits", "probabilities"):
        raise ValueError("kind is logits or probabilities")
    v = F.col(scores).cast("array<double>")
    rules = {"bad_width": F.size(v) != classes, "not_finite": ~all_finite(v)}
    if kind == "probabilities":
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
        rules["negative_probability"] = F.exists(v, lambda x: x < 0)
        rules["sum_not_one"] = ~(F.abs(total - 1) <= SUM_TOLERANCE)
    return failing(df, "narration_id", rules)


def check_labels(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Labels must be present and inside the class range."""
    return failing(df, "narration_id", {f"bad_{label}": ~F.col(label).between(0, classes - 1)})


def check_vectors(bank: DataFrame, vector: str = "tokens", rows: int | None = None) -> DataFrame:
    """All vectors must share one shape, and row numbers must stay inside ``[0, rows)``."""
    nested = dict(bank.dtypes)[vector].startswith("array<array")
    v = F.col(vector)
    shape = F.size(v).cast("string")
    if nested:
        inner = F.transform(v, lambda t: F.size(t))
        shape = F.concat_ws("x", shape, F.array_min(inner), F.when(F.array_min(inner) != F.array_max(inner),
                                                                 F.array_max(inner)))
    shapes = bank.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    kinds = shapes.agg(F.count(F.lit(1)).alias("_kinds"))
    out = _as_violation(shapes.join(F.broadcast(kinds), F.col("_kinds") > 1), "vector_shape", "shape",
                        F.concat(F.lit("count "), F.col("n")))
    if rows is not None:
        out = out.unionByName(failing(bank, "row", {"row_out_of_range": ~F.col("row").between(0, rows - 1)}))
    return out


def check_versions(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Stored step features must name the source bank and scorer that this run uses."""
    tests = [F.struct(F.lit(k).alias("id"), (~F.col(k).cast("string").eqNullSafe(F.lit(str(v)))).alias("bad"),
                      F.concat_ws(" ", F.lit("found"), F.col(k).cast("string"), F.lit("expected"),
                                  F.lit(str(v))).alias("detail")) for k, v in expected.items()]
    return (meta.select(F.explode(F.array(*tests)).alias("t")).where(F.col("t.bad"))
            .select(F.lit("version").alias("check"), "t.id", "t.detail"))


def check_stride(bank: DataFrame, stride: float) -> DataFrame:
    """Warn per video whose clips are on average further apart than the history stride: consecutive
    steps would then reuse a clip. (Mean spacing needs no ordering, only two extremes and a count.)"""
    per = bank.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.try_divide(
        F.max("t_end_s") - F.min("t_end_s"), F.count(F.lit(1)) - 1).alias("spacing"))
    return _as_violation(per.where(F.col("spacing") > stride + 1e-9), "coarse_bank", "video_id", F.col("spacing"))


def check_samples(samples: DataFrame, gap: float = 1.0, num_verbs: int = 97, num_nouns: int = 300) -> DataFrame:
    """The contract of a sampled batch row: equally long arrays, valid frame times inside the
    observation window, STA times at or before ``start - gap``, and a prior flag set exactly when an
    STA row saw nothing."""
    shown = F.filter(F.arrays_zip(F.col("frame_times").alias("t"), F.col("valid_mask").alias("m")), lambda z: z["m"])
    times = F.transform(shown, lambda z: z["t"])
    lo, hi = F.col("observation.start"), F.col("observation.end")
    ar, none = F.col("task") == "AR", F.size(times) == 0
    inside = F.forall(times, lambda t: t.isNotNull() & ~F.isnan(t) & (t >= lo))
    rules = {
        "array_length": F.size("frame_times") != F.size("valid_mask"),
        "bad_frame_time": ~inside,
        "ar_frames": ar & (none | F.exists(times, lambda t: t >= hi) | F.col("use_prior")),
        "sta_leak": ~ar & F.exists(times, lambda t: (t > hi) | (t > F.col("start") - gap + 1e-9)),
        "prior_flag": F.col("use_prior") != (~ar & none),
        "bad_label": F.col("verb").isNotNull() & ~(F.col("verb").between(0, num_verbs - 1)
                                                   & F.col("noun").between(0, num_nouns - 1)),
    }
    return failing(samples, "narration_id", rules)


def missing_keys(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    on = [on] if isinstance(on, str) else list(on)
    return left.select(*on).distinct().join(right.select(*on), on, "left_anti")


def union_named(**tables: DataFrame) -> DataFrame:
    """Stack tables by column name and tag each row with the table it came from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn("subset", F.lit(name)) for name, df in tables.items()])
