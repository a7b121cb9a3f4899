"""Temporal joins on event timelines: history grids, next actions, frame sampling, clip banks."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import observation
from .asof import Grid, asof
from .sweep import buckets, first_after, group_ids, last_before, numbers, swept

EPS = 1e-6

# How a history step got its clip.
BANK, EXACT = "bank", "exact"
ANCHOR = ("anchor_row", "anchor_end")


@dataclass(frozen=True)
class Actions:
    """Labelled events that may follow a step: the first that starts in ``[tau + lo, tau + hi]``, of the same video and the same values of
    the columns ``within``."""
    events: DataFrame
    lo: float = 0.5
    hi: float = 2.5
    within: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.lo < self.hi:
            raise ValueError("need lo < hi")


def history(events: DataFrame, bank: DataFrame, steps: int = 16, stride: float = 1.0,
            tolerance: float | str | None = "stride", allow_negative_tau: bool = False, eps: float = EPS,
            anchors: DataFrame | None = None, keep: tuple[str, ...] = (), hot_rows: int | None = None,
            actions: Actions | None = None) -> DataFrame:
    """One row per (event, k): the latest bank clip that ends at or before
    ``tau_k = cutoff - (steps - k) * stride``.

    A step is invalid (times NULL) when the cutoff or tau is negative, when no clip ends early
    enough, or when the nearest is older than ``tolerance`` (``"stride"`` by default, ``None`` for
    no limit; ``allow_negative_tau`` keeps steps before the video start). With ``anchors`` (event
    features with ``has_clip``, ``row``, ``sta_clip_end_s``), an exact clip takes the last step and its own
    end becomes the step's time, so a clip that ends after the cutoff shows up in ``check_before_cutoff``. With ``actions``,
    valid steps also get their ``next_verb`` and ``next_noun`` (see ``next_action``). Only index columns and the event columns named in
    ``keep`` travel; join vectors last.

    With a tolerance, events, clips and actions meet in one shuffle (``sweep``); without one, matches may lie any
    number of buckets away (``asof``), and actions follow in a second pass."""
    limit = float(stride) if tolerance == "stride" else tolerance
    span = steps * float(stride)
    if steps < 1 or not stride > 0:
        raise ValueError("need steps >= 1 and stride > 0")
    wanted = [*keep, *((c for c in actions.within if c not in keep) if actions else ())]
    source = events.select("narration_id", "video_id", "sta_cutoff", *wanted)
    if anchors is not None:
        exact = _exact(anchors)
        source = source.join(exact, "narration_id", "left")
    carried = [*wanted, *(ANCHOR if anchors is not None else [])]

    if limit is None:
        def tau(slot: Column) -> Column:
            return F.col("sta_cutoff") - (steps - 1 - slot) * F.lit(float(stride))

        grid = Grid(steps, lambda slot: tau(slot) + eps)
        matched = asof(source, bank, ["video_id"], grid, "t_end_s", ["row"], width=span, tie="row", hot_rows=hot_rows)
        matched = matched.withColumn("tau", tau(F.col("slot"))).select(
            "narration_id", "video_id", "sta_cutoff", *carried, (F.col("slot") + 1).alias("k"), "tau", F.col("before.time").alias("_u"), F.col("before.row").alias("_r"))
    else:
        matched = _swept_history(source, bank, steps, float(stride), limit, eps, carried, hot_rows, actions)
    used = F.col("_u")
    ok = used.isNotNull() & (F.col("sta_cutoff") >= 0)
    if not allow_negative_tau:
        ok &= F.col("tau") >= 0
    if limit is not None:
        ok &= F.col("tau") - used <= limit + eps
    base = ["narration_id", "video_id", "sta_cutoff", *wanted, "k", "tau"]
    following = ["_verb", "_noun"] if actions is not None and limit is not None else []
    out = matched.withColumn("valid", F.coalesce(ok, F.lit(False)))
    out = out.select(*base, F.when(F.col("valid"), F.col("_u")).alias("used_time"), F.when(F.col("valid"), F.col("_r")).alias("row"), "valid",
                     F.when(F.col("valid"), F.lit(BANK)).alias("source"), *following, *(ANCHOR if anchors is not None else []))
    if anchors is not None:
        replaced = (F.col("k") == steps) & F.col("anchor_row").isNotNull() & (F.col("sta_cutoff") >= 0)
        out = _apply_exact(out, F.coalesce(replaced, F.lit(False))).drop(*ANCHOR)
    if actions is None:
        return out
    if limit is None:
        return next_action(out, actions.events, actions.lo, actions.hi, eps, ("video_id", *actions.within), hot_rows)
    return out.select("*", F.when(F.col("valid"), F.col("_verb")).alias("next_verb"), F.when(F.col("valid"), F.col("_noun")).alias("next_noun")).drop(*following)


def _swept_history(source: DataFrame, bank: DataFrame, steps: int, stride: float, limit: float, eps: float, carried: list[str],
                   hot_rows: int | None, actions: Actions | None) -> DataFrame:
    """Every step with the last clip at or before it (``_u``, ``_r``) and the first action in its window (``_verb``, ``_noun``): one shuffle of
    events, clips and actions; a cell of an event returns its steps as arrays, which are opened outside Python."""
    width = max(steps * stride, limit + 4 * eps)
    c = F.col("sta_cutoff")
    asks = source.withColumn("_b", F.explode(buckets(c - (steps - 1) * F.lit(stride) + eps, c + eps, width)))
    t = F.col("t_end_s").cast("double")
    clips = bank.where(t.isNotNull() & ~F.isnan(t)).groupBy("video_id", t.alias("_t")).agg(F.max("row").alias("_r"))
    clips = clips.withColumn("_b", F.explode(buckets(F.col("_t"), F.col("_t") + limit + 4 * eps, width)))
    facts, within, lo, hi, labelled = [clips], [], 0.0, 0.0, actions is not None
    if labelled:
        within = list(actions.within)
        lo, hi, start = actions.lo, actions.hi, F.col("start").cast("double")
        first = F.min_by(F.struct("verb", "noun"), F.col("narration_id"))
        starts = actions.events.where(F.col("verb").isNotNull() & start.isNotNull()).groupBy("video_id", *within, start.alias("_t")).agg(first.alias("_a"))
        facts.append(starts.select("video_id", *within, "_t", F.col("_a.verb").cast("long").alias("_verb"), F.col("_a.noun").cast("long").alias("_noun"),
                                   F.explode(buckets(F.col("_t") - hi - 2 * eps, F.col("_t") - lo + 2 * eps, width)).alias("_b")))
    back = (steps - 1 - np.arange(steps)) * stride
    columns = ["narration_id", "video_id", "sta_cutoff", *carried]
    answers = ["_u", "_r", "_verb", "_noun"] if actions is not None else ["_u", "_r"]

    def kernel(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("_side"))
        group = group_ids(table, ["video_id", "_b", "_part"])
        time = numbers(table, "_t")
        ask, clip = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cutoff, bucket = numbers(table, "sta_cutoff")[ask], numbers(table, "_b")[ask]
        tau = cutoff[:, None] - back
        mine = (np.floor((tau + eps) / width) == bucket[:, None]) | np.isnan(bucket)[:, None]
        row, slot = np.nonzero(mine)
        tau = tau[row, slot]
        found = last_before(group[clip], time[clip], group[ask][row], tau + eps)
        clip = np.append(clip, -1)[found]  # -1: none
        values = [(time, pa.float64(), clip), (np.asarray(table.column("_r").combine_chunks().fill_null(-1)), pa.int64(), clip)]
        if labelled:
            act = np.flatnonzero(side == 2)
            own = group_ids(table, ["video_id", "_b", "_part", *within])
            found = first_after(own[act], time[act], own[ask][row], tau + (lo - eps))
            found = np.where((found >= 0) & (np.append(time[act], np.nan)[found] <= tau + hi + eps), found, -1)
            act = np.append(act, -1)[found]
            values += [(np.asarray(table.column(c).combine_chunks().fill_null(-1)), pa.int64(), act) for c in ("_verb", "_noun")]
        counts = mine.sum(1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))

        def lists(flat: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, flat)

        arrays = {"_k": lists(pa.array((slot + 1).astype(np.int32))), "_tau": lists(pa.array(tau, mask=np.isnan(tau)))}
        for name, (data, kind, at) in zip(answers, values):
            data = np.append(data, 0)[at]
            arrays[name] = lists(pa.array(data, kind, mask=at < 0))
        taken = table.select(columns).take(pa.array(ask))
        return pa.table({**{c: taken.column(c) for c in columns}, **arrays})

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "_k array<int>", "_tau array<double>", "_u array<double>", "_r array<long>"]
                       + (["_verb array<long>", "_noun array<long>"] if actions is not None else []))
    cells = swept(asks, facts, ["video_id"], kernel, schema, steps, hot_rows)
    opened = cells.select(*columns, F.inline(F.arrays_zip("_k", "_tau", *answers)))
    label = [F.col(c).cast(actions.events.schema[c[1:]].dataType).alias(c) for c in answers[2:]] if actions is not None else []
    return opened.select(*columns, F.col("_k").alias("k"), F.col("_tau").alias("tau"), "_u", F.col("_r").cast(bank.schema["row"].dataType).alias("_r"), *label)


def _exact(features: DataFrame) -> DataFrame:
    return features.where(F.col("has_clip")).select("narration_id", F.col("row").alias("anchor_row"), F.col("sta_clip_end_s").alias("anchor_end"))


def _apply_exact(h: DataFrame, replaced: Column) -> DataFrame:
    return (h.withColumn("_x", replaced)
            .withColumn("used_time", F.when(F.col("_x"), F.col("anchor_end")).otherwise(F.col("used_time")))
            .withColumn("row", F.when(F.col("_x"), F.col("anchor_row")).otherwise(F.col("row")))
            .withColumn("source", F.when(F.col("_x"), F.lit(EXACT)).otherwise(F.col("source")))
            .withColumn("valid", F.col("valid") | F.col("_x")).drop("_x"))


def use_exact_anchor(history_rows: DataFrame, event_features: DataFrame, steps: int = 16) -> DataFrame:
    """Let an event's exact clip take its last history step. ``history(anchors=...)`` does the same
    with one feature row per event instead of one per step; prefer it when building from scratch."""
    exact = _exact(event_features)
    joined = history_rows.join(exact, "narration_id", "left")
    replaced = (F.col("k") == steps) & F.col("anchor_row").isNotNull() & (F.col("sta_cutoff") >= 0)
    return _apply_exact(joined, F.coalesce(replaced, F.lit(False))).drop(*ANCHOR).select(*history_rows.columns)


def present_clip(history_rows: DataFrame, event_features: DataFrame, steps: int = 16) -> DataFrame:
    """Where an event's present clip comes from: 1 its exact clip, 2 the bank clip of the last step,
    0 nowhere. ``present_row`` is a feature row for source 1 and a bank row for source 2."""
    last = history_rows.where(F.col("k") == steps)
    exact = event_features.where(F.col("has_clip")).select("narration_id", F.col("row").alias("_exact"))
    j = last.join(exact, "narration_id", "left")
    own = F.col("_exact").isNotNull() & (F.col("sta_cutoff") >= 0)
    near = F.col("valid") & (F.col("source") == BANK)
    return j.select("narration_id", "video_id",
                    F.when(own, 1).when(near, 2).otherwise(0).alias("present_source"),
                    F.when(own, F.col("_exact")).when(near, F.col("row")).alias("present_row"))


def next_action(steps: DataFrame, events: DataFrame, lo: float = 0.5, hi: float = 2.5, eps: float = EPS,
                by: tuple[str, ...] = ("video_id",), hot_rows: int | None = None,
                load: tuple[DataFrame, str, float, int] | None = None) -> DataFrame:
    """Label each valid step with the first labelled action starting in ``[tau + lo, tau + hi]``
    (ties by start, then id); invalid steps and steps without such an action get NULL. ``load``
    is a cheap bound on the number of steps per time, as in ``asof``."""
    if not lo < hi:
        raise ValueError("need lo < hi")
    span = hi - lo + 4 * eps
    probes = steps.withColumn("_from", F.col("tau") + (lo - eps))
    labelled = events.where(F.col("verb").isNotNull())
    m = asof(probes, labelled, list(by), "_from", "start", ["narration_id", "verb", "noun"],
             width=max(64.0, 16 * span), lookback=span, direction="forward", tie="narration_id",
             hot_rows=hot_rows, load=load)
    hit = F.col("valid") & (F.col("after.time") <= F.col("tau") + hi + eps)
    return m.select(*steps.columns, F.when(hit, F.col("after.verb")).alias("next_verb"),
                    F.when(hit, F.col("after.noun")).alias("next_noun"))


def nearest_frames(windows: DataFrame, frames: DataFrame, num_targets: int = 8, width: float = 64.0,
                   hot_rows: int | None = None) -> DataFrame:
    """For each target (mid-point of equal bins of the window) the nearest legal frame; of two equally
    near, the earlier one. An empty window gives no rows, a window without frames NULL times."""
    w = windows.where(~F.col("observation.empty"))
    keys = [c for c in w.columns if c != "observation"]
    lo, hi = F.col("observation.start"), F.col("observation.end")
    probes = w.select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.col("observation.inclusive_end").alias("_closed"))
    if num_targets < 1:
        raise ValueError("need at least one target")
    grid = Grid(num_targets, lambda i: F.col("_lo") + (i + F.lit(0.5)) * (F.col("_hi") - F.col("_lo")) / F.lit(num_targets))
    m = asof(probes, frames, ["video_id"], grid, "pts", width=width, direction="both", hot_rows=hot_rows)
    m = m.withColumnRenamed("time", "target")
    a, b = F.col("before.time"), F.col("after.time")
    a = F.when(a >= F.col("_lo"), a)
    b = F.when((b < F.col("_hi")) | (F.col("_closed") & (b == F.col("_hi"))), b)
    pick = (F.when(a.isNull(), b).when(b.isNull(), a)
            .when(F.abs(F.col("target") - a) <= F.abs(F.col("target") - b), a).otherwise(b))
    return m.select(*keys, "slot", "target", pick.alias("frame_time"))


def event_clip_ends(events: DataFrame, frames: DataFrame, context: float = 5.0, num_frames: int = 16, width: float = 64.0,
                    hot_rows: int | None = None) -> DataFrame:
    """Feature index of every event: the ends of its two clips, from one pass over the frames.

    A clip of ``num_frames`` frames ends with the frame nearest to the window's last target (earlier of two equally near), among the
    frames of the window: ``[start, stop)`` for the action itself, ``[max(0, cutoff - context), cutoff]`` for what may be observed before it.
    ``ar_clip_end_s`` and ``sta_clip_end_s`` are -1 where the window has no frame; ``use_prior`` marks events whose observation is empty.

    An event lies in every bucket that one of its windows touches, next to the bucket's frames; each bucket returns the nearest frame it has for
    either window, and the nearest of all buckets is chosen per event. So events and frames are shuffled once, and one row per event and bucket
    once more. Frames before time zero, and events with a negative start, have no clips; an event without an id is kept."""
    if num_frames < 1 or not context > 0:
        raise ValueError("need num_frames >= 1 and context > 0")
    keep = ["narration_id", "video_id", "start", "stop", "sta_cutoff"]
    windows = {"ar": observation("start", "stop", "sta_cutoff", F.lit("AR"), context), "sta": observation("start", "stop", "sta_cutoff", F.lit("STA"), context)}
    asks = events.select(*keep, *(w.alias(f"_{k}") for k, w in windows.items()))
    for k in windows:
        usable = ~F.col(f"_{k}.empty") & (F.col(f"_{k}.start") >= 0) & (F.col(f"_{k}.end") >= F.col(f"_{k}.start"))
        asks = asks.withColumn(f"_{k}_lo", F.when(usable, F.col(f"_{k}.start"))).withColumn(f"_{k}_hi", F.when(usable, F.col(f"_{k}.end"))).drop(f"_{k}")
    cells = F.array_distinct(F.concat(*(buckets(F.col(f"_{k}_lo"), F.col(f"_{k}_hi"), width) for k in windows)))
    asks = asks.withColumn("_b", F.explode(cells))
    t = F.col("pts").cast("double")
    facts = frames.where((t >= 0) & (t < float("inf"))).select("video_id", t.alias("_t")).withColumn("_b", F.floor(F.col("_t") / F.lit(float(width))))
    last = (num_frames - 0.5) / num_frames

    def kernel(table: pa.Table) -> pa.Table:
        side, group, time = np.asarray(table.column("_side")), group_ids(table, ["video_id", "_b", "_part"]), numbers(table, "_t")
        ask, frame = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = {c: table.column(c).take(pa.array(ask)) for c in keep}
        frame_time, frame_group, own = np.append(time[frame], np.nan), group[frame], group[ask]
        for k, closed in (("ar", False), ("sta", True)):
            lo, hi = numbers(table, f"_{k}_lo")[ask], numbers(table, f"_{k}_hi")[ask]
            target = lo + (hi - lo) * last
            before = frame_time[last_before(frame_group, time[frame], own, target)]
            after = frame_time[first_after(frame_group, time[frame], own, target)]
            before = np.where(before >= lo, before, np.nan)
            after = np.where((after < hi) | (closed & (after == hi)), after, np.nan)
            before = np.where((before < hi) | (closed & (before == hi)), before, np.nan)
            far = np.isnan(before) | (np.abs(target - after) < np.abs(target - before))
            end = np.where(far, after, before)
            out[f"_{k}_off"] = pa.array(np.abs(target - end), mask=np.isnan(end))
            out[f"_{k}_end"] = pa.array(end, mask=np.isnan(end))
        return pa.table(out)

    kinds = {f.name: f.dataType.simpleString() for f in asks.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f"_{k}_{x} double" for k in windows for x in ("off", "end"))])
    found = swept(asks, [facts], ["video_id"], kernel, schema, 2, hot_rows)
    nearest = [F.min(F.when(F.col(f"_{k}_end").isNotNull(), F.struct(f"_{k}_off", f"_{k}_end"))).alias(f"_{k}") for k in windows]
    ends = found.groupBy(*keep).agg(*nearest)
    return ends.select("narration_id", "video_id", F.col("start").alias("action_start_s"), F.col("stop").alias("action_stop_s"),
                       *(F.coalesce(F.col(f"_{k}._{k}_end"), F.lit(-1.0)).alias(f"{k}_clip_end_s") for k in windows),
                       F.col("_sta").isNull().alias("use_prior"))


def check_action_clips(index: DataFrame) -> DataFrame:
    """Violations: events whose own interval holds no frame."""
    return index.where(F.col("ar_clip_end_s") < 0).select(F.lit("empty_action_clip").alias("check"), F.col("narration_id").alias("id"),
                                                          F.concat_ws(" ", F.lit("from"), "action_start_s", F.lit("to"), "action_stop_s").alias("detail"))


def clip_bank(frames: DataFrame, length: float = 2.0, stride: float = 1.0, min_end: DataFrame | None = None,
              num_frames: int | None = 16) -> DataFrame:
    """Windows ``[max(0, e - length), e]`` at ``e = stride, 2 * stride, ...``, both ends closed.

    ``t_end_s`` is the time of the frame nearest to the last of ``num_frames`` targets (the last
    frame of a sampled clip), or the last frame of all with ``num_frames=None``; -1 when the window
    has no frame. The bank runs to the last frame or to ``min_end`` (video_id, min_end), whichever
    is later, plus one stride. ``row`` counts windows of a video from 0."""
    step, size = F.lit(float(stride)), F.lit(float(length))
    f = frames.where(F.col("pts") >= 0).select("video_id", F.col("pts").cast("double").alias("pts"))
    around = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("pts") / step) - 1),
                        F.floor((F.col("pts") + size) / step) + 1)
    closed = (F.col("pts") <= F.col("w") * step) & (F.col("pts") >= F.col("w") * step - size)
    seen = f.select("video_id", "pts", F.explode(around).alias("w")).where(closed)
    ends = f.groupBy("video_id").agg(F.max("pts").alias("_end"))
    if min_end is not None:
        extra = min_end.groupBy("video_id").agg(F.max("min_end").alias("_end"))
        ends = ends.unionByName(extra).groupBy("video_id").agg(F.max("_end").alias("_end"))
    last = F.floor((F.col("_end") + step) / step)
    spine = (ends.select("video_id", F.explode(F.sequence(F.lit(1), last)).alias("w"))
             .withColumn("pts", F.lit(None).cast("double")).withColumn("_spine", F.lit(True)))
    end = F.col("w") * step
    begin = F.greatest(F.lit(0.0), end - size)
    if num_frames is None:
        chosen = F.max("pts")
    else:
        target = begin + (end - begin) * F.lit((num_frames - 0.5) / num_frames)
        off = F.when(F.col("pts").isNotNull(), F.struct(F.abs(F.col("pts") - target), F.col("pts")))
        chosen = F.min_by("pts", off)
    return (seen.unionByName(spine, allowMissingColumns=True)
            .groupBy("video_id", "w")
            .agg(F.max("_spine").alias("_spine"), F.count("pts").alias("frames"),
                 F.max("pts").alias("last_pts"), chosen.alias("_picked"))
            .where(F.col("_spine"))
            .select("video_id", (F.col("w") - 1).alias("row"), begin.alias("window_start"),
                    end.alias("window_end"), "frames", "last_pts",
                    F.coalesce(F.col("_picked"), F.lit(-1.0)).alias("t_end_s")))


def check_increasing(bank: DataFrame, order: str = "row") -> DataFrame:
    """Violations where a clip end is not finite or not later than the one before it."""
    finite = F.col("t_end_s").isNotNull() & (F.abs(F.col("t_end_s")) < F.lit(float("inf")))
    rows = bank.select("video_id", F.col(order).alias("row"), "t_end_s").withColumn("_ok", F.coalesce(finite, F.lit(False)))
    m = asof(rows, rows, ["video_id"], "row", "row", ["t_end_s"], width=65536.0, strict=True)
    bad = ~F.col("_ok") | (F.col("t_end_s") <= F.col("before.t_end_s"))
    return m.where(bad).select(F.lit("clip_times").alias("check"), F.col("video_id").alias("id"),
                               F.concat_ws(" ", F.lit("row"), "row", F.lit("time"), "t_end_s").alias("detail"))
