"""Custom state: as-of history answered at the cutoff, and a running average of class probabilities."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sweep import group_ids, last_before
from .windows import ORIGIN, with_event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    """``transformWithStateInPandas`` in append mode; it needs the RocksDB state store."""
    df.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", time_mode)


def on_shelves(df: DataFrame, key: str, shelves: int | None) -> tuple[DataFrame, list[str]]:
    """The rows and the columns that state hangs on: the key, or one of ``shelves`` hashes of it, on which many keys share their entries.
    Every entry and timer costs a call, whatever it holds; a stream of many small keys needs far fewer on shelves. A checkpoint keeps its number."""
    if shelves is None:
        return df, [key]
    return df.withColumn("shelf", F.pmod(F.xxhash64(key), F.lit(shelves)).cast("int")), ["shelf"]


def packed(table: pa.Table) -> bytes:
    """A table as one value of a state entry."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(value)).read_all()


ANSWERS = "narration_id string, video_id string, sta_cutoff double, used array<double>, row array<long>"
CLIPS = pa.schema([("video_id", pa.string()), ("t", pa.float64()), ("row", pa.int64())])
WAITING = pa.schema([("narration_id", pa.string()), ("video_id", pa.string()), ("t", pa.float64())])


class _History(StatefulProcessor):
    """Per video or shelf of videos: clips by slice of time, and events by the slot of time in which they are answered.

    A slice is written and read alone, so a timer touches only what it answers or forgets; clips set the timers that forget
    them, whether their video has events or not."""

    def __init__(self, steps: int, stride: float, tolerance: float, eps: float):
        self.steps, self.stride, self.tolerance, self.eps = steps, stride, tolerance, eps
        self.slice = max(stride, (steps * stride + tolerance) / 4)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clips = handle.getMapState("clips", "slice long", "rows binary")
        self.waiting = handle.getMapState("waiting", "due long", "rows binary")

    def _slots(self, cutoffs: np.ndarray) -> np.ndarray:
        """Time in ms at which an event is answered: after the next multiple of the stride, one timer for all of a slot. These timers are
        even and those of `_forget_at` odd, so that a timer tells what it is for."""
        return ((np.ceil((cutoffs + self.eps) / self.stride) * self.stride * 1000).astype(np.int64) + ORIGIN // 1000 + 2) & ~1

    def _forget_at(self, piece: int) -> int:
        """Time in ms after which no event can use a clip of the slice: later than the slot of any event that can."""
        reach = self.steps * self.stride + self.tolerance + 2 * self.stride + 1
        return int(math.ceil(((piece + 1) * self.slice + reach) * 1000)) + ORIGIN // 1000 | 1

    def _extend(self, state, key: int, rows: pa.Table) -> bool:
        """Append to the rows of one entry; whether it is new."""
        old = state.getValue((int(key),)) if state.containsKey((int(key),)) else None
        state.updateValue((int(key),), (packed(rows if old is None else pa.concat_tables([unpacked(old[0]), rows])),))
        return old is None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            t, is_clip = batch["t"].to_numpy(float), (batch["kind"] == "clip").to_numpy()
            finite = np.isfinite(t)
            clips = np.flatnonzero(is_clip & finite)  # others are never the last before a step
            piece = np.floor(t[clips] / self.slice).astype(np.int64)
            for one in np.unique(piece):
                if self._extend(self.clips, one, pa.Table.from_pandas(batch.iloc[clips[piece == one]], CLIPS, preserve_index=False)):
                    self.handle.registerTimer(self._forget_at(int(one)))
            cold = ~is_clip & ~(finite & (t >= 0))
            if cold.any():
                yield self._answers(pa.Table.from_pandas(batch[cold], WAITING, preserve_index=False), CLIPS.empty_table())
            live = np.flatnonzero(~is_clip & ~cold)
            slots = self._slots(t[live])
            for due in np.unique(slots):
                if self._extend(self.waiting, due, pa.Table.from_pandas(batch.iloc[live[slots == due]], WAITING, preserve_index=False)):
                    self.handle.registerTimer(int(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if due % 2 == 0:
            events = unpacked(self.waiting.getValue((due,))[0])
            self.waiting.removeKey((due,))
            cutoffs = np.asarray(events.column("t"))
            first, last = (cutoffs.min() - self.steps * self.stride - self.tolerance - 1, cutoffs.max() + self.eps)
            pieces = [unpacked(self.clips.getValue((p,))[0]) for p in range(int(first // self.slice), int(last // self.slice) + 1) if self.clips.containsKey((p,))]
            yield self._answers(events, pa.concat_tables([CLIPS.empty_table(), *pieces]))
            return
        piece = round((due - ORIGIN // 1000) / 1000 / self.slice - (self.steps * self.stride + self.tolerance + 2 * self.stride + 1) / self.slice - 1)
        for one in (piece - 1, piece, piece + 1):
            if self._forget_at(one) == due and self.clips.containsKey((one,)):
                self.clips.removeKey((one,))

    def _answers(self, events: pa.Table, clips: pa.Table) -> pd.DataFrame:
        """One row per event with a clip (or NaN and -1) for each of its steps; of clips at one time the one with the highest row."""
        clips = clips.sort_by("row")
        videos = group_ids(pa.concat_tables([clips.select(["video_id"]), events.select(["video_id"])]), ["video_id"])
        times, clip_rows, cutoffs = (np.asarray(c) for c in (clips.column("t"), clips.column("row"), events.column("t")))
        tau = (cutoffs[:, None] - (self.steps - np.arange(1, self.steps + 1)) * self.stride).reshape(-1)
        at = last_before(videos[:len(times)], times, np.repeat(videos[len(times):], self.steps), tau + self.eps)
        used = np.append(times, np.nan)[at]
        ok = (at >= 0) & (np.repeat(cutoffs, self.steps) >= 0) & (tau >= 0) & (tau - used <= self.tolerance + self.eps)
        used, row = np.where(ok, used, np.nan), np.where(ok, np.append(clip_rows, -1)[at], -1)
        return pd.DataFrame({"narration_id": events.column("narration_id").to_pandas(), "video_id": events.column("video_id").to_pandas(), "sta_cutoff": cutoffs,
                             "used": list(used.reshape(-1, self.steps)), "row": list(row.reshape(-1, self.steps))})

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, bank: DataFrame, steps: int = 16, stride: float = 1.0, tolerance: float | None = None,
                   eps: float = 1e-6, lateness: str = "10 seconds", shelves: int | None = None) -> DataFrame:
    """As-of history over streams of events (``narration_id, video_id, sta_cutoff``) and clips
    (``video_id, t_end_s, row``). Each input has its own watermark and the slower one counts, so clips that run ahead make no event late. An
    event is answered when the watermark passes its cutoff, so every
    clip it may use has arrived; a negative cutoff is answered at once. Clips are forgotten
    about ``steps * stride + tolerance`` behind the watermark, also in videos without events. ``row`` is -1 for invalid steps. Streams of many
    videos should share ``shelves`` (see ``on_shelves``); steps are opened outside Python."""
    e = with_event_time(events, "sta_cutoff").withWatermark("ts", lateness).select(
        "video_id", "ts", F.lit("event").alias("kind"), "narration_id", F.col("sta_cutoff").alias("t"), F.lit(-1).cast("long").alias("row"))
    b = with_event_time(bank, "t_end_s").withWatermark("ts", lateness).select(
        "video_id", "ts", F.lit("clip").alias("kind"), F.lit("").alias("narration_id"), F.col("t_end_s").alias("t"), F.col("row").cast("long").alias("row"))
    rows, keys = on_shelves(e.unionByName(b), "video_id", shelves)
    answers = stateful(rows, keys, _History(steps, stride, stride if tolerance is None else tolerance, eps), ANSWERS, "EventTime")
    opened = answers.select("narration_id", "video_id", "sta_cutoff", F.posexplode(F.arrays_zip("used", "row")).alias("_slot", "_clip"))
    used = F.col("_clip.used")
    valid = used.isNotNull() & ~F.isnan(used)
    return opened.select("narration_id", "video_id", (F.col("_slot") + 1).alias("k"), (F.col("sta_cutoff") - (steps - 1 - F.col("_slot")) * F.lit(float(stride))).alias("tau"),
                         valid.alias("valid"), F.when(valid, used).alias("used_time"), F.col("_clip.row").alias("row"))


class _Ema(StatefulProcessor):
    """Per key: the running vector and the last step that was used."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "k long, q array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("k", kind="stable")
        last, q = self.state.get() if self.state.exists() else (-(2 ** 62), None)
        q = None if q is None else np.asarray(q, dtype="float64")
        stale = int((batch["k"] <= last).sum())
        for k, ok, p in batch.loc[batch["k"] > last, ["k", "valid", "p"]].itertuples(index=False):
            p = np.asarray(p, dtype="float64")
            q = np.zeros_like(p) if q is None else q
            if ok:
                q = self.alpha * p + (1 - self.alpha) * q
            last = int(k)
        if q is not None:
            self.state.update((last, [float(x) for x in q]))
            yield pd.DataFrame({"key": [str(key[0])], "k": [last], "ema": [q.tolist()], "out_of_order": [stale]})

    def close(self) -> None:
        pass


def ema_stream(steps: DataFrame, key: str, value: str, valid: str, order: str = "k", alpha: float = 0.8) -> DataFrame:
    """After each micro-batch, the running average of every key that got steps. Steps that arrive after
    a later one was used are counted in ``out_of_order``, not applied."""
    rows = steps.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("k"),
                        F.col(valid).alias("valid"), F.col(value).cast("array<double>").alias("p"))
    return stateful(rows, ["key"], _Ema(alpha), "key string, k long, ema array<double>, out_of_order int", "None")
