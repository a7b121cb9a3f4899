"""Stream gates: leakage quarantine, duplicates, order violations and late rows."""
from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from .stateful import on_shelves, packed, stateful, unpacked


def guard_stream(features: DataFrame, cutoffs: DataFrame, good_path: str, quarantine_path: str, checkpoint: str,
                 eps: float = 1e-6, **trigger) -> StreamingQuery:
    """Send arriving features (``narration_id, time``) to the good sink, or to quarantine with a reason
    when they end after the cutoff, belong to a cold start or to no known event.

    Every micro-batch overwrites its own folder, so a retried batch leaves no second copy."""
    known = cutoffs.select("narration_id", "sta_cutoff")

    def split(batch: DataFrame, batch_id: int) -> None:
        j = batch.join(known, "narration_id", "left")
        t, c = F.col("time"), F.col("sta_cutoff")
        reason = (F.when(c.isNull(), "unknown_event").when(t.isNull() | ~(F.abs(t) < F.lit(float("inf"))), "bad_time")
                  .when(c < 0, "negative_cutoff").when(t > c + eps, "after_cutoff"))
        tagged = j.withColumn("reason", reason).persist()
        try:
            folder = f"batch={batch_id}"
            tagged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{good_path}/{folder}")
            tagged.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{quarantine_path}/{folder}")
        finally:
            tagged.unpersist()

    return features.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def dedupe_stream(rows: DataFrame, keys: list[str], event_time: str = "ts", lateness: str = "10 seconds") -> DataFrame:
    """Drop repeated keys (an event id, or a video and clip end) within the watermark delay."""
    return rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


class _Order(StatefulProcessor):
    """Remembers the last time of each video in arrival order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("position", kind="stable", ignore_index=True)
        known = unpacked(self.last.get()[0]).to_pandas().set_index("video_id")["t"] if self.last.exists() else pd.Series(dtype="float64")
        times = batch["pts"].to_numpy(float)
        code, videos = pd.factorize(batch["video_id"], use_na_sentinel=False)
        before = known.reindex(videos).fillna(float("-inf")).to_numpy()
        # a time that is not a number is never the latest
        high = pd.Series(np.fmax(times, before[code])).groupby(code).cummax()
        previous = np.fmax(high.groupby(code).shift(1).to_numpy(float), before[code])
        bad = times < previous
        latest = pd.concat([known.drop(videos, errors="ignore"), pd.Series(high.groupby(code).max().to_numpy(), index=videos)])
        self.last.update((packed(pa.table({"video_id": pa.array(latest.index, pa.string(), from_pandas=True), "t": pa.array(latest.to_numpy(float))})),))
        yield pd.DataFrame({"video_id": batch["video_id"][bad], "position": batch["position"][bad], "pts": times[bad], "previous": previous[bad]})

    def close(self) -> None:
        pass


def order_violations_stream(frames: DataFrame, shelves: int | None = None) -> DataFrame:
    """Frames (``video_id, position, pts``) whose time lies before an earlier frame of the video. Streams of many videos should share
    ``shelves`` (see ``on_shelves``)."""
    rows, keys = on_shelves(frames.select("video_id", "position", "pts"), "video_id", shelves)
    return stateful(rows, keys, _Order(), "video_id string, position long, pts double, previous double", "None")


def late_rows_stream(rows: DataFrame, time: str, lateness: float, good_path: str, late_path: str, checkpoint: str,
                     marks_path: str | None = None, **trigger) -> StreamingQuery:
    """Send rows that lie more than ``lateness`` seconds before the latest ``time`` (seconds) of all earlier micro-batches to the late sink,
    with that limit and a reason; rows without a finite time go there too. The others go to the good sink, which later stages may read with a
    watermark of this lateness without losing a row.

    The latest time so far is stored beside the good rows, one row per micro-batch that carries it on, so a restarted query goes on with
    it; a retried batch overwrites its own folders."""
    marks = marks_path or f"{good_path.rstrip('/')}-marks"
    spark = rows.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            t = F.col(time).cast("double")
            sound = F.coalesce(F.abs(t) < F.lit(float("inf")), F.lit(False))
            high = None
            if batch_id:
                high = spark.read.schema("high double").parquet(f"{marks}/batch={batch_id - 1}").agg(F.max("high")).first()[0]
            limit = F.lit(None if high is None else high - lateness).cast("double")
            reason = F.when(~sound, "bad_time").when(t < limit, "behind_watermark")
            tagged = batch.withColumn("watermark", limit).withColumn("reason", reason)
            folder = f"batch={batch_id}"
            tagged.where("reason IS NULL").drop("reason", "watermark").write.mode("overwrite").parquet(f"{good_path}/{folder}")
            tagged.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{late_path}/{folder}")
            latest = batch.agg(F.max(F.when(sound, t)).alias("high")).select(F.greatest("high", F.lit(high).cast("double")).alias("high"))
            latest.write.mode("overwrite").parquet(f"{marks}/{folder}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class LateCounter(StreamingQueryListener):
    """Counts, over the whole run of each query, the rows that came in and those that its stateful operators dropped behind the
    watermark. Every progress report is seen once as it is made, so long runs lose none. Add it with ``spark.streams.addListener``."""

    def __init__(self):
        self._runs: dict[str, dict] = {}
        self._lock = threading.Condition()

    def _run(self, run_id) -> dict:
        return self._runs.setdefault(str(run_id), {"rows": 0, "late_rows": 0, "batches": 0, "watermark": None, "ended": False})

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._run(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            run = self._run(p.runId)
            run["rows"] += p.numInputRows
            run["late_rows"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            run["batches"] += 1
            run["watermark"] = (p.eventTime or {}).get("watermark", run["watermark"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._run(event.runId)["ended"] = True
            self._lock.notify_all()

    def counts(self, query: StreamingQuery, timeout: float = 60.0) -> dict:
        """rows, late_rows, batches and the last watermark of a query's run; waits for the last report of one that has ended."""
        with self._lock:
            if not query.isActive and not self._lock.wait_for(lambda: self._run(query.runId)["ended"], timeout):
                raise TimeoutError("the end of the query was not reported")
            return {k: v for k, v in self._run(query.runId).items() if k != "ended"}
