"""Streaming twins and file round trips over the driver tables (T1-T7, S1-S11, R1, R2)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sources as SRC, streaming as ST
from ..operators import events as E, report as R, splits as SP, stats as S, temporal as T
from ..sources.scratch import fresh_folder
from . import views as V
from .registry import query, r6, sql6
from .statistics_queries import GREEDY, counts, raw_bank, split
from .temporal_queries import CLIPS


def as_stream(df: DataFrame, folder: str) -> DataFrame:
    """Write a table to shared storage and read it back as a stream of files."""
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def arriving(df: DataFrame, folder: str, batches: int, place) -> DataFrame:
    """A stream of ``batches`` micro-batches: one file each, in the order of ``place`` (0 to batches - 1)."""
    for i in range(batches):
        df.where(place == i).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything there is and return its appended output."""
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


SHELVES = 512
FLUSH = 90 * V.DAY  # a last row far ahead lets the watermark pass everything before it


def flushed(spark: SparkSession, rows: DataFrame, **values) -> DataFrame:
    """Add one far-ahead row, which only moves the watermark."""
    tail = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in values))
    return rows.unionByName(tail)


@query("t1_clip_bank_stream", V.cte(V.EV, V.BANK, CLIPS) + f"""
SELECT video_id, w - 1 AS "row", count(pts) AS frames, {sql6('max(pts)')} AS last_pts, {sql6('arg_min(pts, off)')} AS t_end_s FROM inside GROUP BY video_id, w HAVING count(pts) > 0""")
def t1(spark, sf):
    folder = fresh_folder(spark, "clip-bank")
    src = flushed(spark, V.frames(spark, sf), video_id="~", pts=FLUSH)
    ends = V.action_events(spark, sf).groupBy("video_id").agg(F.max("stop").alias("end"))
    clips = drained(ST.clip_bank_stream(as_stream(src, f"{folder}/in"), 2 * V.DAY, V.DAY, "1 second"), folder)
    # the batch bank ends one stride after the last frame or event
    clips = clips.join(ends, "video_id").where(F.col("window_end") <= F.col("end") + V.DAY)
    return clips.select("video_id", "row", "frames", r6("last_pts").alias("last_pts"), r6("t_end_s").alias("t_end_s"))


@query("t2_leakage_quarantine", V.cte(V.EV) + """SELECT narration_id, CASE WHEN verb = 4 THEN 'unknown_event' WHEN sta_cutoff < 0 THEN 'negative_cutoff' ELSE 'after_cutoff' END AS reason,
  (SELECT count(*) FROM ev WHERE NOT (verb = 4 OR sta_cutoff < 0 OR verb = 1)) AS passed FROM ev WHERE verb = 4 OR sta_cutoff < 0 OR verb = 1""")
def t2(spark, sf):
    folder = fresh_folder(spark, "guard")
    ev = V.action_events(spark, sf)
    features = ev.select("narration_id", F.when(F.col("verb") == 1, F.col("start")).otherwise(F.col("sta_cutoff")).alias("time"), "noun")
    stream = arriving(features, f"{folder}/in", 3, F.col("noun") % 3).drop("noun")
    q = ST.guard_stream(stream, ev.where("verb <> 4"), f"{folder}/good", f"{folder}/bad", f"{folder}/state",
                        availableNow=True)
    q.awaitTermination()
    passed = spark.read.parquet(f"{folder}/good").agg(F.count(F.lit(1)).alias("passed"))
    return V.with_scalar(spark.read.parquet(f"{folder}/bad"), passed).select("narration_id", "reason", "passed")


@query("t3_history_stream", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST) + f"""SELECT narration_id, k, valid, {sql6('used_time')} AS used_time, coalesce(row_id, -1) AS "row" FROM hist""")
def t3(spark, sf):
    """Clips and events arrive in three micro-batches each, in the order of their time."""
    folder = fresh_folder(spark, "history")
    events = flushed(spark, V.action_events(spark, sf).select("narration_id", "video_id", "sta_cutoff"), narration_id="~", video_id="~", sta_cutoff=FLUSH)
    clips = flushed(spark, V.bank(spark, sf), video_id="~", t_end_s=FLUSH, row=-1)
    third = lambda t: F.greatest(F.lit(0), F.least(F.lit(2), F.floor(F.col(t) / (2.5 * V.DAY))))
    h = ST.history_stream(arriving(events, f"{folder}/events", 3, third("sta_cutoff")), arriving(clips, f"{folder}/clips", 3, third("t_end_s")),
                          V.STEPS, V.STRIDE, lateness="1 day", shelves=SHELVES)
    out = drained(h, folder)
    return out.select("narration_id", F.col("k").cast("long").alias("k"), "valid", r6("used_time").alias("used_time"), "row")


@query("t4_ema_stream", """WITH s AS (SELECT conv_id, turn, role = 'user' AS ok, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn DESC) - 1 AS age FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS key, """ + sql6("coalesce(sum(CASE WHEN ok THEN 0.8 * pow(0.2, age) * n END), 0)") + """ AS ema FROM s GROUP BY conv_id""")
def t4(spark, sf):
    folder = fresh_folder(spark, "ema")
    steps = V.table(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("ok"),
                                                      F.array(F.length("text").cast("double")).alias("p"))
    out = drained(ST.ema_stream(as_stream(steps, f"{folder}/in"), "conv_id", "p", "ok", "turn"), folder)
    last = out.groupBy("key").agg(F.max_by("ema", "k").alias("ema"))
    return last.select("key", r6(F.col("ema")[0]).alias("ema"))


@query("t5_deduplicated_stream", "SELECT doc_id FROM documents")
def t5(spark, sf):
    folder = fresh_folder(spark, "dedupe")
    d = V.table(spark, sf, "documents").select("doc_id", F.timestamp_seconds(F.col("doc_id") + 86400).alias("ts"))
    return drained(ST.dedupe_stream(as_stream(d.unionByName(d), f"{folder}/in"), ["doc_id"], lateness="30 days"), folder).select("doc_id")


@query("t6_order_violations_stream", V.cte(V.EV) + """SELECT video_id, event_id AS position FROM (SELECT *, max(value) OVER (PARTITION BY video_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev) WHERE value < top""")
def t6(spark, sf):
    folder = fresh_folder(spark, "order")
    frames = V.action_events(spark, sf).select("video_id", F.col("event_id").alias("position"), F.col("value").alias("pts"))
    return drained(ST.order_violations_stream(as_stream(frames, f"{folder}/in"), SHELVES), folder).select("video_id", "position")


# Events arrive by id in eight micro-batches; late is what lies over a day before the latest start of the batches before.
LATE = """placed AS (SELECT *, event_id * 8 // (SELECT max(event_id) + 1 FROM ev) AS batch FROM ev),
highs AS (SELECT batch, max(max(start)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400.0 AS low FROM placed GROUP BY batch)"""


@query("t7_late_rows", V.cte(V.EV, LATE) + f"""SELECT narration_id, {sql6('low')} AS watermark, 'behind_watermark' AS reason,
  (SELECT count(*) FROM placed p2 JOIN highs h2 USING (batch) WHERE h2.low IS NULL OR p2.start >= h2.low) AS on_time FROM placed JOIN highs USING (batch) WHERE start < low""")
def t7(spark, sf):
    """The rows of the late sink, and how many went on."""
    folder = fresh_folder(spark, "late")
    ev = V.action_events(spark, sf).select("event_id", "narration_id", "start")
    n = ev.agg(F.max("event_id") + 1).first()[0]
    stream = arriving(ev, f"{folder}/in", 8, F.floor(F.col("event_id") * 8 / F.lit(n)))
    q = ST.late_rows_stream(stream, "start", V.DAY, f"{folder}/good", f"{folder}/late", f"{folder}/state", availableNow=True)
    q.awaitTermination()
    on_time = spark.read.parquet(f"{folder}/good").agg(F.count(F.lit(1)).alias("on_time"))
    return V.with_scalar(spark.read.parquet(f"{folder}/late"), on_time).select("narration_id", r6("watermark").alias("watermark"), "reason", "on_time")


@query("s1_annotation_scan", V.cte(V.EV) + f"""SELECT narration_id, participant_id, video_id, {sql6('start % 86400')} AS start, {sql6('(start % 86400) - 1')} AS sta_cutoff, verb, noun FROM ev""")
def s1(spark, sf):
    folder = fresh_folder(spark, "annotations")
    ev = V.action_events(spark, sf)
    raw = V.table(spark, sf, "events").select("event_id", F.date_format("ts", "HH:mm:ss.SSSSSS").alias("start_timestamp"),
                                              (F.expr("extract(SECOND FROM ts)") + 100_000).cast("string").alias("stop_timestamp"))
    table = ev.join(raw, "event_id").select(F.concat(F.lit("  "), F.col("narration_id")).alias("narration_id"), "participant_id", "video_id", "start_timestamp",
                                            "stop_timestamp", F.col("verb").alias("verb_class"), F.col("noun").alias("noun_class"))
    table.write.csv(folder, header=True)
    out = SRC.read_events(spark, folder)
    return out.select("narration_id", "participant_id", "video_id", r6("start").alias("start"), r6("sta_cutoff").alias("sta_cutoff"), "verb", "noun")


@query("s2_s3_manifest_round_trip", V.cte(V.EV, V.SPLIT) + f"""SELECT narration_id, subset AS split, task, {sql6("CASE WHEN task = 'AR' THEN start ELSE CASE WHEN sta_cutoff < 0 THEN 0 ELSE greatest(0.0, sta_cutoff - 18000.0) END END")} AS win_start,
  {sql6("CASE WHEN task = 'AR' THEN stop ELSE sta_cutoff END")} AS win_end FROM split, (VALUES ('AR'), ('STA')) t(task)""")
def s2(spark, sf):
    folder = fresh_folder(spark, "manifests")
    SRC.write_manifests(split(spark, sf), folder, 18000.0)
    m = SRC.read_manifest(spark, folder, V.GAP)
    return m.select("narration_id", "split", "task", r6("observation.start").alias("win_start"), r6("observation.end").alias("win_end"))


@query("s4_file_inventory", """SELECT stem FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'),
  ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(stem)""")
def s4(spark, sf):
    return SRC.file_index(spark, sf, ".PARQUET").select("stem")


@query("s5_bank_scan", V.cte(V.EV, GREEDY, recursive=True) + f"""SELECT k.video_id, {sql6('k.t')} AS t_end_s FROM kept k""")
def s5(spark, sf):
    folder = fresh_folder(spark, "bank")
    raw_bank(spark, sf).write.parquet(folder)
    return SRC.read_bank(spark, folder, eps=3600.0)[0].select("video_id", r6("t_end_s").alias("t_end_s"))


@query("s6_event_feature_scan", V.cte(V.EV) + """SELECT narration_id, verb <> 2 AND sta_cutoff >= 0 AS has_clip FROM ev""")
def s6(spark, sf):
    folder = fresh_folder(spark, "event-features")
    ev = V.action_events(spark, sf)
    ev.select("narration_id", F.col("event_id").alias("row"), "video_id", F.when(F.col("sta_cutoff") >= 0, F.col("sta_cutoff")).otherwise(-1.0).alias("sta_clip_end_s"),
              F.when(F.col("verb") == 2, "True").otherwise("0").alias("sta_use_prior")).write.csv(folder, header=True)
    return SRC.read_event_features(spark, folder, "csv").select("narration_id", "has_clip")


# Frames at the start of every other event and at the end of the rest, so that some actions hold no frame.
FRAMES = """fr AS (SELECT video_id, CASE WHEN event_id % 2 = 0 THEN start ELSE stop END AS pts FROM ev),
win AS (SELECT narration_id, video_id, start AS lo, stop AS hi, false AS closed FROM ev
  UNION ALL SELECT narration_id, video_id, greatest(0.0, sta_cutoff - 86400.0), sta_cutoff, true FROM ev WHERE sta_cutoff >= 0),
near AS (SELECT w.narration_id, w.closed, f.pts, row_number() OVER (PARTITION BY w.narration_id, w.closed
    ORDER BY abs(lo + (hi - lo) * (15.5 / 16) - f.pts), f.pts) AS r
  FROM win w JOIN fr f ON f.video_id = w.video_id AND f.pts >= w.lo AND (f.pts < w.hi OR (w.closed AND f.pts = w.hi)))"""


@query("s6_event_feature_index", V.cte(V.EV, FRAMES) + f"""SELECT e.narration_id, {sql6('coalesce(a.pts, -1.0)')} AS ar_clip_end_s, {sql6('coalesce(s.pts, -1.0)')} AS sta_clip_end_s,
  s.pts IS NULL AS use_prior, a.pts IS NULL AS empty_action FROM ev e
LEFT JOIN near a ON a.narration_id = e.narration_id AND NOT a.closed AND a.r = 1
LEFT JOIN near s ON s.narration_id = e.narration_id AND s.closed AND s.r = 1""")
def s6_index(spark, sf):
    """The index from frames, with the events that `check_action_clips` refuses."""
    ev = V.action_events(spark, sf)
    frames = ev.select("video_id", F.when(F.col("event_id") % 2 == 0, F.col("start")).otherwise(F.col("stop")).alias("pts"))
    index = T.event_clip_ends(ev, frames, V.DAY, width=4 * V.STRIDE)
    empty = F.col("ar_clip_end_s") < 0
    return index.select("narration_id", r6("ar_clip_end_s").alias("ar_clip_end_s"), r6("sta_clip_end_s").alias("sta_clip_end_s"), "use_prior", empty.alias("empty_action"))


@query("s7_consolidated_bank", V.cte(V.EV) + """SELECT video_id, event_id, row_number() OVER (ORDER BY video_id, start, event_id) - 1 AS "row", (SELECT count(*) FROM ev) AS total_rows FROM ev""")
def s7(spark, sf):
    folder = fresh_folder(spark, "consolidated")
    shards = V.action_events(spark, sf).select("video_id", F.col("start").alias("t_end_s"), "event_id")
    meta = SRC.consolidate(shards, folder, ("video_id", "t_end_s", "event_id"), {"bank_stride_s": V.STRIDE})
    rows = spark.read.parquet(f"{folder}/rows").select("video_id", "event_id", "row")
    return V.with_scalar(rows, meta.select("total_rows"))


def write_run_folders(spark, sf, folder):
    """Run folders with one configuration and one metrics document each."""
    li = V.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.round(F.avg("l_discount") * 100, 6).alias("a"), F.round(F.avg("l_tax") * 100, 6).alias("t"))
    run = F.concat(F.lit("decoupled_"), F.col("l_returnflag"), F.lit("_seed"), F.col("l_linenumber"))
    frozen = F.col("l_returnflag") == "A"
    args = F.struct(F.lit("decoupled").alias("mode"), F.lit(16).alias("steps"), F.col("l_linenumber").alias("seed"),
                    F.when(frozen, "three_way").otherwise("aga").alias("fusion"), F.lit("mean").alias("future_encoder"),
                    F.lit("probe").alias("present_encoder"), frozen.alias("freeze_present"), (F.col("l_returnflag") == "R").alias("no_anchor"))
    config = F.to_json(F.struct(args.alias("args")))
    val = F.create_map(F.lit("all"), F.create_map(F.lit("action_mt5r"), F.col("a").cast("string"), F.lit("primary_metric"), F.lit("action_mt5r")),
                       F.lit("tail_actions"), F.create_map(F.lit("action_mt5r"), F.col("t").cast("string")))
    official = F.when(frozen, F.create_map(F.lit("tail"), F.create_map(F.lit("action_mt5r"), (F.col("t") + 1).cast("string"))))
    done = F.col("l_linenumber") < 7
    metrics = F.to_json(F.struct(F.lit(3).alias("best_epoch"), F.when(done, val).alias("best_val"), official.alias("best_val_breakdown"),
                                 F.struct((F.col("l_linenumber") > 2).alias("probe_alone"), val.alias("val")).alias("init")))
    docs = li.select(run.alias("run"), config.alias("config.json"), metrics.alias("metrics.json"))
    for name in ("config.json", "metrics.json"):
        docs.select("run", F.col(f"`{name}`").alias("value")).write.partitionBy("run").text(f"{folder}/{name}")
    return folder


def run_records(spark, sf):
    """Runs read back from folders ``run=<name>``; the writer makes one part file per run and document."""
    root = write_run_folders(spark, sf, fresh_folder(spark, "runs"))
    from ..sources.files import parse_config, parse_metrics
    metrics = spark.read.text(f"{root}/metrics.json", wholetext=True)
    config = spark.read.text(f"{root}/config.json", wholetext=True)
    return parse_metrics(metrics).join(parse_config(config), "run")


RUNDOC = """rd AS (SELECT l_returnflag, l_linenumber AS seed, concat('decoupled_', l_returnflag, '_seed', l_linenumber) AS run, round(avg(l_discount) * 100, 6) AS a, round(avg(l_tax) * 100, 6) AS t FROM lineitem GROUP BY 1, 2)"""


@query("s8_r1_run_table", V.cte(RUNDOC) + f"""SELECT run, seed, CASE l_returnflag WHEN 'A' THEN 'three_way H+P+F (future: mean)' ELSE 'aga' END AS fusion, CASE l_returnflag WHEN 'A' THEN 'probe (frozen)' ELSE 'probe (trainable)' END AS present,
  l_returnflag <> 'R' AS anchor, {sql6('a')} AS action_mt5r, {sql6("CASE l_returnflag WHEN 'A' THEN t + 1 ELSE t END")} AS tail_best FROM rd WHERE seed < 7""")
def s8(spark, sf):
    t = R.run_table(run_records(spark, sf))
    return t.select("run", "seed", "fusion", "present", "anchor", r6("action_mt5r").alias("action_mt5r"), r6("tail_best").alias("tail_best"))


@query("r2_init_rows", V.cte(RUNDOC) + f"""SELECT concat(run, '@init') AS run, anchor, {sql6('a')} AS action_mt5r FROM (SELECT *, l_returnflag <> 'R' AS anchor, row_number() OVER (PARTITION BY l_returnflag <> 'R' ORDER BY run) AS r
  FROM rd WHERE seed BETWEEN 3 AND 6) WHERE r = 1""")
def r2(spark, sf):
    return R.init_rows(run_records(spark, sf)).select("run", "anchor", r6("action_mt5r").alias("action_mt5r"))


# Gates per validation event: runs of two configurations have three-way gates, those of the third two-way ones.
GATES = """g AS (SELECT concat('decoupled_', l_returnflag, '_seed', l_linenumber) AS run, l_returnflag AS configuration, l_suppkey % 7 = 0 AS use_prior,
  l_partkey % 3 = 0 AS ahead, CAST(l_discount AS DOUBLE) + 0.013 AS h, CAST(l_tax AS DOUBLE) + 0.017 AS p, CAST(l_quantity AS DOUBLE) / 100 + 0.011 AS f FROM lineitem),
w AS (SELECT run, configuration, field, mask, CASE WHEN configuration = 'R' THEN (CASE field WHEN 'verb' THEN h ELSE p END)
    ELSE (CASE field WHEN 'verb' THEN h ELSE f END) / (h + p + f) END AS history,
  CASE WHEN configuration <> 'R' THEN p / (h + p + f) END AS present, CASE WHEN configuration <> 'R' THEN (CASE field WHEN 'verb' THEN f ELSE h END) / (h + p + f) END AS future
  FROM g, (VALUES ('verb'), ('noun')) a(field), (VALUES ('model'), ('with_future')) b(mask)
  WHERE NOT use_prior AND (mask = 'model' OR (ahead AND configuration <> 'R'))),
per_run AS (SELECT run, configuration, field, mask, count(*) AS events, avg(history) AS history, avg(present) AS present, avg(future) AS future FROM w GROUP BY ALL)"""


def run_outputs(spark, sf):
    """Outputs of all runs, written by run and read back."""
    folder = fresh_folder(spark, "outputs")
    h, p, f = (F.col("l_discount").cast("double") + 0.013, F.col("l_tax").cast("double") + 0.017, F.col("l_quantity").cast("double") / 100 + 0.011)
    three, whole = F.col("l_returnflag") != "R", h + p + f
    SRC.write_outputs(V.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("narration_id"), (F.col("l_suppkey") % 7 == 0).alias("use_prior"),
        (F.col("l_partkey") % 3 == 0).alias("future_available"), F.when(three, F.array(h / whole, p / whole, f / whole)).alias("verb_gates"),
        F.when(three, F.array(f / whole, p / whole, h / whole)).alias("noun_gates"), F.when(~three, h).alias("gate_verb"), F.when(~three, p).alias("gate_noun"),
        F.concat(F.lit("decoupled_"), "l_returnflag", F.lit("_seed"), "l_linenumber").alias("run")), folder)
    return SRC.read_outputs(spark, folder)


@query("r4_run_gates", V.cte(GATES) + f"""SELECT run, field, mask, events, {sql6('history')} AS history, {sql6('coalesce(present, -1)')} AS present, {sql6('coalesce(future, -1)')} AS future FROM per_run""")
def r4_run_gates(spark, sf):
    w = R.gate_weights(run_outputs(spark, sf), rounded=False)
    return w.select("run", "field", "mask", "events", r6("history").alias("history"), *(r6(F.coalesce(b, F.lit(-1.0))).alias(b) for b in ("present", "future")))


@query("r4_ablation_gates", V.cte(V.RUNS, GATES, "means AS (SELECT configuration, field, mask, avg(history) AS history, avg(present) AS present, avg(future) AS future FROM per_run GROUP BY ALL)") + f"""
SELECT r.configuration, {sql6('avg(score)')} AS score_mean, """ + ", ".join(
    f"(SELECT {sql6(f'coalesce(max({b}), -1)')} FROM means m WHERE m.configuration = r.configuration AND field = '{field}' AND mask = '{mask}') AS {field}_{b}_gate{end}"
    for field in R.FIELDS for mask, end in (("model", ""), ("with_future", "_with_future")) for b in R.BRANCHES) + " FROM runs r GROUP BY r.configuration")
def r4_ablation_gates(spark, sf):
    outputs = run_outputs(spark, sf)
    runs = V.runs(spark, sf).withColumn("run", F.concat(F.lit("decoupled_"), "configuration", F.lit("_seed"), "seed"))
    gates = R.gate_summary(R.gate_weights(outputs, rounded=False), runs, rounded=False)
    a = R.ablation(runs, "A", ["score"], gates=gates)
    shown = [c for c in a.columns if "_gate" in c]
    return a.select("configuration", r6("score_mean").alias("score_mean"), *(r6(F.coalesce(c, F.lit(-1.0))).alias(c) for c in shown))


@query("s10_summary_documents", V.cte(V.EV, V.SPLIT) + """SELECT subset, count(*) AS events, count(DISTINCT video_id) AS videos, count(*) FILTER (WHERE sta_cutoff < 0) AS no_history FROM split GROUP BY subset""")
def s10(spark, sf):
    folder = fresh_folder(spark, "summary")
    s = split(spark, sf)
    SRC.write_summary(folder, splits=S.split_summary(s), tail=S.tail_classes(counts(s.where("subset = 'train'"))))
    return SRC.read_summary(spark, folder, "splits", "subset string, events bigint, videos bigint, no_history bigint")


@query("s11_fingerprints", """SELECT count(*) AS rows, CAST(coalesce(sum(CAST(concat('0x', substr(sha256(concat_ws('|', event_id, epoch_us(ts), user_id, event_type,
  CAST(round(value * 1e6) AS BIGINT), props)), 1, 15)) AS BIGINT)::HUGEINT), 0) AS VARCHAR) AS digest FROM events""")
def s11(spark, sf):
    e = V.table(spark, sf, "events")
    record = F.concat_ws("|", "event_id", F.unix_micros(F.col("ts").cast("timestamp")), "user_id", "event_type", F.round(F.col("value") * 1e6).cast("long"), "props")
    return SRC.fingerprint(e.select(record.alias("value")))
