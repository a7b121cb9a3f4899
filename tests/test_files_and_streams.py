import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import events_frame
from tidemark import plans, sources as SRC, streaming as ST
from tidemark.operators import checks as C, report as R, sampling as SA, splits as SP, temporal as T
from tidemark.operators.checks import IntegrityError

HEAD = "narration_id,participant_id,video_id,start_timestamp,stop_timestamp,verb_class,noun_class"


def csv(folder, lines, name="train.csv", head=HEAD, bom=True):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write("\n".join([head, *lines]) + "\n")
    return path


def test_read_events(spark, folder):
    path = csv(folder, [" a ,P01,P01_01,00:00:20,00:00:21,0,5,19,x", "b,P01,P01_01,0.4,0.8,96,299,,y"],
               head=HEAD + ",sta_observation_end_seconds,extra")
    rows = {r["narration_id"]: r for r in SRC.read_events(spark, path).collect()}
    assert rows["a"]["sta_cutoff"] == 19.0 and rows["b"]["sta_cutoff"] == -0.6 and rows["b"]["noun"] == 299


@pytest.mark.parametrize("lines, message", [
    (["a,P,V_1,00:00:20,00:00:21,0,0", "a,P,V_1,00:00:20,00:00:21,0,0"], "duplicate_id"),
    (["a,P,V_1,00:00:21,00:00:20,0,0"], "bad_interval"), (["a,P,V_1,00:00:61,00:02:00,0,0"], "bad_time"),
    (["a,P,V_1,1,2,97,0"], "bad_verb"), (["a,P,V_1,1,2,0,x"], "bad_noun"), (["a,,V_1,1,2,0,0"], "empty_participant"), ([" ,P,V_1,1,2,0,0"], "empty_id")])
def test_read_events_rejects(spark, folder, lines, message):
    with pytest.raises(IntegrityError, match=message):
        SRC.read_events(spark, csv(folder, lines))


def test_read_events_headers_and_supplied_cutoff(spark, folder):
    with pytest.raises(ValueError, match="verb_class"):
        SRC.read_events(spark, csv(folder, ["a,P,V_1,1,2"], head=HEAD.rsplit(",", 2)[0]))
    hidden = SRC.read_events(spark, csv(folder, ["a,P,V_1,1,2"], "hidden.csv", HEAD.rsplit(",", 2)[0]), labeled=False)
    assert hidden.first()["verb"] is None
    with pytest.raises(IntegrityError, match="supplied_cutoff"):
        SRC.read_events(spark, csv(folder, ["a,P,V_1,20,21,0,0,20"], "cut.csv", HEAD + ",sta_observation_end_seconds"))


def touch(path):
    with open(path, "w") as f:
        f.write("x")  # Spark lists no empty files


def grid(folder, participants=6):
    lines = [f"P{p:02d}_{v:02d}_{i},P{p:02d},P{p:02d}_{v:02d},{2 * i + .4},{2 * i + 1.2},{(i + p) % 4},{(i * v) % 6}"
             for p in range(1, participants + 1) for v in range(1, 5) for i in range(8)]
    return csv(folder, lines)


def test_prepare_and_read_back(spark, folder):
    os.makedirs(f"{folder}/videos/deep")
    for p in range(1, 7):
        for v in range(1, 5):
            touch(f"{folder}/videos/deep/P{p:02d}_{v:02d}.{'MP4' if v % 2 else 'mp4'}")
    train = grid(folder)
    test = csv(folder, ["t1,P09,P01_01,3,4"], "test.csv", HEAD.rsplit(",", 2)[0])
    split = plans.prepare_grouped(spark, train, f"{folder}/out", f"{folder}/videos", test)
    m = SRC.read_manifest(spark, f"{folder}/out/manifests")
    assert m.count() == 2 * split.count() and m.where("split = 'test'").count() == 2
    sizes = {r["subset"]: r["events"] for r in SRC.read_summary(spark, f"{folder}/out/summary", "splits", "subset string, events bigint").collect()}
    assert sizes["train"] + sizes["val"] == 192 and sizes["test"] == 1
    told = {r["name"]: json.loads(r["value"]) for r in SRC.read_summary(spark, f"{folder}/out/summary", "parameters", "name string, value string").collect()}
    assert told["seed"] == 42 and told["hidden_test_provided"] is True and told["split_unit"] == "video_id"
    members = SRC.read_summary(spark, f"{folder}/out/summary", "members", "kind string, id string, subset string, events bigint, fraction double")
    assert {r["id"] for r in members.where("kind = 'video' AND subset = 'val'").collect()} == {r[0] for r in split.where("subset = 'val'").select("video_id").distinct().collect()}
    assert members.where("kind = 'action' AND subset = 'test'").isEmpty()  # no labels
    assert abs(members.where("kind = 'participant' AND subset = 'train'").agg({"fraction": "sum"}).first()[0] - 1) < 1e-9
    assert SRC.read_summary(spark, f"{folder}/out/summary", "missing_videos", "video_id string").isEmpty()
    with pytest.raises(Exception, match="already exists"):
        plans.prepare_grouped(spark, train, f"{folder}/out", None, test)
    touch(f"{folder}/videos/P01_01.mp4")
    with pytest.raises(IntegrityError, match="duplicate_video_file"):
        plans.prepare_grouped(spark, train, f"{folder}/out2", f"{folder}/videos")
    with pytest.raises(IntegrityError, match="train_test_overlap"):
        plans.prepare_grouped(spark, train, f"{folder}/out3", None, csv(folder, ["P01_01_0,P09,P01_01,3,4"], "t2.csv", HEAD.rsplit(",", 2)[0]))


def test_prepare_hybrid_and_tampering(spark, folder):
    train = grid(folder)
    split = plans.prepare_hybrid(spark, train, f"{folder}/out", unseen=["P02"], seen_fraction=.2, seen_max_fraction=.5)
    assert {r["subset"] for r in split.select("subset").distinct().collect()} == {"train", "val_seen", "val_unseen"}
    part = glob.glob(f"{folder}/out/manifests/split=val/task=STA/*.json")[0]
    rows = [json.loads(x) for x in open(part)]
    i = next(i for i, r in enumerate(rows) if r["sta_cutoff"] > 1)
    rows[i]["observation"]["end"] += 0.5
    open(part, "w").write("\n".join(map(json.dumps, rows)) + "\n")
    crc = os.path.join(os.path.dirname(part), "." + os.path.basename(part) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(IntegrityError, match="sta_window_end"):
        SRC.read_manifest(spark, f"{folder}/out/manifests")


def test_anticipation_scores_use_the_prior_without_history(spark, folder):
    ev = SRC.read_events(spark, grid(folder))
    split = SP.hybrid_split(ev, unseen=["P02"], seen_fraction=.2, seen_max_fraction=.5)
    bank = ev.select("video_id", F.col("start").alias("t_end_s"), F.monotonically_increasing_id().alias("row"))
    h = plans.validation_history(split, bank, 4, 2.0)
    scored = ev.select("narration_id", F.array_repeat(F.lit(.1), 97).alias("verb_output"), F.array_repeat(F.lit(.1), 300).alias("noun_output"))
    r = plans.anticipation_scores(split, h, scored)
    assert r.where("subset = 'overall' AND field = 'verb'").first()["events"] == split.where("subset <> 'train'").count()


def test_bank_build_and_consolidate(spark, folder):
    frames = spark.createDataFrame([(v, i / 10) for v in ("a", "b") for i in range(60)], "video_id string, pts double")
    ev = events_frame(spark, [("x", "p", "a", 2.0, 9.0, 0, 0)])
    meta = plans.build_bank(frames, ev, f"{folder}/bank").first()
    rows = spark.read.parquet(f"{folder}/bank/rows")
    assert meta["total_rows"] == rows.count() == 10 + 6 and meta["num_videos"] == 2
    assert [r["row"] for r in rows.orderBy("video_id", "window_end").collect()] == list(range(16))
    kept, dropped = SRC.read_bank(spark, f"{folder}/bank/rows")
    # near the end of the frames several windows keep the same last frame
    assert kept.count() + sum(dropped.first()) == 16 and dropped.first()["undecodable"] > 0
    C.enforce(T.check_increasing(kept))


def test_event_feature_index_needs_the_sta_column(spark):
    with pytest.raises(ValueError, match="sta_clip_end_s"):
        SRC.event_feature_index(spark.createDataFrame([("a", 1.0)], "narration_id string, clip_end_s double"))


def test_write_predictions(spark, folder):
    ids = spark.createDataFrame([(f"n{i}", i) for i in range(4)], "narration_id string, position long")
    pred = ids.select("narration_id", F.array_repeat(F.lit(.5), 3).alias("verb_output"), F.array_repeat(F.lit(.5), 2).alias("noun_output"))
    SRC.write_predictions(pred, ids, f"{folder}/p", 3, 2)
    assert spark.read.parquet(f"{folder}/p").count() == 4
    with pytest.raises(IntegrityError, match="missing_prediction"):
        SRC.write_predictions(pred.where("narration_id <> 'n2'"), ids, f"{folder}/q", 3, 2)
    with pytest.raises(Exception, match="already exists"):
        SRC.write_predictions(pred, ids, f"{folder}/p", 3, 2)


def test_run_folders_and_reports(spark, folder):
    def run(name, seed, score, done=True, fusion="three_way", branches="history,present", anchor=True):
        os.makedirs(f"{folder}/{name}")
        args = {"mode": "decoupled", "steps": 16, "seed": seed, "fusion": fusion, "branches": branches, "present_encoder": "probe", "freeze_present": True, "no_anchor": not anchor}
        json.dump({"args": args}, open(f"{folder}/{name}/config.json", "w"), indent=1)
        m = {"best_epoch": 2, "history": [{"epoch": 0, "seconds": 3.5}], "init": {"probe_alone": True, "val": {"all": {"action_mt5r": 1.5}}}}
        if done:
            m["best_val"] = {"all": {"events": 10, "action_mt5r": score, "primary_metric": "action_mt5r"}, "tail_actions": {"action_mt5r": 2.0}}
            m["best_val_breakdown"] = {"tail": {"action_mt5r": 3.0}}
        json.dump(m, open(f"{folder}/{name}/metrics.json", "w"), indent=1)
    run("d_S16_seed1_hp", 1, 8.0)
    run("d_S16_seed2_hp", 2, 9.0)
    run("d_S16_seed1_p", 1, 7.5, branches="present")
    run("d_S16_seed3_p", 3, 7.0, branches="present", anchor=False)
    run("d_S16_seed9_hp", 9, 0.0, done=False)
    t = R.run_table(SRC.read_runs(spark, folder))
    rows = {r["run"]: r for r in t.collect()}
    assert len(rows) == 4 and rows["d_S16_seed1_hp"]["fusion"] == "three_way H+P" and rows["d_S16_seed1_hp"]["present"] == "probe (frozen)"
    assert rows["d_S16_seed1_hp"]["tail_best"] == 3.0 and rows["d_S16_seed1_hp"]["unseen_best"] is None
    s = {r["configuration"]: r for r in R.seed_summary(t, ["action_mt5r"]).collect()}
    assert s["d_S16_hp"]["seeds"] == [1, 2] and s["d_S16_hp"]["action_mt5r_text"] == "8.50 ± 0.71"
    a = {r["fusion"]: r for r in R.ablation(t, "three_way H+P", ["action_mt5r"], "fusion").collect()}
    assert a["three_way P"]["delta_mean"] == -0.5 and a["three_way P"]["delta_n"] == 1 and a["three_way H+P"]["delta_mean"] is None
    fused = t.withColumn("fusion", F.when(F.col("run").startswith("d_S16_seed1_hp"), "aga").otherwise("three_way")).withColumn("memory", F.lit("scratch"))
    assert [(r["mean"], r["n"]) for r in R.horizon(fused).collect()] == [(8.0, 1)]
    init = {r["anchor"]: r for r in R.init_rows(SRC.read_runs(spark, folder)).collect()}
    assert init[True]["run"] == "d_S16_seed1_hp@init" and init[True]["action_mt5r"] == 1.5 and init[False]["run"] == "d_S16_seed3_p@init"
    assert R.filter_runs(t, mode="decoupled", steps=16, name_contains="_p").count() == 2


def stream(spark, df, folder, parts):
    """A stream of ``parts`` files that arrive one by one."""
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
        for f in glob.glob(f"{folder}/part-*.parquet"):
            if not hasattr(stream, "seen"):
                stream.seen = set()
            if f not in stream.seen:
                stream.seen.add(f)
                os.utime(f, (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, folder):
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_clip_stream_equals_batch_and_reports_late_rows(spark, folder):
    frames = spark.createDataFrame([("a", i / 4) for i in range(80)] + [("b", 3.0), ("~", 500.0)], "video_id string, pts double")
    src = stream(spark, frames, f"{folder}/in", ["pts < 8", "pts >= 8 AND pts < 400 AND pts <> 9", "pts > 400", "pts = 9"])
    counter = ST.LateCounter()
    spark.streams.addListener(counter)
    q, out = drain(ST.clip_bank_stream(src, 2.0, 1.0, "5 seconds"), folder)
    kept = frames.where("pts <> 9 AND video_id <> '~'")
    batch = T.clip_bank(kept, 2.0, 1.0).where("frames > 0").select("video_id", "row", "frames", "last_pts", "t_end_s")
    # the batch bank ends one stride after the last frame; a stream cannot know which frame is the last
    ends = kept.groupBy("video_id").agg((F.max("pts") + 1.0).alias("end"))
    closed = out.join(ends, "video_id").where("window_end <= end")
    assert sorted(map(tuple, closed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    counts = counter.counts(q)
    spark.streams.removeListener(counter)
    assert counts["rows"] == frames.count() and counts["late_rows"] > 0 and counts["batches"] >= 4


def test_history_stream_equals_batch(spark, folder):
    bank = spark.createDataFrame([("a", i / 2, i) for i in range(60)] + [("b", 4.0, 99), ("~", 900.0, -1)], "video_id string, t_end_s double, row long")
    ev = spark.createDataFrame([(f"e{i}", "a" if i % 3 else "b", i * 1.7 - 2) for i in range(16)], "narration_id string, video_id string, sta_cutoff double")
    sb = stream(spark, bank, f"{folder}/bank", ["t_end_s < 15", "t_end_s >= 15 AND t_end_s < 400", "t_end_s > 400"])
    flush = spark.createDataFrame([("~", "~", 900.0)], ev.schema)  # the slower of two watermarks counts
    se = stream(spark, ev.union(flush), f"{folder}/ev", ["sta_cutoff < 12", "sta_cutoff >= 12 AND sta_cutoff < 400", "sta_cutoff > 400"])
    _, out = drain(ST.history_stream(se, sb, 4, 1.0, lateness="20 seconds"), folder)
    batch = T.history(ev, bank, 4, 1.0).select("narration_id", "k", "valid", "used_time", F.coalesce("row", F.lit(-1)).alias("row"))
    assert sorted(map(str, out.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_history_stream_forgets_clips_and_is_not_hurried(spark, folder):
    """Clips that run far ahead make no event late, and a video without events keeps only the clips within reach of the watermark."""
    bank = spark.createDataFrame([("a", float(i), i) for i in range(0, 400)] + [("quiet", float(i), i) for i in range(400)], "video_id string, t_end_s double, row long")
    ev = spark.createDataFrame([(f"e{i}", "a", i * 10.0) for i in range(40)] + [("~", "~", 900.0)], "narration_id string, video_id string, sta_cutoff double")
    sb = stream(spark, bank, f"{folder}/bank", ["t_end_s < 300", "t_end_s >= 300"])  # 300 seconds of clips before the first event is answered
    se = stream(spark, ev, f"{folder}/ev", [f"sta_cutoff >= {i * 100} AND sta_cutoff < {i * 100 + 100}" for i in range(4)] + ["sta_cutoff > 500"])
    _, out = drain(ST.history_stream(se, sb, 4, 1.0, lateness="5 seconds"), folder)
    got = {(r["narration_id"], r["k"]): r for r in out.collect()}
    batch = T.history(ev.where("sta_cutoff < 390"), bank, 4, 1.0).collect()
    assert all(got[r["narration_id"], r["k"]]["used_time"] == r["used_time"] for r in batch) and len(batch) == 39 * 4
    state = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "clips").load()
    left = state.selectExpr("key.video_id AS video", "user_map_key.slice AS slice").collect()
    quiet = sorted(r["slice"] for r in left if r["video"] == "quiet")
    assert quiet == list(range(quiet[0], 320)) and quiet[0] >= 305  # the last of 320


def test_late_rows_are_stored(spark, folder):
    rows = [(1, 10.0), (2, 50.0), (3, 45.0), (4, 39.0), (5, 41.0), (6, None), (7, float("nan")), (8, 100.0), (9, 60.0), (10, 95.0)]
    df = spark.createDataFrame(rows, "id long, t double")
    src = stream(spark, df, f"{folder}/in", ["id <= 2", "id BETWEEN 3 AND 7", "id = 8", "id >= 9"])
    run = lambda: ST.late_rows_stream(src, "t", 10.0, f"{folder}/good", f"{folder}/late", f"{folder}/state", availableNow=True).awaitTermination()
    run()
    late = {r["id"]: (r["reason"], r["watermark"]) for r in spark.read.parquet(f"{folder}/late").collect()}
    assert late == {4: ("behind_watermark", 40.0), 6: ("bad_time", 40.0), 7: ("bad_time", 40.0), 9: ("behind_watermark", 90.0)}
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/good").collect()) == [1, 2, 3, 5, 8, 10]
    spark.createDataFrame([(11, 89.0), (12, 91.0)], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()  # a restarted query goes on with its limit
    assert {r["id"] for r in spark.read.parquet(f"{folder}/late").collect()} == {4, 6, 7, 9, 11}


def test_ema_stream_equals_batch(spark, folder):
    st = spark.createDataFrame([("e", k, k != 2, [float(k), 1.0]) for k in range(1, 6)] + [("f", 1, False, [5.0, 5.0])], "narration_id string, k int, valid boolean, p array<double>")
    _, out = drain(ST.ema_stream(stream(spark, st, f"{folder}/in", ["k < 3", "k >= 3"]), "narration_id", "p", "valid"), folder)
    last = {r["key"]: r["ema"] for r in out.groupBy("key").agg(F.max_by("ema", "k").alias("ema")).collect()}
    batch = {r["narration_id"]: r["ema"] for r in SA.ema(st, "p", "valid").collect()}
    assert last["e"] == pytest.approx(batch["e"]) and last["f"] == batch["f"] == [0.0, 0.0]


def test_guard_quarantines(spark, folder):
    ev = events_frame(spark, [("a", "p", "v", 5.0, 6.0, 0, 0), ("c", "p", "v", 0.5, 1.0, 0, 0)])
    f = spark.createDataFrame([("a", 4.0), ("a", 4.5), ("c", 0.0), ("z", 1.0), ("a", float("nan"))], "narration_id string, time double")
    q = ST.guard_stream(stream(spark, f, f"{folder}/in", ["true"]), ev, f"{folder}/good", f"{folder}/bad", f"{folder}/c", availableNow=True)
    q.awaitTermination()
    assert spark.read.parquet(f"{folder}/good").count() == 1
    assert sorted(r["reason"] for r in spark.read.parquet(f"{folder}/bad").collect()) == ["after_cutoff", "bad_time", "negative_cutoff", "unknown_event"]


def test_order_and_duplicates_in_streams(spark, folder):
    f = spark.createDataFrame([("v", i, t) for i, t in enumerate([1.0, 2.0, 2.0, 1.5, 3.0, 2.9])], "video_id string, position long, pts double")
    _, out = drain(ST.order_violations_stream(stream(spark, f, f"{folder}/in", ["position < 3", "position >= 3"])), f"{folder}/o")
    assert sorted(r["position"] for r in out.collect()) == [3, 5]
    d = spark.createDataFrame([("a", 100.0), ("a", 101.0), ("b", 100.0)], "id string, s double").withColumn("ts", F.timestamp_seconds("s"))
    _, once = drain(ST.dedupe_stream(stream(spark, d, f"{folder}/d", ["s < 101", "s >= 101"]), ["id"]), f"{folder}/p")
    assert sorted(r["id"] for r in once.collect()) == ["a", "b"]


def test_gate_weights_of_run_outputs(spark, folder):
    three = "narration_id string, run string, use_prior boolean, future_available boolean, verb_gates array<double>, noun_gates array<double>"
    rows = [("a", "007", False, True, [.5, .3, .2], [.2, .2, .6]), ("b", "007", False, False, [.1, .8, .1], [.4, .2, .4]),
            ("c", "007", True, True, [1., 0., 0.], [1., 0., 0.]), ("d", "007", None, None, [.3, .3, .4], None), ("a", "all_prior", True, True, [.5, .3, .2], [.2, .2, .6])]
    SRC.write_outputs(spark.createDataFrame(rows, three), f"{folder}/outputs")
    two = spark.createDataFrame([("a", "x_seed1", .25, .75), ("b", "x_seed1", .5, .5)], "narration_id string, run string, gate_verb double, gate_noun double")
    SRC.write_outputs(two, f"{folder}/outputs")
    SRC.write_outputs(two.limit(0), f"{folder}/outputs")
    weights = R.gate_weights(SRC.read_outputs(spark, f"{folder}/outputs"))
    got = {(r["run"], r["field"], r["mask"]): (r["events"], r["history"], r["present"], r["future"]) for r in weights.collect()}
    assert got == {("007", "verb", "model"): (3, .3, .467, .233), ("007", "verb", "with_future"): (1, .5, .3, .2), ("007", "noun", "model"): (2, .3, .2, .5),
                   ("007", "noun", "with_future"): (1, .2, .2, .6), ("x_seed1", "verb", "model"): (2, .375, None, None), ("x_seed1", "noun", "model"): (2, .625, None, None)}
    runs = spark.createDataFrame([("007", "x", 1, 2.0), ("x_seed1", "x", 2, 4.0), ("lost", "y", 1, 1.0)], "run string, configuration string, seed int, score double")
    table = {r["configuration"]: r for r in R.ablation(runs, "y", gates=R.gate_summary(weights, runs)).collect()}
    assert (table["x"]["verb_history_gate"], table["x"]["verb_present_gate"], table["x"]["noun_future_gate_with_future"]) == (round((.3 + .375) / 2 + 1e-9, 3), .467, .6)
    assert table["y"]["verb_history_gate"] is None and table["x"]["delta_mean"] == 1.0


def test_file_index_counts_a_table_in_parts_once(spark, folder):
    spark.range(3).coalesce(1).write.parquet(f"{folder}/in.parquet/one.parquet")
    spark.range(40).repartition(3).write.parquet(f"{folder}/in.parquet/many.Parquet")
    spark.range(3).coalesce(1).write.parquet(f"{folder}/in.parquet/more/one.parquet")
    index = SRC.file_index(spark, f"{folder}/in.parquet", ".PARQUET")
    rows = sorted((r["stem"], os.path.relpath(r["path"].removeprefix("file:"), folder)) for r in index.collect())
    assert rows == [("many", "in.parquet/many.Parquet"), ("one", "in.parquet/more/one.parquet"), ("one", "in.parquet/one.parquet")]
    sizes = sum(os.path.getsize(f) for f in glob.glob(f"{folder}/in.parquet/many.Parquet/part-*"))
    assert index.where("stem = 'many'").first()["length"] == sizes
    assert [r["id"] for r in C.check_unique(index, "stem").collect()] == ["one"]


def test_streams_share_state_on_shelves(spark, folder):
    """Sixty videos on two shelves: the answers of the batch, and entries and rows of state for the shelves only."""
    bank = spark.createDataFrame([(f"v{i % 60}", (i // 60) * 1.0, i) for i in range(600)] + [("~", 900.0, -1)], "video_id string, t_end_s double, row long")
    ev = spark.createDataFrame([(f"e{i}", f"v{i % 60}", (i // 60) * 2.3 - 2) for i in range(300)], "narration_id string, video_id string, sta_cutoff double")
    flush = spark.createDataFrame([("~", "~", 900.0)], ev.schema)
    sb = stream(spark, bank, f"{folder}/bank", ["t_end_s < 5", "t_end_s >= 5 AND t_end_s < 400", "t_end_s > 400"])
    se = stream(spark, ev.union(flush), f"{folder}/ev", ["sta_cutoff < 3", "sta_cutoff >= 3 AND sta_cutoff < 400", "sta_cutoff > 400"])
    q, out = drain(ST.history_stream(se, sb, 4, 1.0, lateness="20 seconds", shelves=2), folder)
    batch = T.history(ev, bank, 4, 1.0).select("narration_id", "k", "valid", "used_time", F.coalesce("row", F.lit(-1)).alias("row"))
    assert sorted(map(str, out.select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    written = [s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"]]
    assert 0 < sum(written) < 200  # an entry for each video and slice would be over 600
    f = spark.createDataFrame([(f"v{i % 7}", i, float(i * 37 % 23)) for i in range(200)] + [(None, 300, 2.0), (None, 301, 1.0), ("v0", 302, float("nan"))],
                              "video_id string, position long, pts double")
    q, one = drain(ST.order_violations_stream(stream(spark, f, f"{folder}/in", ["position < 90", "position >= 90"]), shelves=2), f"{folder}/o")
    high, want = {}, []
    for v, position, t in f.sort("position").toPandas().itertuples(index=False):
        if t < high.get(v, -1.0):
            want.append((v, position, t, high[v]))
        high[v] = max(high.get(v, -1.0), t) if t == t else high[v]
    assert sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, want))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
