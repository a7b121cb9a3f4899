import bisect
import random

import pytest
from pyspark.sql import functions as F

from conftest import events_frame
from tidemark.operators import asof as A, checks as C, sampling as SA, temporal as T


def bank_frame(spark, times, video="v"):
    return spark.createDataFrame([(video, float(t), i) for i, t in enumerate(times)], "video_id string, t_end_s double, row long")


def event_at(spark, cutoff, video="v"):
    return spark.createDataFrame([("e", video, float(cutoff))], "narration_id string, video_id string, sta_cutoff double")


def steps(df):
    return df.orderBy("k").collect()


def test_last_step_snaps_down(spark):
    bank = bank_frame(spark, [round(i / 10, 1) for i in range(1, 601)])
    rows = steps(T.history(event_at(spark, 19.73), bank))
    assert rows[-1]["used_time"] == 19.7 and all(r["used_time"] <= r["tau"] + 1e-6 for r in rows if r["valid"])


def test_gap_is_masked_and_untimed_form_is_not(spark):
    bank = bank_frame(spark, [1, 2, 10])
    rows = steps(T.history(event_at(spark, 10), bank, steps=10))
    assert [r["valid"] for r in rows] == [True, True, True] + [False] * 6 + [True]
    loose = steps(T.history(event_at(spark, 10), bank, steps=10, tolerance=None, allow_negative_tau=True))
    assert [r["row"] for r in loose] == [0, 1, 1, 1, 1, 1, 1, 1, 1, 2]


def test_negative_cutoff_has_no_history(spark):
    rows = steps(T.history(event_at(spark, -0.5), bank_frame(spark, [0.0, 1.0])))
    assert not any(r["valid"] for r in rows)


def test_event_without_cutoff_keeps_its_rows(spark):
    ev = spark.createDataFrame([("e", "v", None)], "narration_id string, video_id string, sta_cutoff double")
    rows = T.history(ev, bank_frame(spark, [1.0]), 4).collect()
    assert len(rows) == 4 and not any(r["valid"] for r in rows)


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_history_equals_binary_search_on_a_hot_timeline(spark, hot_rows):
    rng = random.Random(5)
    times = {"hot": sorted({round(rng.uniform(0, 50), 3) for _ in range(200)}), "b": [1.0, 5.0, 5.5], "c": []}
    bank = spark.createDataFrame([(v, t, i) for v, ts in times.items() for i, t in enumerate(ts)] + [("hot", times["hot"][3], 0)],
                                 "video_id string, t_end_s double, row long")
    events = [(f"e{i}", "hot" if i % 3 else rng.choice("bc"), round(rng.uniform(-3, 55), 3)) for i in range(120)]
    events += [(f"same{i}", "hot", 20.0) for i in range(60)]  # a third of the events share one cutoff
    df = spark.createDataFrame(events, "narration_id string, video_id string, sta_cutoff double")
    got = {(r["narration_id"], r["k"]): r for r in T.history(df, bank, 6, 1.0, hot_rows=hot_rows).collect()}
    assert len(got) == len(events) * 6
    for name, video, c in events:
        for k in range(1, 7):
            tau = c - (6 - k)
            i = bisect.bisect_right(times[video], tau + 1e-6) - 1
            ok = c >= 0 and tau >= 0 and i >= 0 and tau - times[video][i] <= 1 + 1e-6
            r = got[name, k]
            assert r["valid"] == ok and r["used_time"] == (times[video][i] if ok else None) and (r["row"] == i if ok else r["row"] is None)


def test_hot_groups_are_split_and_bounded(spark):
    from tidemark.operators.skew import hot_groups, spread_hot
    df = spark.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    hot = hot_groups(df, ["g"], rows=100)
    assert [tuple(r) for r in hot.collect()] == [("hot", 6)]
    parts = spread_hot(df, hot, ["g"], F.lit(False), ["id"]).where("g = 'hot'").groupBy("_part").count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < 200
    assert spread_hot(df.where("id IN (0, 999)"), hot, ["g"], F.lit(True), ["id"]).count() == 7


def test_late_exact_clip_is_a_violation(spark):
    from tidemark.operators.checks import IntegrityError, check_before_cutoff, enforce
    ev = spark.createDataFrame([("x", "v", 5.0)], "narration_id string, video_id string, sta_cutoff double")
    feats = spark.createDataFrame([("x", 7, True, 9.0)], "narration_id string, row long, has_clip boolean, sta_clip_end_s double")
    h = T.history(ev, bank_frame(spark, range(1, 30)), 4, anchors=feats)
    with pytest.raises(IntegrityError, match="after_cutoff"):
        enforce(check_before_cutoff(h))


def test_every_hot_group_is_split(spark):
    from tidemark.operators.skew import hot_groups
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("g"))
    assert hot_groups(df, ["g"], rows=2).where("_parts = 2").count() == 20_000


def test_asof_directions(spark):
    p = spark.createDataFrame([("a", 5.0, 1), ("a", 7.0, 2), ("b", 1.0, 3)], "g string, t double, id int")
    f = spark.createDataFrame([("a", 5.0, 10), ("a", 5.0, 11), ("a", 900.0, 12), ("a", -400.0, 13)], "g string, t double, v int")
    got = {r["id"]: r for r in A.asof(p, f, ["g"], "t", "t", ["v"], width=1.0, direction="both", tie="v").collect()}
    assert (got[1]["before"]["v"], got[1]["after"]["v"]) == (11, 10)
    assert (got[2]["before"]["v"], got[2]["after"]["v"]) == (11, 12)
    assert got[3]["before"] is None and got[3]["after"] is None
    strict = {r["id"]: r for r in A.asof(p, f, ["g"], "t", "t", ["v"], width=1.0, direction="both", tie="v", strict=True).collect()}
    assert (strict[1]["before"]["v"], strict[1]["after"]["v"]) == (13, 12)


def test_exact_anchor_and_present_source(spark):
    bank = bank_frame(spark, range(1, 30))
    ev = spark.createDataFrame([("x", "v", 10.4), ("y", "v", 10.4), ("cold", "v", -1.0), ("z", "w", 5.0)], "narration_id string, video_id string, sta_cutoff double")
    feats = spark.createDataFrame([("x", 7, True, 10.2), ("cold", 8, True, 0.0), ("y", 9, False, 10.4)], "narration_id string, row long, has_clip boolean, sta_clip_end_s double")
    h = T.history(ev, bank, 4, anchors=feats)
    again = T.use_exact_anchor(T.history(ev, bank, 4), feats, 4)
    assert sorted(map(str, h.select(sorted(h.columns)).collect())) == sorted(map(str, again.select(sorted(h.columns)).collect()))
    last = {r["narration_id"]: r for r in h.where("k = 4").collect()}
    assert (last["x"]["source"], last["x"]["used_time"], last["x"]["row"]) == ("exact", 10.2, 7)
    assert (last["y"]["source"], last["y"]["used_time"]) == ("bank", 10.0) and not last["cold"]["valid"]
    source = {r["narration_id"]: r["present_source"] for r in T.present_clip(h, feats, 4).collect()}
    assert source == {"x": 1, "y": 2, "cold": 0, "z": 0}


def test_next_action_takes_the_first_start_in_range(spark):
    ev = events_frame(spark, [("c", "p", "v", 10.0, 11.0, 4, 4), ("b", "p", "v", 10.0, 12.0, 3, 3), ("d", "p", "v", 11.0, 12.0, 5, 5), ("f", "p", "v", 30.0, 31.0, 1, 1)])
    st = spark.createDataFrame([("e", "v", k, t, t != 9.0) for k, t in enumerate([7.0, 8.0, 9.0, 20.0, 9.6])], "narration_id string, video_id string, k int, tau double, valid boolean")
    assert [r["next_verb"] for r in T.next_action(st, ev).orderBy("k").collect()] == [None, 3, None, None, 5]


def test_nearest_frames_matches_brute_force(spark):
    rng = random.Random(1)
    frames = sorted(round(rng.uniform(0, 12), 2) for _ in range(40))
    wins = [("a", 0.0, 5.0, True), ("b", 3.0, 3.4, False), ("c", 0.0, 12.5, True), ("d", 11.99, 12.0, False), ("e", 50.0, 60.0, True)]
    w = spark.createDataFrame([(n, "v", (lo, hi, inc, False)) for n, lo, hi, inc in wins] + [("empty", "v", (0.0, -1.0, True, True))],
                              "narration_id string, video_id string, observation struct<start: double, end: double, inclusive_end: boolean, empty: boolean>")
    f = spark.createDataFrame([("v", p) for p in frames], "video_id string, pts double")
    got = {(r["narration_id"], r["slot"]): r["frame_time"] for r in T.nearest_frames(w, f, 4, width=2.0).collect()}
    assert len(got) == len(wins) * 4
    for n, lo, hi, inc in wins:
        legal = [p for p in frames if lo <= p and (p < hi or (inc and p == hi))]
        for i in range(4):
            target = lo + (i + 0.5) * (hi - lo) / 4
            want = min(legal, key=lambda p: (abs(target - p), p)) if legal else None
            assert got[n, i] == want


def test_clip_bank_windows_are_closed(spark):
    f = spark.createDataFrame([("v", 0.0), ("v", 1.0), ("v", 2.0), ("v", 3.5)], "video_id string, pts double")
    ends = spark.createDataFrame([("v", 7.2)], "video_id string, min_end double")
    rows = T.clip_bank(f, 2.0, 1.0, ends, num_frames=None).orderBy("row").collect()
    assert [r["window_end"] for r in rows] == [float(e) for e in range(1, 9)]
    assert [r["frames"] for r in rows] == [2, 3, 2, 2, 1, 0, 0, 0]
    assert [r["t_end_s"] for r in rows] == [1.0, 2.0, 2.0, 3.5, 3.5, -1.0, -1.0, -1.0]
    tenth = spark.createDataFrame([("v", 0.1 * 3)], "video_id string, pts double")
    assert [r["frames"] for r in T.clip_bank(tenth, 0.1, 0.1).orderBy("row").collect()][:3] == [0, 0, 1]


def test_dedupe_keeps_greedily(spark):
    rows = [("v", t, i) for i, t in enumerate([1.0, 1.0000008, 1.0000016, 2.0, 2.0, -1.0, float("nan")])] + [("w", 1.0, 9)]
    kept, dropped = SA.dedupe_times(spark.createDataFrame(rows, "video_id string, t_end_s double, row long"))
    assert sorted((r["video_id"], r["row"]) for r in kept.collect()) == [("v", 0), ("v", 2), ("v", 3), ("w", 9)]
    assert tuple(dropped.first()) == (2, 2)


def test_check_increasing(spark):
    bad = T.check_increasing(bank_frame(spark, [1.0, 3.0, 3.0, 2.5, float("inf")]))
    assert sorted(r["detail"].split()[1] for r in bad.collect()) == ["2", "3", "4"]
    assert T.check_increasing(bank_frame(spark, [1.0, 2.0])).isEmpty()


def test_history_never_passes_the_gate_when_shifted(spark):
    h = T.history(event_at(spark, 10), bank_frame(spark, range(1, 20)), 4)
    C.enforce(C.check_before_cutoff(h))
    with pytest.raises(C.IntegrityError, match="after_cutoff"):
        C.enforce(C.check_before_cutoff(h.withColumn("used_time", F.col("used_time") + 5)))


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_actions_in_the_sweep_equal_a_second_pass(spark, hot_rows):
    rng = random.Random(11)
    rows = [(f"e{i}", rng.choice("ab"), round(rng.uniform(-2, 60), 2), rng.choice([None, 0, 1, 2]), rng.randrange(9), rng.choice(["train", "val"])) for i in range(150)]
    rows += [(f"t{i}", "a", 20.0, i, i, "train") for i in range(5)] + [("none", "a", None, 1, 1, "val")]
    ev = spark.createDataFrame(rows, "narration_id string, video_id string, start double, verb int, noun int, subset string").withColumn("sta_cutoff", F.col("start") - 1)
    bank = bank_frame(spark, [i / 2 for i in range(90)], "a").unionByName(bank_frame(spark, [1, 1, 7, 30], "b"))
    for tolerance in ("stride", None):
        one = T.history(ev, bank, 5, 1.0, tolerance=tolerance, actions=T.Actions(ev, 0.5, 2.5, ("subset",)), hot_rows=hot_rows)
        two = T.next_action(T.history(ev, bank, 5, 1.0, tolerance=tolerance, keep=("subset",)), ev, 0.5, 2.5, by=("subset", "video_id"))
        columns = ["narration_id", "subset", "k", "tau", "used_time", "row", "valid", "next_verb", "next_noun"]
        assert sorted(map(tuple, one.select(columns).collect()), key=str) == sorted(map(tuple, two.select(columns).collect()), key=str)
    assert one.where("next_verb IS NOT NULL").count() and one.where("narration_id = 'none'").count() == 5
    with pytest.raises(ValueError):
        T.Actions(ev, 2.0, 1.0)


def test_event_clip_ends_equal_the_frame_loop(spark, folder):
    from tidemark.operators.checks import IntegrityError
    from tidemark.plans import build_event_features
    rng = random.Random(12)
    events = [(f"e{i}", "P1", rng.choice("abc"), s := round(rng.uniform(-1, 200), 1), s + rng.choice([0.2, 3.0, 90.0]), 0, 0) for i in range(200)]
    events += [("late", "P1", "a", 500.0, 501.0, 0, 0), ("edge", "P1", "d", 10.0, 12.0, 0, 0), ("other", "P1", "nowhere", 5.0, 6.0, 0, 0)]
    frames = [("a", round(i * 0.3, 1)) for i in range(700)] + [("b", float(t)) for t in (0, 1, 1, 64, 128, 128)] + [("b", -1.0), ("d", 9.0), ("d", 12.0), ("d", 4.0), ("c", None), ("c", float("nan"))]
    ev = events_frame(spark, events)
    fr = spark.createDataFrame(frames, "video_id string, pts double")
    got = {r["narration_id"]: r for r in T.event_clip_ends(ev, fr, 5.0, 16, width=16.0).collect()}
    assert len(got) == len(events) and got == {r["narration_id"]: r for r in T.event_clip_ends(ev, fr, 5.0, 16, width=7.0, hot_rows=3).collect()}
    for name, _, video, start, stop, _, _ in events:
        cut = got[name]
        c = round(start - 1, 9)
        windows = {"ar": (start, stop, lambda t: start <= t < stop), "sta": (max(0.0, c - 5), c, lambda t: c >= 0 and max(0.0, c - 5) <= t <= c)}
        for kind, (lo, hi, legal) in windows.items():
            seen = sorted(t for v, t in frames if v == video and t is not None and t >= 0 and legal(t)) if lo >= 0 else []
            best = [min(seen, key=lambda t, s=s: (abs(lo + (hi - lo) * (s + 0.5) / 16 - t), t)) for s in range(16)] if seen else [-1.0]
            assert cut[f"{kind}_clip_end_s"] == max(best), (name, kind)
        assert cut["use_prior"] == (cut["sta_clip_end_s"] < 0)
    assert (got["edge"]["ar_clip_end_s"], got["edge"]["sta_clip_end_s"]) == (-1.0, 9.0)
    with pytest.raises(IntegrityError, match="empty_action_clip"):
        build_event_features(fr, ev, f"{folder}/none")
    index = build_event_features(fr, ev.where("video_id = 'a' AND start > 1 AND start < 150 AND stop - start > 1"), f"{folder}/index")
    rows = index.orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(len(rows))) and all(r["has_clip"] for r in rows) and rows == sorted(rows, key=lambda r: (r["video_id"], r["action_start_s"]))
    assert T.event_clip_ends(ev.limit(0), fr).count() == 0 and T.event_clip_ends(ev, fr.limit(0)).where("use_prior").count() == len(events)


@pytest.mark.parametrize("width", [8.0, 64.0])
def test_greedy_chains_equal_the_loop(spark, width):
    from tidemark.operators.chains import greedy
    rng = random.Random(13)
    times = {"run": [round(i * 0.31, 2) for i in range(2000)], "sparse": [float(i * 7) for i in range(40)], "tie": [i * 0.5 for i in range(300)],
             "one": [3.0], "mixed": sorted({round(rng.uniform(0, 400), 2) for _ in range(500)}), "far": [1e6 + i / 3 for i in range(300)] + [9e8, 9e8 + 0.5]}
    points = spark.createDataFrame([(v, t, i) for v, ts in times.items() for i, t in enumerate(ts)], "video_id string, t_end_s double, row long").repartition(5)
    got = {}
    for r in greedy(points, ["video_id"], "t_end_s", "row", 1.0, width).collect():
        got.setdefault(r["video_id"], []).append((r["t_end_s"], r["row"]))
    for video, ts in times.items():
        want = []
        for i, t in enumerate(ts):
            if not want or t - want[-1][0] > 1.0:
                want.append((t, i))
        assert sorted(got[video]) == want, video
    assert greedy(points.limit(0), ["video_id"], "t_end_s", "row", 1.0, width).count() == 0
    with pytest.raises(ValueError):
        greedy(points, ["video_id"], "t_end_s", "row", 1.0, 2.0)
