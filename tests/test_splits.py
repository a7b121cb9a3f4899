from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import events_frame
from tidemark.operators import checks as C, sampling as SA, splits as SP, stats as S


def toy(spark, participants=12):
    rows = []
    for p in range(1, participants + 1):
        videos = [f"P{p:02d}_{v:02d}" for v in range(1, 3 + p % 4)] + [f"P{p:02d}_101"]
        for v in videos:
            for i in range(10 + 5 * (p % 5)):
                rows.append((f"{v}_{i}", f"P{p:02d}", v, 2.0 * i, 2.0 * i + 1, (i * p) % 7, (i + p) % 11))
    return rows, events_frame(spark, rows)


def test_grouped_split_keeps_videos_whole(spark):
    rows, ev = toy(spark)
    split = SP.grouped_split(ev)
    C.enforce(C.check_disjoint(split))
    videos = {r[2] for r in rows}
    held = {r["video_id"] for r in split.where("subset = 'val'").select("video_id").distinct().collect()}
    assert len(held) == round(len(videos) * 0.2)
    again = SP.grouped_split(ev.repartition(7))
    assert {r["video_id"] for r in again.where("subset = 'val'").select("video_id").distinct().collect()} == held
    assert {r["video_id"] for r in SP.grouped_split(ev, seed=1).where("subset = 'val'").select("video_id").distinct().collect()} != held


def test_grouped_split_needs_two_videos(spark):
    ev = events_frame(spark, [("a", "p", "v_1", 0.0, 1.0, 0, 0)])
    with pytest.raises(Exception, match="at least two videos"):
        SP.grouped_split(ev).collect()


def pool_by_hand(rows):
    n = Counter(r[1] for r in rows)
    sizes = sorted(n.values())
    lo, hi = sizes[int(.25 * (len(sizes) - 1))], sizes[int(.75 * (len(sizes) - 1))]
    return sorted(p for p in n if lo <= n[p] <= hi), n


@pytest.mark.parametrize("target", [0.2, 0.06])
def test_choose_unseen_equals_enumeration(spark, target):
    rows, ev = toy(spark)
    pool, n = pool_by_hand(rows)
    verbs, nouns = defaultdict(set), defaultdict(set)
    for r in rows:
        verbs[r[1]].add(r[5])
        nouns[r[1]].add(r[6])
    best = None
    for k in (2, 3):
        for names in combinations(pool, k):
            gap = abs(sum(n[p] for p in names) / len(rows) - target)
            seen = len(set().union(*[verbs[p] for p in names])) + len(set().union(*[nouns[p] for p in names]))
            key = (gap > 0.01, 0 if gap > 0.01 else -seen, gap, names)
            best = key if best is None or key < best else best
    got = tuple(sorted(r["participant_id"] for r in SP.choose_unseen(ev, target).collect()))
    assert got == best[3]


def test_many_participants_use_only_the_largest_members(spark):
    # beyond the limit no combination reaches the band; the closest one is then made of the largest
    limit = SP.band_limit(0.06, (2, 3), (0.25, 0.75), 0.01)
    assert limit == 241
    rows = [(f"P{p:04d}_{i}", f"P{p:04d}", f"P{p:04d}_01", 2.0 * i, 2.0 * i + 1, 0, 0) for p in range(260) for i in range(1 + p % 9)]
    ev = events_frame(spark, rows)
    pool, n = pool_by_hand(rows)
    best = min((abs(sum(n[p] for p in names) / len(rows) - 0.06), names) for k in (2, 3)
               for names in combinations([p for p in pool if n[p] == max(n[q] for q in pool)][:6], k))
    assert tuple(sorted(r["participant_id"] for r in SP.choose_unseen(ev).collect())) == best[1]


def test_latest_videos_equal_the_stop_rule(spark):
    rows, ev = toy(spark)
    per = defaultdict(Counter)
    for r in rows:
        per[r[1]][r[2]] += 1
    want = set()
    for p, videos in per.items():
        order = sorted(videos, key=lambda v: int(v.rsplit("_", 1)[1]))
        total, taken = sum(videos.values()), 0
        for v in reversed(order[1:]):
            if taken >= 0.3 * total or taken + videos[v] > 0.55 * total:
                break
            want.add(v)
            taken += videos[v]
    got = {r["video_id"] for r in SP.latest_videos(ev, 0.3, 0.55).collect()}
    assert got == want and any(v.endswith("_101") for v in got)


def test_hybrid_split_is_isolated(spark):
    _, ev = toy(spark)
    split = SP.hybrid_split(ev, unseen=["P03", "P07"], seen_fraction=0.2, seen_max_fraction=0.5)
    C.enforce(C.check_disjoint(split, spark.createDataFrame([("P03",), ("P07",)], "participant_id string")))
    assert split.count() == ev.count()
    assert {r["subset"] for r in split.select("subset").distinct().collect()} == {"train", "val_seen", "val_unseen"}
    with pytest.raises(C.IntegrityError, match="unknown_participant"):
        SP.hybrid_split(ev, unseen=["P99"])


def test_tail_classes(spark):
    counts = spark.createDataFrame([("verb", i, n) for i, n in enumerate([50, 30, 10, 5, 5, 0])], "field string, class_id int, n long")
    assert sorted(r["class_id"] for r in S.tail_classes(counts).collect()) == [2, 3, 4]


def test_tail_actions_break_ties_by_first_appearance(spark):
    rows = [(0, 1, 1), (1, 2, 2), (2, 2, 2), (3, 1, 1), (4, 0, 9), (5, 3, 3)]
    train = spark.createDataFrame(rows, "position long, verb int, noun int")
    val = spark.createDataFrame([(1, 1), (2, 2), (0, 9), (3, 3), (8, 8)], "verb int, noun int")
    flags = {(r["verb"], r["noun"]): r["tail"] for r in S.tail_actions(train, val, "position", 0.6).collect()}
    assert flags == {(1, 1): False, (2, 2): False, (0, 9): True, (3, 3): True, (8, 8): True}


def test_counts_and_priors_keep_absent_classes(spark):
    ev = events_frame(spark, [("a", "p", "v", 0.0, 1.0, 0, 2), ("b", "p", "v", 6.0, 7.0, 1, 2), ("c", "q", "w", 1.0, 2.0, 0, 0)])
    counts = S.class_counts(ev, 3, 4)
    assert [r["n"] for r in counts.where("field = 'verb'").orderBy("class_id").collect()] == [2, 1, 0]
    assert [r["n"] for r in counts.where("field = 'noun'").orderBy("class_id").collect()] == [1, 0, 2, 0]
    assert [round(r["prior"], 6) for r in S.prior(counts).where("field = 'verb'").orderBy("class_id").collect()] == [0.5, round(2 / 6, 6), round(1 / 6, 6)]
    cold = S.cold_start_prior(ev, 3, 4)
    assert [round(r["prior"], 6) for r in cold.where("field = 'verb'").orderBy("class_id").collect()] == [round(2.1 / 2.3, 6), round(.1 / 2.3, 6), round(.1 / 2.3, 6)]
    with pytest.raises(Exception, match="cold-start window"):
        S.cold_start_prior(ev.where("start >= 6"), 3, 4).collect()
    by_side = S.class_counts(ev.withColumn("subset", F.when(F.col("video_id") == "v", "train").otherwise("val")), 3, 4, keep=["subset"])
    assert by_side.count() == 14 and by_side.agg(F.sum("n")).first()[0] == 6


def test_assign_rows_is_contiguous_for_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("video_id"), (F.col("id") * 7 % 5000).alias("t"))
    rows = SA.assign_rows(df, ["video_id", "t"]).orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(5000))
    assert [(r["video_id"], r["t"]) for r in rows] == sorted((r["video_id"], r["t"]) for r in rows)


def test_uniform_positions(spark):
    df = spark.createDataFrame([("a", i) for i in range(21)] + [("b", i) for i in range(3)], "g string, t int")
    got = defaultdict(dict)
    for r in SA.uniform_positions(df, ["g"], ["t"], 5, F.floor(F.col("t") / 4)).collect():
        got[r["g"]][r["slot"]] = r["t"]
    assert [got["a"][i] for i in range(5)] == [int(21 / 5 * i) for i in range(5)]
    assert [got["b"][i] for i in range(5)] == [0, 1, 2, 2, 2]


def test_round_robin_visits_every_video_first(spark):
    df = spark.createDataFrame([(f"e{i}", "hot" if i > 9 else f"v{i}") for i in range(200)], "narration_id string, video_id string")
    picked = SA.round_robin(df, 14).collect()
    assert len({r["video_id"] for r in picked}) == 11 and len(picked) == 14


def test_inspection_sample(spark):
    df = spark.createDataFrame([(i, f"n{i}", c) for i, c in enumerate([3.0, 9.0, -1.0] + [6.0] * 17)], "position long, narration_id string, sta_cutoff double")
    got = [r["position"] for r in SA.inspection_sample(df, 5).orderBy("sample_rank").collect()]
    assert got == [2, 1, 0, 4, 9]


def test_best_epoch_stops_early(spark):
    rows = [("r", i, s) for i, s in enumerate([1.0, 3.0, 2.0, 3.0, 2.5, 9.0])] + [("q", 0, 5.0), ("q", 1, 6.0)]
    got = {r["run"]: r for r in SA.best_epoch(spark.createDataFrame(rows, "run string, epoch int, score double"), "score", 3).collect()}
    assert (got["r"]["best_epoch"], got["r"]["best_score"], got["r"]["last_epoch"], got["r"]["stopped_early"]) == (1, 3.0, 4, True)
    assert (got["q"]["best_epoch"], got["q"]["epochs_since_best"], got["q"]["stopped_early"]) == (1, 0, False)


def test_two_standard_deviations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, x double")
    sample = {r["c"]: r["sd"] for r in S.mean_sd(df, "c", "x").collect()}
    assert round(sample["a"], 6) == round(2 ** .5, 6) and sample["b"] == 0.0
    assert {r["c"]: r["sd"] for r in S.mean_sd(df, "c", "x", 0).collect()} == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize("target,band,ks,pool", [(.3, .05, (2, 3), (0, 1)), (.01, .01, (2, 3), (0, 1)), (.9, .01, (1, 2, 3), (0, 1)), (.2, .001, (3,), (.1, .9)), (.1, .02, (1, 2), (0, 1)), (.25, .3, (3,), (0, 1))])
def test_best_combination_equals_the_listing(spark, target, band, ks, pool):
    import random
    draw = random.Random(f"{target}{ks}")
    rows = [(f"n{i}", f"P{draw.randrange(14)}", draw.randrange(9), draw.randrange(30) if i % 7 else None) for i in range(150)]
    rows += [(f"m{p}{i}", f"Q{p}", 1, 2) for p in range(6) for i in range(8)]  # members that are alike
    ev = spark.createDataFrame(rows, "narration_id string, participant_id string, verb int, noun int")
    want = SP.combinations(ev, target, ks, pool, band).orderBy("outside", F.col("coverage").desc(), "distance", "names").first()
    got = SP.best_combination(ev, target, ks, pool, band).first()
    assert [got[c] for c in ("names", "n", "distance", "outside", "coverage")] == [want[c] for c in ("names", "n", "distance", "outside", "coverage")]
    with pytest.raises(ValueError):
        SP.best_combination(ev, ks=(4,))


@pytest.mark.parametrize("target,band", [(.3, .05), (.2, .001), (.01, .01), (.25, .3), (.2, .0)])
def test_counts_without_the_cube(spark, target, band):
    import random
    draw = random.Random(3)
    rows = [(f"n{i}", f"P{draw.randrange(12)}", 0, 0) for i in range(160)] + [(f"m{p}{i}", f"Q{p}", 0, 0) for p in range(5) for i in range(8)]
    ev = spark.createDataFrame(rows, "narration_id string, participant_id string, verb int, noun int")
    listed = SP.combinations(ev, target, (2, 3), (0, 1), band).groupBy(F.size("names").cast("long").alias("members"), "outside").agg(
        F.count(F.lit(1)).alias("combinations"), F.sum("n").alias("events"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, SP.combination_counts(ev, target, (0, 1), band).collect()))
