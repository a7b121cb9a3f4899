import math

import numpy as np
from pyspark.sql import functions as F

from tidemark import functions as X
from tidemark.operators import metrics as M


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first()["c"]


def test_parse_seconds(spark):
    cases = [("00:00:20", 20.0), ("01:02:03.25", 3723.25), ("7.5", 7.5), ("1e2", 100.0), (" 3 ", 3.0), ("00:60:00", None),
             ("00:00:60", None), ("-1:00:00", None), ("1:2", None), ("nan", None), ("inf", None), ("x", None), ("", None), ("1.5f", None)]
    df = spark.createDataFrame(cases, "t string, want double")
    for r in df.select("t", "want", X.parse_seconds("t").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_cutoff_is_exact_decimal(spark):
    df = spark.createDataFrame([(1.1,), (20.0,), (0.3,)], "start double")
    assert [r["c"] for r in df.select(X.cutoff("start", 1.0).alias("c")).collect()] == [0.1, 19.0, -0.7]


def test_observation_windows(spark):
    df = spark.createDataFrame([(20.0, 21.0, 19.0), (2.0, 3.0, 1.0), (0.4, 0.8, -0.6)], "start double, stop double, sta_cutoff double")
    sta = [tuple(r["w"]) for r in df.select(X.observation("start", "stop", "sta_cutoff", F.lit("STA"), 5.0).alias("w")).collect()]
    assert sta == [(14.0, 19.0, True, False), (0.0, 1.0, True, False), (0.0, -0.6, True, True)]
    ar = df.select(X.observation("start", "stop", "sta_cutoff", F.lit("AR")).alias("w")).first()["w"]
    assert tuple(ar) == (20.0, 21.0, False, False)


def test_text_functions(spark):
    df = spark.createDataFrame([("P01_09", "d_S16_seed42_x"), ("P01_101", "plain"), ("nothing", "a_seed1_seed2")], "v string, r string")
    got = [tuple(x) for x in df.select(X.video_number("v"), X.config_name("r"), X.config_seed("r")).collect()]
    assert got == [(9, "d_S16_x", 42), (101, "plain", None), (None, "a_seed2", 1)]
    assert one(spark, X.is_safe_id(F.lit("P01_01-3.a"))) and not one(spark, X.is_safe_id(F.lit("../x")))
    assert [one(spark, X.parse_bool(F.lit(s))) for s in ("True", " 1 ", "0", "yes")] == [True, True, False, False]
    texts = [one(spark, X.format_mean_sd(F.lit(m).cast("double"), F.lit(s).cast("double"), F.lit(n))) for m, s, n in ((8.284, .114, 3), (8.0, None, 1), (None, None, 0))]
    assert texts == ["8.28 ± 0.11", "8.00", "–"]


def test_run_labels(spark):
    f = lambda *a: one(spark, X.fusion_label(*[F.lit(x) for x in a]))
    assert f("aga", None, None) == "aga"
    assert f("three_way", "history,present,future", "none") == "three_way H+P"
    assert f("three_way", "present, future", "mean") == "three_way P+F (future: mean)"
    m = lambda *a: one(spark, X.memory_label(*[F.lit(x) for x in a]))
    assert m(None, None, None, None) == "scratch"
    assert m("x", True, None, None) == "pre-trained (frozen)"
    assert m(None, False, "d", "features") == "probe steps (feature keys), scratch"
    assert one(spark, X.branch_list(F.lit("present, history"))) == ["history", "present"]
    assert one(spark, X.branch_list(F.lit("present,other"))) is None


def test_half_even_count(spark):
    df = spark.createDataFrame([(5, 1), (7, 1), (10, 2), (2, 1), (495, 99)], "n long, want long")
    assert all(r["g"] == r["want"] for r in df.select("want", X.half_even_count("n", 0.2).alias("g")).collect())
    assert one(spark, X.half_even_count(F.lit(25).cast("long"), 0.1)) == 2  # 2.5 rounds to even


def test_softmax_and_gates(spark):
    p = one(spark, X.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]
    masked = one(spark, X.mask_vector(F.array(F.lit(float("nan")), F.lit(1.0)), F.lit(False)))
    assert masked == [0.0, 0.0]
    assert one(spark, X.gate_mix(F.array(F.lit(2.0)), F.array(F.lit(4.0)), F.array(F.lit(0.25)))) == [3.5]
    assert one(spark, X.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert math.isclose(one(spark, X.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))), 2 ** -0.5)


def test_top_k_agrees_with_full_sort_and_between_implementations(spark):
    rng = np.random.default_rng(3)
    pv, pn = rng.dirichlet(np.ones(97), 40), rng.dirichlet(np.ones(300), 40)
    pv[0] = 1 / 97      # all ties: lower ids win
    pn[0] = 1 / 300
    df = spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(zip(pv, pn))],
                               "id int, verb_output array<double>, noun_output array<double>")
    jvm = df.select("id", X.top_k("verb_output").alias("v"), X.top_k("noun_output").alias("n"),
                    X.joint_top_k("verb_output", "noun_output").alias("a")).orderBy("id").collect()
    arrow = M.ranked(df, "probabilities").orderBy("id").collect()
    for i in range(40):
        joint = (pv[i][:, None] * pn[i][None, :]).ravel()
        want = np.argsort(-joint, kind="stable")[:5].tolist()
        assert jvm[i]["a"] == want == arrow[i]["top_actions"]
        assert jvm[i]["v"] == np.argsort(-pv[i], kind="stable")[:5].tolist() == arrow[i]["top_verbs"]
        assert jvm[i]["n"] == arrow[i]["top_nouns"]
        assert all(spark.range(1).select(X.ranking.joint_hit(F.lit(pv[i].tolist()), F.lit(pn[i].tolist()), F.lit(t // 300), F.lit(t % 300)).alias("h")).first()["h"]
                   for t in want[:1]) if i < 3 else True
