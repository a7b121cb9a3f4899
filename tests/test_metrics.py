import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import events_frame
from tidemark.operators import checks as C, metrics as M, stats as S, vectors as VX


def scored_frame(spark, verbs, nouns, pv, pn):
    rows = [(f"n{i}", int(a), int(b), [float(x) for x in p], [float(x) for x in q]) for i, (a, b, p, q) in enumerate(zip(verbs, nouns, pv, pn))]
    return spark.createDataFrame(rows, "narration_id string, verb int, noun int, verb_output array<double>, noun_output array<double>")


def spike(n, at, high=1.0):
    v = np.zeros(n)
    v[at] = high
    return v


def test_macro_recall_weighs_classes_equally(spark):
    verbs = [0] * 9 + [90]
    df = scored_frame(spark, verbs, [0] * 10, [spike(97, 0, 9.0)] * 10, [spike(300, 0, 9.0)] * 10)
    m = {r["field"]: r for r in M.rank_metrics(df).collect()}
    assert (m["verb"]["top5"], m["verb"]["mt5r"]) == (90.0, 50.0)


def test_joint_top_five_is_not_two_marginals(spark):
    pv, pn = np.full(97, 1e-6), np.full(300, 1e-6)
    pv[:5] = [.6, .3, .05, .03, .02]
    pn[:5] = [.6, .3, .05, .03, .02]
    df = scored_frame(spark, [4], [4], [np.log(pv)], [np.log(pn)])
    m = {r["field"]: r["top5"] for r in M.rank_metrics(df).collect()}
    assert m == {"verb": 100.0, "noun": 100.0, "action": 0.0}


def by_hand(verbs, nouns, pv, pn, mask, n=300):
    joint = (pv[:, :, None] * pn[:, None, :]).reshape(len(pv), -1)
    out = {}
    for field, y, s in (("verb", verbs, pv), ("noun", nouns, pn), ("action", verbs * n + nouns, joint)):
        top = np.argsort(-s, axis=1, kind="stable")[:, :5][mask]
        y = y[mask]
        hit = (top == y[:, None]).any(1)
        out[field] = (100 * (top[:, 0] == y).mean(), 100 * hit.mean(), 100 * np.mean([hit[y == c].mean() for c in np.unique(y)]))
    return out


def random_scores(n=120, v=7, m=11, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, v, n), rng.integers(0, m, n), rng.dirichlet(np.ones(v), n), rng.dirichlet(np.ones(m), n)


def test_subsets_and_breakdown_equal_numpy(spark):
    verbs, nouns, pv, pn = random_scores()
    df = scored_frame(spark, verbs, nouns, pv, pn)
    e = {(r["subset"], r["field"]): r for r in M.evaluate(df, "STA", {"odd": F.col("verb") % 2 == 1, "none": F.lit(False)}, "probabilities", 11).collect()}
    for name, mask in (("all", np.ones(120, bool)), ("odd", verbs % 2 == 1)):
        for field, want in by_hand(verbs, nouns, pv, pn, mask, 11).items():
            r = e[name, field]
            assert np.allclose([r["top1"], r["top5"], r["mt5r"]], want) and r["events"] == mask.sum()
            assert r["primary_score"] == e[name, "action"]["mt5r"]
    assert e["none", "verb"]["events"] == 0 and e["none", "verb"]["top1"] is None
    tail = spark.createDataFrame([("verb", 1), ("noun", 2), ("noun", 3)], "field string, class_id int")
    b = {(r["subset"], r["field"]): r for r in M.evaluate_breakdown(df, "AR", tail, F.col("noun") < 4, "probabilities", 11).collect()}
    tv, tn = verbs == 1, np.isin(nouns, [2, 3])
    for field, mask in (("verb", tv), ("noun", tn), ("action", tv | tn)):
        assert np.allclose(b["tail", field]["mt5r"], by_hand(verbs, nouns, pv, pn, mask, 11)[field][2]) and b["tail", field]["events"] == mask.sum()
    assert b["seen", "verb"]["events"] == (nouns >= 4).sum() and b["overall", "action"]["primary_score"] == b["overall", "action"]["top1"]
    with pytest.raises(ValueError):
        M.evaluate(df, "XX")


@pytest.mark.parametrize("task", ["AR", "STA"])
def test_grid_search_equals_numpy(spark, task):
    verbs, nouns, pv, pn = random_scores(80, seed=2)
    zv, zn = np.log(pv), np.log(pn)
    lv, ln = np.log(np.linspace(.05, .4, 7)), np.log(np.linspace(.02, .2, 11))
    arr = lambda a: spark.createDataFrame([([float(x) for x in a],)], "log_prior array<double>")
    taus = [0, 0.7, 1.5]
    got = {(r["i"], r["j"]): r for r in M.grid_search(scored_frame(spark, verbs, nouns, zv, zn), arr(lv), arr(ln), task, taus, taus, 0.8, num_nouns=11).collect()}
    table = np.zeros((3, 3))
    for i, a in enumerate(taus):
        for j, b in enumerate(taus):
            p, q = zv / .8 - a * lv, zn / .8 - b * ln
            if task == "AR":
                table[i, j] = 100 * ((p.argmax(1) == verbs) & (q.argmax(1) == nouns)).mean()
            else:
                soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
                table[i, j] = by_hand(verbs, nouns, soft(p), soft(q), np.ones(80, bool), 11)["action"][2]
            assert np.isclose(got[i, j]["value"], table[i, j]) and np.isclose(got[i, j]["baseline"], table[0, 0])
    best = np.unravel_index(np.argmax(table), table.shape)
    assert [k for k, r in got.items() if r["is_best"]] == [tuple(int(x) for x in best)]


def test_grid_search_keeps_ties(spark):
    """Verb 6 is hit as often at tau 0 as verb 5 at tau 1 and the other way round, so both cells have the same mean and the first is best."""
    arr = lambda a: spark.createDataFrame([([float(x) for x in a],)], "log_prior array<double>")
    wrong = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        verbs, nouns, zv = [], [], []
        for noun in range(11):
            n = int(rng.integers(3, 40))
            low, high = np.sort(rng.integers(0, n + 1, 2))
            for i in range(n):
                for verb, once in ((6, 1.0), (5, -1.0)):
                    z = [0.0] * 7
                    z[verb] = 20.0 if i < low else once if i < high else -20.0
                    verbs.append(verb), nouns.append(noun), zv.append(z)
        df = scored_frame(spark, verbs, nouns, zv, 50 * np.eye(11)[nouns])
        got = {r["i"]: r for r in M.grid_search(df, arr([0, 0, 0, 0, 0, -10, 10]), arr([0] * 11), "STA", [0, 1], [0], num_nouns=11).collect()}
        assert np.isclose(got[0]["value"], got[1]["value"])
        if not got[0]["is_best"] or got[0]["value"] != got[1]["value"]:
            wrong.append(seed)
    assert not wrong


def test_prior_fallback(spark):
    df = scored_frame(spark, [0, 1, 1], [0, 1, 1], [[1., 2.]] * 3, [[3., 4.]] * 3)
    h = spark.createDataFrame([("n0", 1, True), ("n0", 2, False), ("n1", 1, False)], "narration_id string, k int, valid boolean")
    prior = spark.createDataFrame([([9., 8.], [7., 6.])], "verb_output array<double>, noun_output array<double>")
    got = {r["narration_id"]: (r["use_prior"], r["verb_output"]) for r in M.with_prior_fallback(df, h, prior).collect()}
    assert got == {"n0": (False, [1., 2.]), "n1": (True, [9., 8.]), "n2": (True, [9., 8.])}


def test_attention_equals_numpy_with_heads_and_masks(spark):
    rng = np.random.default_rng(1)
    B, L, d, heads = 6, 5, 8, 2
    q, k, v, ok = rng.normal(size=(B, d)), rng.normal(size=(B, L, d)), rng.normal(size=(B, L, d)), rng.random((B, L)) > .3
    ok[2] = False
    rows = [(f"e{b}", l, q[b].tolist(), k[b, l].tolist(), v[b, l].tolist() if ok[b, l] else [float("nan")] * d, bool(ok[b, l])) for b in range(B) for l in range(L)]
    df = spark.createDataFrame(rows, "narration_id string, k int, q array<double>, key array<double>, value array<double>, ok boolean")
    for r in VX.attend(df, "q", "key", "value", "ok", heads).collect():
        b = int(r["narration_id"][1:])
        for h in range(heads):
            part = slice(h * 4, h * 4 + 4)
            s = np.where(ok[b], k[b][:, part] @ q[b][part] / 2, -np.inf)
            w = np.exp(s - s.max()) / np.exp(s - s.max()).sum() if ok[b].any() else np.zeros(L)
            assert np.allclose(r["weights"][h], w) and np.allclose(r["attended"][part], w @ v[b][:, part])


def test_gate_ignores_missing_branches_even_nan(spark):
    nan = [float("nan")] * 2
    rows = [([1., 1.], nan, [3., 3.], [0., 5., 0.], [True, False, True]), ([1., 1.], nan, nan, [1., 1., 1.], [False, False, False])]
    df = spark.createDataFrame(rows, "h array<double>, p array<double>, f array<double>, z array<double>, ok array<boolean>")
    a, b = VX.gate_fuse(df, ["h", "p", "f"], "z", "ok").collect()
    assert a["gate_weights"] == [.5, 0., .5] and a["fused"] == [2., 2.]
    assert b["gate_weights"] == [0., 0., 0.] and b["fused"] == [0., 0.]


def test_pooling_bins_overlap(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 6, 6, 3))
    rows = [(0, t, i, j, x[t, i, j].tolist()) for t in range(8) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "clip_id int, t int, y int, x int, vec array<double>")
    got = {r["position"]: r["vec"] for r in VX.pool_tokens(df, 8, 6, 4, 2).collect()}
    assert len(got) == 24
    last = x[-2:].mean(0)
    for t in range(8):
        assert np.allclose(got[t], x[t].mean((0, 1)))
    for a in range(4):
        for b in range(4):
            rows_, cols = slice(a * 6 // 4, -(-(a + 1) * 6 // 4)), slice(b * 6 // 4, -(-(b + 1) * 6 // 4))
            assert np.allclose(got[8 + 4 * a + b], last[rows_, cols].mean((0, 1)))


@pytest.mark.parametrize("block", [4096, 7])
def test_retrieval_equals_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    k = rng.normal(size=(150, 6))
    k[100:] = k[0] + rng.normal(size=(50, 6)) * 1e-3        # a third of the keys are near copies
    k[149] = k[148]
    q = k + rng.normal(size=k.shape) * .15
    q[149] = q[148] = k[148]
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (np.argmax(unit(q) @ unit(k).T, 1) == np.arange(150)).mean()
    r = VX.retrieval_top1(frame(q), frame(k), pivots=8, block=block).first()
    assert abs(r["top1"] - want) < 1e-9 and r["n"] == 150


def test_retrieval_routes_without_vectors_and_in_slices(monkeypatch):
    """A query that must see every leaf gets one row per tile, not a copy of its vector per leaf, and distances are made slice by slice."""
    import pyarrow as pa

    from tidemark.operators import retrieval as RT
    rng = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    p, q = unit(rng.normal(size=(40, 8))), unit(rng.normal(size=(50, 8)))
    leaves = pa.table({"leaf": np.arange(40), "p": list(p), "lo": np.zeros(40), "hi": np.full(40, 2.0), "tile": np.arange(40) % 3})
    queries = pa.table({"id": np.arange(50), "q": list(q), "own": np.zeros(50), "r": np.full(50, 2.0), "met": np.zeros(50, int)})
    cells, real = [], RT._distances
    monkeypatch.setattr(RT, "CELLS", 400)
    monkeypatch.setattr(RT, "_distances", lambda a, b: cells.append(len(a) * len(b)) or real(a, b))
    out = RT._ring(4, 64)(queries, leaves)
    assert max(cells) <= 400 and out.num_rows == 150 and "q" not in out.column_names
    visits = out.column("visits").combine_chunks()
    d = real(q, p)
    for i in range(50):
        mine = np.flatnonzero(np.asarray(out.column("id")) == i)
        assert sorted(np.concatenate([visits[int(m)].values.to_numpy() for m in mine])) == sorted(np.argsort(d[i])[4:])
        assert sum(out.column("first").to_pylist()[int(m)] for m in mine) == 1


def test_offdiagonal_cosine_and_spread(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert np.isclose(VX.offdiag_cosine(df, "v").first()["mean_cosine"], (s.sum() - np.trace(s)) / (30 * 29))
    assert np.isclose(VX.dimension_spread(df, "v").first()["mean_sd"], x.std(0, ddof=1).mean())


def test_frozen_scorer_versions(spark):
    df = spark.createDataFrame([(1, [1., 2.]), (2, [0., 1.])], "row long, vector array<double>")
    out = VX.score_frozen(df, {"W": np.array([[1., 0.], [1., 1.], [0., 2.]]), "b": np.array([0., 1., 0.])}, "v1")
    assert {r["row"]: r["scores"] for r in out.collect()} == {1: [1., 4., 4.], 2: [0., 2., 2.]}
    assert VX.score_frozen(out, {}, "v1", done="v1") is out
    with pytest.raises(ValueError):
        VX.score_frozen(out, {}, "v2", done="v1")
    meta = spark.createDataFrame([("bank-1", "v1")], "source_bank string, scorer string")
    C.enforce(C.check_versions(meta, {"source_bank": "bank-1", "scorer": "v1"}))
    with pytest.raises(C.IntegrityError, match="scorer"):
        C.enforce(C.check_versions(meta, {"scorer": "v2"}))


def test_baseline_learns(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 90)
    x = np.eye(3)[y] * 3 + rng.normal(size=(90, 3)) * .3
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "verb int, vector array<double>")
    model = VX.fit_baseline(df, "verb", max_iter=20)
    from pyspark.ml.functions import array_to_vector
    out = model.transform(df.withColumn("features", array_to_vector("vector")))
    assert out.where("prediction = verb").count() > 85


def test_prediction_checks(spark):
    good = scored_frame(spark, [0, 1], [0, 1], [spike(97, 0)] * 2, [spike(300, 0)] * 2)
    ids = spark.createDataFrame([("n0",), ("n1",)], "narration_id string")
    C.enforce(C.check_predictions(good, ids))
    bad = good.withColumn("verb_output", F.when(F.col("narration_id") == "n0", F.array_repeat(F.lit(float("inf")), 97)).otherwise(F.slice("verb_output", 1, 96)))
    assert C.check_predictions(bad, ids).where("check = 'bad_verb_output'").count() == 2
    huge = good.withColumn("noun_output", F.transform("noun_output", lambda x: F.lit(1e39)))
    assert C.check_predictions(huge, ids).where("check = 'bad_noun_output'").count() == 2
    three = ids.unionByName(spark.createDataFrame([("n2",)], "narration_id string"))
    assert [r["check"] for r in C.check_predictions(good, three).collect()] == ["missing_prediction"]
    assert {r["check"] for r in C.check_predictions(good.unionByName(good.where("narration_id = 'n0'")), ids).collect()} == {"duplicate_prediction"}


def test_score_checks(spark):
    df = spark.createDataFrame([("a", [.5, .5]), ("b", [1.2, -.2]), ("c", [.5, .4]), ("d", [float("nan"), 1.]), ("e", [1.])], "narration_id string, p array<double>")
    got = {(r["id"], r["check"]) for r in C.check_scores(df, "p", 2, "probabilities").collect()}
    assert {("b", "negative_probability"), ("c", "sum_not_one"), ("d", "not_finite"), ("e", "bad_width")} <= got and not any(i == "a" for i, _ in got)


def test_leaky_feature_index(spark):
    ev = events_frame(spark, [("a", "p", "v", 5.0, 6.0, 0, 0), ("b", "p", "v", 5.0, 6.0, 0, 0), ("c", "p", "v", 0.5, 1.0, 0, 0), ("d", "p", "v", 9.0, 9.5, 0, 0)])
    idx = lambda rows: spark.createDataFrame(rows, "narration_id string, row long, sta_clip_end_s double, use_prior boolean")
    good = [("a", 0, 3.98, False), ("b", 1, 4.0, False), ("c", 2, -1.0, True), ("d", 3, 8.0, False)]
    C.enforce(C.check_event_features(idx(good), ev))
    kinds = lambda rows, **kw: {(r["check"], r["id"]) for r in C.check_event_features(idx(rows), ev, **kw).collect()}
    assert kinds([("a", 0, 4.01, False)] + good[1:]) == {("late_clip", "a")}
    assert kinds(good[:2] + [("c", 2, -1.0, False)] + good[3:]) == {("prior_flag_wrong", "c")}
    assert kinds(good[:3]) == {("event_without_features", "d")} and kinds(good[:3], require_all=False) == set()
    assert kinds(good[:3] + [("d", 3, 8.0, True)]) == {("history_marked_prior", "d")}
    assert ("duplicate_row", "0") in kinds([("a", 0, 3.0, False), ("b", 0, 3.0, False)] + good[2:])
    with pytest.raises(C.IntegrityError, match="late_clip: 1 rows"):
        C.enforce(C.check_event_features(idx([("a", 0, 4.01, False)] + good[1:]), ev))


def test_class_weights_average_to_one(spark):
    c = spark.createDataFrame([("verb", i, n) for i, n in enumerate([9, 0, 4])], "field string, class_id int, n long")
    w = S.class_weights(c, -1.0).collect()
    assert abs(sum(r["weight"] * (r["n"] + 1) for r in w) / sum(r["n"] + 1 for r in w) - 1) < 1e-12


def test_retrieval_meets_few_leaves_on_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    k = np.repeat(centres, 50, 0) + rng.normal(size=(2000, 16)) * .05
    q = k + rng.normal(size=k.shape) * .02
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    got = VX.retrieval_hits(frame(q), frame(k), block=64).toPandas().sort_values("id")
    assert (got["hit"].to_numpy() == (np.argmax(unit(q) @ unit(k).T, 1) == np.arange(2000))).all()
    assert got["leaves"].mean() < 3 and got["leaves"].max() < 12  # of 45


def test_retrieval_without_vectors(spark):
    schema = "id long, vector array<double>, q int, leaf string"
    keys = spark.createDataFrame([(1, [1.0, 0.0], 0, ""), (2, None, 0, ""), (3, [float("nan"), 1.0], 0, ""), (4, [0.5, None], 0, ""), (5, [0.0, 1.0], 0, "")], schema)
    got = {r["id"]: (r["hit"], r["leaves"]) for r in VX.retrieval_hits(keys, keys).collect()}
    assert sorted(i for i in got if got[i][0]) == [1, 5]
    assert {got[i] for i in (2, 3, 4)} == {(False, 0)}
    assert VX.retrieval_top1(keys, keys.limit(0)).first()["top1"] == 0
    none = VX.retrieval_top1(keys.limit(0), keys).first()
    assert none["n"] == 0 and none["top1"] is None


def test_ridge_equals_the_closed_form(spark):
    from tidemark.operators import baseline as BL
    rng = np.random.default_rng(5)
    y, z = rng.integers(0, 3, 120), rng.integers(0, 4, 120)
    x = np.eye(3)[y] * 2 + rng.normal(size=(120, 3)) * .4
    rows = [(int(a) if i % 10 else None, int(b), v.tolist()) for i, (a, b, v) in enumerate(zip(y, z, x))]
    rows += [(0, 0, None), (1, 1, [float("nan"), 0.0, 0.0]), (2, 2, [None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "verb int, noun int, vector array<double>").repartition(7)
    weights = spark.createDataFrame([("verb", 0, 2.0), ("verb", 2, 0.5), ("noun", 3, 3.0)], "field string, class_id int, weight double")
    model = BL.fit_ridge(df, {"verb": 3, "noun": 4}, weights, reg=0.7)
    for field, n, label, heavy, some in (("verb", 3, y, [2, 1, .5], np.arange(120) % 10 > 0), ("noun", 4, z, [1, 1, 1, 3.], np.ones(120, bool))):
        full, w = np.c_[x, np.ones(120)][some], np.array(heavy)[label[some]]
        want = np.linalg.solve((full.T * w) @ full + np.diag([.7] * 3 + [0]), (full.T * w) @ np.eye(n)[label[some]])
        assert np.allclose(model[field]["W"], want[:3].T) and np.allclose(model[field]["b"], want[3])
    counts = spark.createDataFrame([("verb", i, n) for i, n in enumerate([7, 1, 0])] + [("noun", i, 1) for i in range(4)], "field string, class_id int, n long")
    asked = df.withColumn("use_prior", F.col("noun") == 1)
    out = BL.ridge_outputs(asked, model, counts).collect()
    assert len(out) == len(rows)
    for r in out:
        cold = r["noun"] == 1 or r["vector"] is None or r["vector"][0] is None or np.isnan(r["vector"][0])
        assert r["used_prior"] == cold
        want = np.log(np.array([8, 2, 1]) / 11 + 1e-8) if cold else model["verb"]["W"] @ r["vector"] + model["verb"]["b"]
        assert np.allclose(r["verb_output"], want) and len(r["noun_output"]) == 4
    with pytest.raises(Exception, match="outside 0 to 1"):
        BL.fit_ridge(df, {"verb": 2})
    with pytest.raises(ValueError, match="no vectors"):
        BL.fit_ridge(df.limit(0), {"verb": 3})


def test_metrics_refuse_sums_that_the_score_check_refuses(spark):
    near, far = [.5, .5 + 1e-5], [.5, .5 + 1e-4]
    frame = lambda p: spark.createDataFrame([("a", 0, 1, p, [.5, .5])], "narration_id string, verb int, noun int, verb_output array<double>, noun_output array<double>")
    M.evaluate(frame(near), "STA", {}, "probabilities", 2).collect()
    with pytest.raises(Exception, match="verb: a label or score"):
        M.evaluate(frame(far), "STA", {}, "probabilities", 2).collect()


def exchanged(df):
    """The columns of every shuffle of a plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [(m[1], m[2]) for m in re.finditer(r"\) Exchange\n(?:Input \[\d+\]: \[([^\n]*)\]\n)Arguments: hashpartitioning\(([a-z_]+)", text)]


def test_ridge_rows_are_not_dealt_with_their_vectors(spark):
    import __spark_entry__ as entry_module
    from conftest import SMALL
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = exchanged(entry_module.queries()["u2_ridge_baseline"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any(key == "narration_id" for _, key in sent)
    assert not [columns for columns, key in sent if key == "narration_id" and ("embedding" in columns or "vector" in columns)]


def test_running_average_shuffles_vectors_as_stored(spark):
    from tidemark.operators import sampling as SA
    steps = spark.sql("SELECT 'a' AS narration_id, k, k <> 2 AS valid, CAST(array(k / 3, 1.1) AS array<float>) AS p FROM (SELECT explode(sequence(1, 4)) AS k)")
    out = SA.ema(steps, "p", "valid")
    gathered = [line for line in out._jdf.queryExecution().analyzed().toString().splitlines() if "collect_list" in line]
    assert gathered and not any("cast(p" in line for line in gathered)
    q = np.zeros(2)
    for k in (1, 3, 4):
        q = .8 * np.array([k / 3, 1.1], "float32").astype(float) + (1 - .8) * q
    assert np.allclose(out.first()["ema"], q, rtol=1e-12)


def test_predictions_are_checked_in_one_aggregation(spark):
    both = "array(CAST(0 AS float)) AS verb_output, array(CAST(0 AS float)) AS noun_output"
    pred = spark.sql(f"SELECT id AS narration_id, {both} FROM VALUES ('a'), ('b'), ('b'), ('x'), (' '), (CAST(NULL AS string)), (NULL) AS t(id)")
    ids = spark.sql("SELECT id AS narration_id FROM VALUES ('a'), ('b'), ('c'), ('c'), (CAST(NULL AS string)) AS t(id)")
    found = C.check_predictions(pred, ids, 1, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1  # one hash table a task
    want = [("missing_prediction", "c", ""), ("missing_prediction", None, ""), ("unexpected_prediction", "x", ""), ("unexpected_prediction", " ", ""),
            ("unexpected_prediction", None, ""), ("duplicate_prediction", "b", "count 2"), ("duplicate_prediction", " ", "count 1"),
            ("duplicate_prediction", None, "count 2"), ("duplicate_expected_id", "c", "count 2"), ("duplicate_expected_id", None, "count 1")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_attention_deals_steps_and_questions_without_vectors(spark):
    import __spark_entry__ as entry_module
    sent = exchanged(entry_module.queries()["v8_attention"](spark, "/root/testdata/sf0.1"))  # more events than vectors
    assert any(key == "narration_id" for _, key in sent)
    assert not [columns for columns, _ in sent if "embedding" in columns or "vector" in columns or re.search(r"\bq#", columns)]
    steps = spark.sql("SELECT 'a' AS id, 1 AS k, true AS ok, CAST(array(1, 2) AS array<float>) AS v")
    asked = spark.sql("SELECT explode(array('a', 'b')) AS id, CAST(array(3, 4) AS array<float>) AS q")
    got = {r["id"]: (r["attended"], r["weights"]) for r in VX.attend(steps, "q", "v", "v", "ok", 2, "id", queries=asked).collect()}
    assert got == {"a": ([1, 2], [[1], [1]]), "b": ([0, 0], [[], []])}


def unbroadcast(spark, name):
    """The shuffles of a query whose planner broadcasts nothing by size, as where tables are large."""
    import __spark_entry__ as entry_module
    from conftest import SMALL
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return exchanged(entry_module.queries()[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_attention_sends_ids_where_vectors_are_not_broadcast(spark):
    sent = unbroadcast(spark, "v8_attention")
    whole = [columns for columns, _ in sent if re.search("embedding|vector|stored", columns)]
    assert len(whole) == 1 and "narration_id" not in whole[0]  # the table of vectors, once per tile
    assert [columns for columns, key in sent if key == "_tile" and "narration_id" in columns]


def test_attention_by_ids_meets_every_vector_in_any_number_of_blocks(spark):
    from tidemark.operators.attention import attend_rows
    rng = np.random.default_rng(5)
    stored = {i * 7 - 30: rng.normal(size=8).astype("float32") * (40 if i % 5 == 0 else 1) for i in range(40)}
    ids = [*stored, 1, None]  # 1 is unknown
    asks = [(None if e == 0 else f"e{e}", ids[rng.integers(40)], ids[rng.integers(42)]) for e in range(60) for _ in range(1 + e % 7)]
    asks = [(e, next(q for f, q, _ in asks if f == e), v) for e, _, v in asks] + [("lost", 1, ids[0]), ("blank", None, ids[0]), ("none", ids[0], None)]
    df = spark.createDataFrame(asks, "e string, query_id long, step_id long")
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in stored.items()], "id long, vector array<float>").union(
        spark.sql("SELECT CAST(NULL AS BIGINT), array(CAST(9 AS FLOAT))"))
    want = {}
    for e in {e for e, *_ in asks}:
        met = [(stored[q], stored[v]) for f, q, v in asks if f == e and q in stored and v in stored]
        out, top = np.zeros(8), [0.0, 0.0]
        for h in range(2):
            part = slice(4 * h, 4 * h + 4)
            s = np.array([float(np.dot(q[part].astype(float), v[part].astype(float))) / 2 for q, v in met])
            if len(s):
                w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
                out[part], top[h] = sum(x * v[part] for x, (_, v) in zip(w, met)), w.max()
        want[e] = [*out, *top]
    for options in ({}, {"block": 9, "most": 9 << 20}, {"block": 9, "most": 40 << 20}, {"block": 3}):  # one block, five twice, joins
        for entries in (None, [0, 7]):
            rows = attend_rows(df, vectors, 2, "e", entries, **options).collect()
            assert len(rows) == len(want)
            for r in rows:
                some = want[r["e"]][:8] if entries is None else [want[r["e"]][i] for i in entries]
                assert np.allclose([*r["attended"], *r["top_weight"]], [*some, *want[r["e"]][8:]], atol=1e-9), (options, entries, r)
    none = attend_rows(df, vectors.where("false"), 2, "e", [0, 7]).collect()
    assert len(none) == len(want) and all(r["attended"] == [0, 0] == r["top_weight"] for r in none)


def test_running_average_joins_only_the_entries_it_needs(spark):
    import __spark_entry__ as entry_module
    from conftest import SMALL
    plan = entry_module.queries()["w9_ema"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    stored = [re.sub(r"embedding#\d+\[\d+\]", "", line) for line in plan.splitlines() if "embedding" in line]
    assert stored and not [line for line in stored if "embedding" in line and not re.search(r"Relation|Filter", line)]
    assert not [columns for columns, key in unbroadcast(spark, "w9_ema") if "narration_id" in columns and "embedding" in columns]
