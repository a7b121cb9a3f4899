"""Temporal joins: history, anchors, next action, frames, clip bank (J1-J17)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timing import step_times, targets
from ..operators import checks, temporal as T
from ..operators.events import affected, matched, restrict, unmatched
from ..operators.report import delta_vs
from ..operators.audit import audit, same_order, same_timeline
from ..operators.splits import combination_counts, grouped_split
from ..operators.stats import event_counts
from ..operators.vectors import retrieval_top1
from . import views as V
from .registry import query, r6, sql6

# Absent rows and labels are -1 in results, as in the stored formats.
def no_row():
    return F.coalesce("row", F.lit(-1)).alias("row")


H = V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST)


@query("j1_history", H + f"""SELECT narration_id, k, {sql6('tau')} AS tau, valid, {sql6('used_time')} AS used_time,
  coalesce(row_id, -1) AS "row" FROM hist""")
def j1(spark, sf):
    h = V.history_rows(spark, sf)
    return h.select("narration_id", F.col("k").cast("long").alias("k"), r6("tau").alias("tau"), "valid",
                    r6("used_time").alias("used_time"), no_row())


@query("j2_history_untimed", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED) + f"""
SELECT narration_id, k, coalesce(CASE WHEN sta_cutoff >= 0 THEN row_id END, -1) AS "row",
  {sql6('CASE WHEN sta_cutoff >= 0 THEN t_end_s END')} AS used_time FROM picked""")
def j2(spark, sf):
    h = V.history_rows(spark, sf, tolerance=None, allow_negative_tau=True)
    return h.select("narration_id", F.col("k").cast("long").alias("k"), no_row(), r6("used_time").alias("used_time"))


EXACT = """exact AS (SELECT narration_id, event_id AS anchor_row FROM ev WHERE verb <= 2 AND sta_cutoff >= 0),
anch AS (SELECT h.narration_id, h.video_id, h.sta_cutoff, h.k, h.tau,
    h.valid OR (h.k = 16 AND x.anchor_row IS NOT NULL) AS valid,
    CASE WHEN h.k = 16 AND x.anchor_row IS NOT NULL THEN h.sta_cutoff ELSE h.used_time END AS used_time,
    CASE WHEN h.k = 16 AND x.anchor_row IS NOT NULL THEN x.anchor_row ELSE h.row_id END AS row_id,
    CASE WHEN h.k = 16 AND x.anchor_row IS NOT NULL THEN 'exact' WHEN h.valid THEN 'bank' END AS source
  FROM hist h LEFT JOIN exact x USING (narration_id))"""


@query("j3_exact_anchor", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST, EXACT) + f"""
SELECT narration_id, k, valid, source, coalesce(row_id, -1) AS "row", {sql6('used_time')} AS used_time FROM anch""")
def j3(spark, sf):
    h = V.history_rows(spark, sf, anchors=V.exact_clips(spark, sf))
    return h.select("narration_id", F.col("k").cast("long").alias("k"), "valid", "source", no_row(), r6("used_time").alias("used_time"))


@query("j4_present_clip", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST, EXACT) + """
SELECT a.narration_id, CASE WHEN x.anchor_row IS NOT NULL THEN 1 WHEN a.valid THEN 2 ELSE 0 END AS present_source,
  CASE WHEN x.anchor_row IS NOT NULL THEN x.anchor_row WHEN a.valid THEN a.row_id ELSE -1 END AS present_row
FROM anch a LEFT JOIN exact x USING (narration_id) WHERE a.k = 16""")
def j4(spark, sf):
    exact = V.exact_clips(spark, sf)
    p = T.present_clip(V.history_rows(spark, sf, anchors=exact), exact, V.STEPS)
    return p.select("narration_id", "present_source", F.coalesce("present_row", F.lit(-1)).alias("present_row"))


@query("j5_next_action", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST, V.SPLIT) + """,
steps AS (SELECT h.*, h.tau + 1800.0 - 1e-6 AS lo_key, s.subset FROM hist h JOIN split s USING (narration_id)),
nxt AS (SELECT s.narration_id, s.k, s.valid, s.tau, e.start, e.verb, e.noun FROM steps s
  ASOF LEFT JOIN split e ON s.video_id = e.video_id AND s.subset = e.subset AND s.lo_key <= e.start)
SELECT narration_id, k, CASE WHEN valid AND start <= tau + 10800.0 + 1e-6 THEN verb ELSE -1 END AS next_verb,
  CASE WHEN valid AND start <= tau + 10800.0 + 1e-6 THEN noun ELSE -1 END AS next_noun FROM nxt""".replace("\n,", ",", 1))
def j5(spark, sf):
    split = grouped_split(V.action_events(spark, sf))
    actions = T.Actions(split, 1800.0, 10800.0, ("subset",))
    labelled = T.history(split, V.bank(spark, sf), V.STEPS, V.STRIDE, actions=actions)
    return labelled.select("narration_id", F.col("k").cast("long").alias("k"),
                           *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("next_verb", "next_noun")])


WIN = """win AS (SELECT narration_id, video_id, greatest(0.0, sta_cutoff - 86400.0) AS lo, sta_cutoff AS hi FROM ev WHERE sta_cutoff >= 0),
tgt AS (SELECT *, CAST(i AS INTEGER) AS slot, lo + (i + 0.5) * (hi - lo) / 8 AS target FROM win, range(0, 8) g(i)),
dist AS (SELECT t.narration_id, t.slot, t.target, f.t_end_s AS pts FROM tgt t LEFT JOIN bank f
  ON f.video_id = t.video_id AND f.t_end_s >= t.lo AND f.t_end_s <= t.hi)"""


@query("j6_nearest_frames", V.cte(V.EV, V.BANK, WIN) + f"""
SELECT narration_id, slot, {sql6('arg_min(pts, abs(target - pts) * 1e6 + pts * 1e-9)')} AS frame_time FROM dist GROUP BY narration_id, slot""")
def j6(spark, sf):
    from ..operators.events import with_observation
    w = with_observation(V.action_events(spark, sf), "STA", V.DAY).select("narration_id", "video_id", "observation")
    picks = T.nearest_frames(w, V.frames(spark, sf), 8, width=V.STRIDE * 4)
    return picks.select("narration_id", "slot", r6("frame_time").alias("frame_time"))


CLIPS = """vend AS (SELECT video_id, greatest(max(start), max(stop)) AS last_t FROM ev GROUP BY video_id),
spine AS (SELECT video_id, CAST(w AS BIGINT) AS w, greatest(0.0, w * 86400.0 - 172800.0) AS lo, w * 86400.0 AS hi
  FROM vend, range(1, 12) g(w) WHERE w * 86400.0 <= last_t + 86400.0),
inside AS (SELECT s.video_id, s.w, s.lo, s.hi, f.t_end_s AS pts, abs(s.lo + (s.hi - s.lo) * (15.5 / 16) - f.t_end_s) AS off
  FROM spine s LEFT JOIN bank f ON f.video_id = s.video_id AND f.t_end_s >= s.lo AND f.t_end_s <= s.hi)"""


@query("j7_clip_bank", V.cte(V.EV, V.BANK, CLIPS) + f"""
SELECT video_id, w - 1 AS "row", {sql6('any_value(hi)')} AS window_end, count(pts) AS frames,
  {sql6('max(pts)')} AS last_pts, {sql6('coalesce(arg_min(pts, off), -1.0)')} AS t_end_s
FROM inside GROUP BY video_id, w""")
def j7(spark, sf):
    ends = V.action_events(spark, sf).select("video_id", F.col("stop").alias("min_end"))
    b = T.clip_bank(V.frames(spark, sf), 2 * V.DAY, V.DAY, ends)
    return b.select("video_id", "row", r6("window_end").alias("window_end"), "frames", r6("last_pts").alias("last_pts"),
                    r6("t_end_s").alias("t_end_s"))


@query("j8_matched_only", V.cte(V.EV) + f"""
SELECT narration_id, quality FROM ev JOIN labels l ON l.doc_id = ev.event_id""")
def j8(spark, sf):
    features = V.table(spark, sf, "labels").select(F.concat(F.lit("n"), F.col("doc_id")).alias("narration_id"), "quality")
    return matched(V.action_events(spark, sf), features).select("narration_id", "quality")


@query("j8_unmatched_events", V.cte(V.EV) + "SELECT narration_id FROM ev WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def j8_unmatched(spark, sf):
    features = V.table(spark, sf, "labels").select(F.concat(F.lit("n"), F.col("doc_id")).alias("narration_id"))
    return unmatched(V.action_events(spark, sf), features).select("narration_id")


@query("j9_missing_videos", V.cte(V.EV) + """
SELECT DISTINCT video_id FROM ev WHERE video_id NOT IN (SELECT video_id FROM ev WHERE verb = 2)""")
def j9(spark, sf):
    ev = V.action_events(spark, sf)
    return checks.missing_keys(ev, ev.where("verb = 2"), "video_id")


HEALTH = """health AS (SELECT video_id, CASE WHEN count(*) FILTER (WHERE verb = 4) >= 4 THEN 'failed' ELSE 'ok' END AS status
  FROM ev GROUP BY video_id HAVING count(*) FILTER (WHERE verb = 2) > 0)"""


def health(spark, sf):
    """Video health: many error events mean failed; videos without a purchase were not found."""
    return (V.action_events(spark, sf).groupBy("video_id")
            .agg(F.count_if(F.col("verb") == 4).alias("e"), F.count_if(F.col("verb") == 2).alias("p")).where("p > 0")
            .select("video_id", F.when(F.col("e") >= 4, "failed").otherwise("ok").alias("status")))


@query("j10_affected_events", V.cte(V.EV, HEALTH) + """
SELECT narration_id FROM ev WHERE video_id IN (SELECT video_id FROM health WHERE status <> 'ok')
  OR video_id NOT IN (SELECT video_id FROM health)""")
def j10(spark, sf):
    ev, h = V.action_events(spark, sf), health(spark, sf)
    bad = h.where("status <> 'ok'").select("video_id").unionByName(checks.missing_keys(ev, h, "video_id"))
    return affected(ev, bad).select("narration_id")


@query("j11_chosen_events", V.cte(V.EV) + """SELECT narration_id FROM ev
WHERE participant_id IN (SELECT concat('P', lpad(CAST(c_custkey AS VARCHAR), 5, '0')) FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j11(spark, sf):
    chosen = (V.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
              .select(F.concat(F.lit("P"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("participant_id")))
    return restrict(V.action_events(spark, sf), chosen, "participant_id").select("narration_id")


@query("j12_audit", V.cte(V.EV) + """,
legacy AS (SELECT narration_id, video_id, verb, CASE WHEN verb = 1 THEN noun + 1 ELSE noun END AS noun, value < 50 AS on_disk
  FROM ev WHERE verb <> 4 UNION ALL SELECT narration_id, video_id, verb, noun, true FROM ev WHERE noun = 3 AND verb = 0
  UNION ALL SELECT concat('x', event_id), video_id, verb, noun, true FROM ev WHERE noun = 5),
per AS (SELECT narration_id, count(*) AS n FROM legacy GROUP BY 1)
SELECT (SELECT count(*) FROM legacy) AS "rows", (SELECT count(*) FROM per) AS unique_events, (SELECT count(*) FROM ev) AS annotation_events,
  (SELECT count(*) FROM per WHERE narration_id IN (SELECT narration_id FROM ev)) AS covered_events,
  (SELECT count(*) FROM ev WHERE narration_id NOT IN (SELECT narration_id FROM per)) AS missing_events,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM per) AS duplicate_rows,
  (SELECT count(*) FROM legacy WHERE narration_id NOT IN (SELECT narration_id FROM ev)) AS unknown_rows,
  (SELECT count(*) FROM legacy l JOIN ev e USING (narration_id) WHERE l.video_id <> e.video_id OR l.verb <> e.verb OR l.noun <> e.noun) AS mismatched_rows,
  (SELECT count(*) FROM legacy WHERE NOT on_disk) AS missing_files""".replace("\n,", ",", 1))
def j12(spark, sf):
    ev = V.action_events(spark, sf)
    on_disk = (F.col("value") < 50).alias("on_disk")
    cols = ["narration_id", "video_id", "verb", "noun"]
    legacy = (ev.where("verb <> 4").select("narration_id", "video_id", "verb",
                                           F.when(F.col("verb") == 1, F.col("noun") + 1).otherwise(F.col("noun")).alias("noun"), on_disk)
              .unionByName(ev.where("noun = 3 AND verb = 0").select(*cols, F.lit(True).alias("on_disk")))
              .unionByName(ev.where("noun = 5").select(F.concat(F.lit("x"), F.col("event_id")).alias("narration_id"),
                                                       "video_id", "verb", "noun", F.lit(True).alias("on_disk"))))
    return audit(legacy, ev, "narration_id", ["video_id", "verb", "noun"], "on_disk")


@query("j13_same_order", V.cte(V.EV) + """,
a AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM ev),
b AS (SELECT *, row_number() OVER (ORDER BY video_id, start, event_id) - 1 AS pos FROM ev)
SELECT 'order' AS "check", CAST(a.pos AS VARCHAR) AS id FROM a JOIN b USING (pos) WHERE a.narration_id <> b.narration_id""".replace("\n,", ",", 1))
def j13(spark, sf):
    from ..operators.sampling import assign_rows
    ev = V.action_events(spark, sf).select("event_id", "narration_id", "video_id", "start", "verb", "noun")
    a, b = assign_rows(ev, ["event_id"], "position"), assign_rows(ev, ["video_id", "start", "event_id"], "position")
    return same_order(a, b, ["narration_id"], ["position"]).select("check", "id")


@query("j14_same_timeline", V.cte(V.EV) + f"""
SELECT 'timeline' AS "check", video_id AS id, count(*) AS n FROM ev WHERE verb = 4 GROUP BY video_id""")
def j14(spark, sf):
    ev = V.action_events(spark, sf).select("video_id", F.col("start").alias("t_end_s"), "verb")
    return same_timeline(ev, ev.where("verb <> 4")).groupBy("check", "id").agg(F.count(F.lit(1)).alias("n"))


@query("j15_seed_delta", V.cte(V.RUNS) + f"""SELECT r.configuration, r.seed, {sql6('r.score - f.score')} AS delta
FROM runs r JOIN runs f ON f.seed = r.seed AND f.configuration = 'A'""")
def j15(spark, sf):
    d = delta_vs(V.runs(spark, sf), "A", "seed", "score")
    return d.select("configuration", "seed", r6("delta").alias("delta"))


POOL = """sizes AS (SELECT participant_id, count(*) AS n FROM ev GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY n, participant_id) - 1 AS pos, count(*) OVER () AS parts FROM sizes),
bounds AS (SELECT max(n) FILTER (WHERE pos = floor(0.25 * (parts - 1))) AS lo, max(n) FILTER (WHERE pos = floor(0.75 * (parts - 1))) AS hi FROM ranked),
pool AS (SELECT participant_id AS p, n FROM sizes, bounds WHERE n BETWEEN lo AND hi)"""
COMBOS = """combos AS (
  SELECT [a.p, b.p] AS names, a.n + b.n AS n FROM pool a JOIN pool b ON a.p < b.p
  UNION ALL SELECT [a.p, b.p, c.p], a.n + b.n + c.n FROM pool a JOIN pool b ON a.p < b.p JOIN pool c ON b.p < c.p),
rated AS (SELECT names, n, abs(n / (SELECT count(*) FROM ev) - {target}) AS distance FROM combos)"""


@query("j16_combinations", V.cte(V.EV, POOL, COMBOS.format(target="0.02")) + """
SELECT len(names) AS members, distance > 0.005 AS outside, count(*) AS combinations, CAST(sum(n) AS BIGINT) AS events
FROM rated GROUP BY 1, 2""")
def j16(spark, sf):
    return combination_counts(V.action_events(spark, sf), 0.02, band=0.005)


UNIT = """k AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
q AS (SELECT a.vec_id AS id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] + 0.8 * z[2]) AS raw
  FROM embeddings a JOIN embeddings b ON b.vec_id = ((a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))),
qu AS (SELECT id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS u FROM q)"""


@query("j17_retrieval", V.cte(UNIT) + f""",
best AS (SELECT qu.id, arg_max(k.id, list_dot_product(qu.u, k.u)) AS hit FROM qu, k GROUP BY qu.id)
SELECT {sql6('avg(CASE WHEN id = hit THEN 1.0 ELSE 0.0 END)')} AS top1, {sql6('1.0 / count(*)')} AS chance, count(*) AS n FROM best""".replace("\n,", ",", 1))
def j17(spark, sf):
    keys = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    n = keys.agg(F.count(F.lit(1)).alias("n"))
    other = keys.select(F.col("id").alias("o"), F.col("vector").alias("w"))
    noisy = (V.with_scalar(keys, n).withColumn("o", (F.col("id") * 7 + 3) % F.col("n")).join(other, "o")
             .select("id", F.zip_with("vector", "w", lambda a, b: a + 0.8 * b).alias("vector")))
    r = retrieval_top1(noisy, keys)
    return r.select(r6("top1").alias("top1"), r6("chance").alias("chance"), "n")


@query("f6_step_grid", V.cte(V.EV, V.PROBES) + f"""SELECT p.narration_id, k, {sql6('tau')} AS step_time,
  {sql6('start + (k - 0.5) * (stop - start) / 16')} AS target FROM probes p JOIN ev USING (narration_id)""")
def f6(spark, sf):
    """Every event's grid of history times and the middles of as many bins of its action."""
    ev = V.action_events(spark, sf)
    grid = F.arrays_zip(step_times("sta_cutoff", V.STEPS, V.STRIDE).alias("step"), targets("start", "stop", V.STEPS).alias("target"))
    rows = ev.select("narration_id", F.posexplode(grid).alias("k", "g"))
    return rows.select("narration_id", (F.col("k") + 1).cast("long").alias("k"), r6("g.step").alias("step_time"), r6("g.target").alias("target"))
