"""Projections, subsets, splits and integrity gates (P, D, I, K3, U0)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse_seconds
from ..operators import checks as C, events as E, splits as SP, temporal as T
from . import views as V
from .registry import query, r6, sql6
from .temporal_queries import COMBOS, POOL


@query("flagship_validation_history", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST, V.SPLIT) + """,
per AS (SELECT narration_id, count(*) FILTER (WHERE valid) AS steps FROM hist GROUP BY 1)
SELECT subset, count(*) AS events, CAST(sum(steps) AS BIGINT) AS valid_steps, count(*) FILTER (WHERE steps = 0) AS use_prior
FROM split JOIN per USING (narration_id) GROUP BY subset""".replace("\n,", ",", 1))
def flagship(spark, sf):
    split = SP.grouped_split(V.action_events(spark, sf))
    steps = T.history(split, V.bank(spark, sf), V.STEPS, V.STRIDE, keep=("subset",))
    per = steps.groupBy("narration_id", "subset").agg(F.count_if("valid").alias("steps"))
    return per.groupBy("subset").agg(F.count(F.lit(1)).alias("events"), F.sum("steps").alias("valid_steps"),
                                     F.count_if(F.col("steps") == 0).alias("use_prior"))


@query("p1_clock_times", f"""SELECT event_id, {sql6('(hour(ts) * 60 + minute(ts)) * 60 + microsecond(ts) / 1e6')} AS clock_s, {sql6('value')} AS plain_s FROM events""")
def p1(spark, sf):
    ev = V.table(spark, sf, "events")
    clock = parse_seconds(F.date_format("ts", "HH:mm:ss.SSSSSS"))
    return ev.select("event_id", r6(clock).alias("clock_s"), r6(parse_seconds(F.col("value").cast("string"))).alias("plain_s"))


@query("p2_cutoffs", V.cte(V.EV) + f"""SELECT narration_id, {sql6('least(sta_cutoff, start - 3600.0000004)')} AS sta_cutoff FROM ev""")
def p2(spark, sf):
    ev = V.action_events(spark, sf).drop("sta_cutoff").withColumn("given", F.col("start") - 3600.0000004)
    return E.with_cutoff(ev, V.GAP, "given").select("narration_id", r6("sta_cutoff").alias("sta_cutoff"))


@query("p3_observation_windows", V.cte(V.EV) + f"""SELECT narration_id, 'AR' AS task, {sql6('start')} AS win_start, {sql6('stop')} AS win_end, false AS inclusive_end, false AS empty FROM ev
UNION ALL SELECT narration_id, 'STA', {sql6('greatest(0.0, sta_cutoff - 18000.0) * CAST(sta_cutoff >= 0 AS INTEGER)')}, {sql6('sta_cutoff')}, true, sta_cutoff < 0 FROM ev""")
def p3(spark, sf):
    m = E.manifest_rows(V.action_events(spark, sf), 18000.0)
    return m.select("narration_id", "task", r6("observation.start").alias("win_start"), r6("observation.end").alias("win_end"),
                    "observation.inclusive_end", "observation.empty")


def tampered(spark, sf):
    """Events with broken rows of several kinds."""
    return V.action_events(spark, sf).select(
        F.when(F.col("noun") == 1, F.lit(" ")).otherwise(F.col("narration_id")).alias("narration_id"),
        F.when(F.col("noun") == 2, F.lit("")).otherwise(F.col("participant_id")).alias("participant_id"), "video_id",
        F.when(F.col("noun") == 3, -F.col("start") - 1).otherwise(F.col("start")).alias("start"),
        F.when(F.col("noun") == 4, F.col("start")).otherwise(F.col("stop")).alias("stop"), "sta_cutoff",
        F.when(F.col("noun") == 5, F.lit(None)).when(F.col("noun") == 6, 97).otherwise(F.col("verb")).alias("verb"),
        F.when(F.col("noun") == 7, -1).otherwise(F.col("noun")).alias("noun"))


TAMPERED = """t AS (SELECT CASE WHEN noun = 1 THEN ' ' ELSE narration_id END AS narration_id, CASE WHEN noun = 2 THEN '' ELSE participant_id END AS participant_id,
  video_id, CASE WHEN noun = 3 THEN -start - 1 ELSE start END AS start, CASE WHEN noun = 4 THEN start ELSE stop END AS stop, sta_cutoff,
  CASE WHEN noun = 5 THEN NULL WHEN noun = 6 THEN 97 ELSE verb END AS verb, CASE WHEN noun = 7 THEN -1 ELSE noun END AS noun FROM ev)"""


@query("p4_event_violations", V.cte(V.EV, TAMPERED) + """SELECT "check", id, count(*) AS n FROM (
  SELECT 'empty_id' AS "check", narration_id AS id FROM t WHERE trim(narration_id) = ''
  UNION ALL SELECT 'empty_participant', narration_id FROM t WHERE trim(participant_id) = ''
  UNION ALL SELECT 'bad_interval', narration_id FROM t WHERE NOT (start >= 0 AND stop > start)
  UNION ALL SELECT 'bad_verb', narration_id FROM t WHERE verb IS NULL OR verb NOT BETWEEN 0 AND 96
  UNION ALL SELECT 'bad_noun', narration_id FROM t WHERE noun NOT BETWEEN 0 AND 299) GROUP BY 1, 2""")
def p4(spark, sf):
    v = C.check_events(tampered(spark, sf))
    return v.groupBy("check", "id").agg(F.count(F.lit(1)).alias("n"))


@query("p5_manifest_violations", V.cte(V.EV) + """SELECT narration_id AS id, "check" FROM (
  SELECT narration_id, CASE WHEN verb = 0 THEN 'bad_cutoff' WHEN verb = 1 THEN 'sta_window_end' WHEN verb = 2 AND sta_cutoff >= 0 THEN 'sta_history_window'
    WHEN verb = 2 THEN 'sta_empty_window' WHEN verb = 3 THEN 'bad_task' END AS "check", noun FROM ev)
  WHERE noun < 4 AND "check" IS NOT NULL
UNION ALL SELECT narration_id, 'sta_window_end' FROM ev WHERE verb = 0 AND noun < 4
UNION ALL SELECT narration_id, 'sta_empty_window' FROM ev WHERE verb = 1 AND noun < 4 AND sta_cutoff < 0
UNION ALL SELECT narration_id, 'sta_empty_window' FROM ev WHERE verb = 0 AND noun < 4 AND sta_cutoff + 0.5 < 0""")
def p5(spark, sf):
    ev = V.action_events(spark, sf)
    m = E.with_observation(ev, "STA", 18000.0)
    w, bad = F.col("observation"), F.col("noun") < 4
    end = F.when(bad & (F.col("verb") == 1), w["end"] - 1).otherwise(w["end"])
    start = F.when(bad & (F.col("verb") == 2), w["end"] + 10).otherwise(w["start"])
    m = m.withColumn("observation", F.struct(start.alias("start"), end.alias("end"), w["inclusive_end"].alias("inclusive_end"), w["empty"].alias("empty")))
    m = m.withColumn("sta_cutoff", F.when(bad & (F.col("verb") == 0), F.col("sta_cutoff") + 0.5).otherwise(F.col("sta_cutoff")))
    m = m.withColumn("task", F.when(bad & (F.col("verb") == 3), F.lit("XX")).otherwise(F.col("task")))
    return E.validate_manifest(m, V.GAP).select("id", "check")


LATEST = """held AS (SELECT 'P00003' AS participant_id UNION ALL SELECT 'P00007'),
vn AS (SELECT participant_id, video_id, CAST(split_part(video_id, '_', 2) AS INTEGER) AS number, count(*) AS n FROM ev
  WHERE participant_id NOT IN (SELECT participant_id FROM held) GROUP BY 1, 2, 3),
taken AS (SELECT *, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY participant_id) AS total
  FROM vn WINDOW w AS (PARTITION BY participant_id ORDER BY number DESC, video_id DESC)),
latest AS (SELECT * FROM taken WHERE before + n < total AND before < 0.08 * total AND before + n <= 0.15 * total),
hyb AS (SELECT ev.*, CASE WHEN participant_id IN (SELECT participant_id FROM held) THEN 'val_unseen'
  WHEN video_id IN (SELECT video_id FROM latest) THEN 'val_seen' ELSE 'train' END AS subset FROM ev)"""


def given_split(spark, sf):
    return SP.hybrid_split(V.action_events(spark, sf), unseen=["P00003", "P00007"])


@query("p6_subset_tags", V.cte(V.EV, LATEST) + "SELECT narration_id, subset FROM hyb")
def p6(spark, sf):
    return given_split(spark, sf).select("narration_id", "subset")


@query("p7_subset_masks", V.cte(V.EV, LATEST) + """SELECT narration_id, 'all' AS mask FROM hyb UNION ALL SELECT narration_id, 'unseen' FROM hyb WHERE subset = 'val_unseen'
UNION ALL SELECT narration_id, 'seen' FROM hyb WHERE subset = 'val_seen' UNION ALL SELECT narration_id, 'opening' FROM hyb WHERE start < 43200""")
def p7(spark, sf):
    s = given_split(spark, sf)
    m = E.with_masks(s.withColumnRenamed("subset", "side"), {"unseen": F.col("side") == "val_unseen", "seen": F.col("side") == "val_seen",
                                                             "opening": F.col("start") < 43200})
    return m.select("narration_id", F.col("subset").alias("mask"))


@query("p8_sample_violations", V.cte(V.EV) + """SELECT narration_id AS id, 'sta_leak' AS "check" FROM ev WHERE verb = 1 AND sta_cutoff >= 0
UNION ALL SELECT narration_id, 'prior_flag' FROM ev WHERE verb = 2
UNION ALL SELECT narration_id, 'array_length' FROM ev WHERE verb = 3
UNION ALL SELECT narration_id, 'bad_frame_time' FROM ev WHERE verb = 4 AND sta_cutoff >= 0""")
def p8(spark, sf):
    m = E.with_observation(V.action_events(spark, sf), "STA", 18000.0)
    verb, end = F.col("verb"), F.col("observation.end")
    off = F.when(verb == 1, end + 1).when(verb == 4, F.col("observation.start") - 1).otherwise(end)
    seen = F.col("sta_cutoff") >= 0
    times = F.when(seen, F.array(end, off)).otherwise(F.array(F.lit(float("nan")), F.lit(float("nan"))))
    mask = F.array(seen, seen)
    s = m.withColumn("frame_times", times).withColumn("valid_mask", F.when(verb == 3, F.array_append(mask, F.lit(False))).otherwise(mask)) \
        .withColumn("use_prior", F.when(verb == 2, seen).otherwise(~seen))
    return C.check_samples(s, V.GAP).select("id", "check")


@query("p10_first_videos", V.cte(V.EV, V.SPLIT) + """SELECT narration_id FROM (SELECT narration_id, dense_rank() OVER (PARTITION BY subset ORDER BY video_id) AS r FROM split) WHERE r <= 40""")
def p10(spark, sf):
    return E.limit_videos(SP.grouped_split(V.action_events(spark, sf)), 40, ["subset"]).select("narration_id")


@query("d1_grouped_split", V.cte(V.EV, V.SPLIT) + "SELECT narration_id, video_id, subset FROM split")
def d1(spark, sf):
    return SP.grouped_split(V.action_events(spark, sf)).select("narration_id", "video_id", "subset")


@query("d3_split_halves", V.cte(V.EV) + """SELECT narration_id, CASE WHEN r <= n // 2 THEN 'A' ELSE 'B' END AS half FROM ev JOIN (
  SELECT video_id, row_number() OVER (ORDER BY md5(concat('0:', video_id))) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT video_id FROM ev)) USING (video_id)""")
def d3(spark, sf):
    return SP.split_halves(V.action_events(spark, sf)).select("narration_id", "half")


BEST = """chosen AS (SELECT unnest(names) AS participant_id FROM (SELECT names FROM (SELECT r.names, r.n, r.distance, r.distance > {band} AS outside,
  CASE WHEN r.distance > {band} THEN 0 ELSE (SELECT count(DISTINCT verb) + count(DISTINCT noun) FROM ev WHERE list_contains(r.names, participant_id)) END AS coverage
  FROM rated r) ORDER BY outside, coverage DESC, distance, names LIMIT 1))"""


@query("k3_best_combination", V.cte(V.EV, POOL, COMBOS.format(target="0.02"), """classes AS (SELECT participant_id AS p, list(DISTINCT verb) AS verbs, list(DISTINCT noun) AS nouns FROM ev GROUP BY 1),
covered AS (SELECT r.names, r.n, r.distance, len(list_distinct(flatten(list(c.verbs)))) + len(list_distinct(flatten(list(c.nouns)))) AS coverage
  FROM (SELECT *, unnest(names) AS p FROM rated WHERE distance <= 0.005) r JOIN classes c USING (p) GROUP BY 1, 2, 3),
scored AS (SELECT names, n, distance, false AS outside, coverage FROM covered UNION ALL SELECT names, n, distance, true, 0 FROM rated WHERE distance > 0.005)""") + f"""
SELECT array_to_string(names, ',') AS names, n, {sql6('distance')} AS distance, outside, coverage FROM scored ORDER BY outside, coverage DESC, distance, names LIMIT 1""")
def k3(spark, sf):
    best = SP.best_combination(V.action_events(spark, sf), 0.02, band=0.005)
    return best.select(F.array_join("names", ",").alias("names"), "n", r6("distance").alias("distance"), "outside",
                       F.col("coverage").cast("long").alias("coverage"))


HYBRID = """chosen AS (SELECT unnest(names) AS participant_id FROM (SELECT names FROM rated ORDER BY distance, names LIMIT 1)),
vn AS (SELECT participant_id, video_id, CAST(split_part(video_id, '_', 2) AS INTEGER) AS number, count(*) AS n FROM ev
  WHERE participant_id NOT IN (SELECT participant_id FROM chosen) GROUP BY 1, 2, 3),
taken AS (SELECT *, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY participant_id) AS total
  FROM vn WINDOW w AS (PARTITION BY participant_id ORDER BY number DESC, video_id DESC)),
latest AS (SELECT * FROM taken WHERE before + n < total AND before < 0.08 * total AND before + n <= 0.15 * total)"""


@query("d2_hybrid_split", V.cte(V.EV, POOL, COMBOS.format(target="0.06"), HYBRID) + """SELECT narration_id, CASE WHEN participant_id IN (SELECT participant_id FROM chosen) THEN 'val_unseen'
  WHEN video_id IN (SELECT video_id FROM latest) THEN 'val_seen' ELSE 'train' END AS subset FROM ev""")
def d2(spark, sf):
    return SP.hybrid_split(V.action_events(spark, sf)).select("narration_id", "subset")


@query("d4_unknown_participants", V.cte(V.EV) + """SELECT DISTINCT concat('P', lpad(CAST(c_custkey AS VARCHAR), 5, '0')) AS participant_id FROM customer
WHERE concat('P', lpad(CAST(c_custkey AS VARCHAR), 5, '0')) NOT IN (SELECT participant_id FROM ev)""")
def d4(spark, sf):
    asked = V.table(spark, sf, "customer").select(F.concat(F.lit("P"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("participant_id"))
    return C.missing_keys(asked, V.action_events(spark, sf), "participant_id")


@query("i1_duplicate_keys", V.cte(V.EV) + """SELECT concat(participant_id, ':', noun) AS id, concat('count ', count(*)) AS detail FROM ev GROUP BY participant_id, noun HAVING count(*) > 1""")
def i1(spark, sf):
    ev = V.action_events(spark, sf).select(F.concat_ws(":", "participant_id", "noun").alias("key"))
    return C.check_unique(ev, "key").select("id", "detail")


@query("i2_split_violations", V.cte(V.EV) + """SELECT 'video_on_both_sides' AS "check", video_id AS id FROM ev GROUP BY video_id HAVING count(DISTINCT verb = 0) = 2
UNION ALL SELECT DISTINCT 'unseen_participant_in_train', participant_id FROM ev WHERE verb <> 0 AND participant_id IN ('P00003', 'P00007')""")
def i2(spark, sf):
    by_row = V.action_events(spark, sf).withColumn("subset", F.when(F.col("verb") == 0, "val").otherwise("train"))
    unseen = by_row.where(F.col("participant_id").isin("P00003", "P00007")).select("participant_id").distinct()
    return C.check_disjoint(by_row, unseen).select("check", "id")


@query("i3_overlapping_ids", V.cte(V.EV) + "SELECT narration_id AS id FROM ev JOIN (SELECT DISTINCT concat('n', o_orderkey) AS narration_id FROM orders) USING (narration_id)")
def i3(spark, sf):
    test = V.table(spark, sf, "orders").select(F.concat(F.lit("n"), F.col("o_orderkey")).alias("narration_id"))
    return C.check_overlap(V.action_events(spark, sf), test, "narration_id").select("id")


@query("i4_unparsable_times", "SELECT event_id AS id FROM events WHERE floor(value) >= 60")
def i4(spark, sf):
    clock = F.concat_ws(":", F.hour("ts"), F.floor("value"), F.second("ts"))  # minutes run past 59
    return V.table(spark, sf, "events").where(parse_seconds(clock).isNull()).select(F.col("event_id").alias("id"))


BROKEN = """idx AS (SELECT narration_id, CASE WHEN f.row_id % 1000 IS NULL THEN 0 ELSE f.row_id END AS row_id,
    CASE WHEN e.verb = 1 AND e.sta_cutoff >= 0 THEN e.start ELSE f.sta_clip_end_s END AS sta_clip_end_s,
    CASE WHEN e.verb = 2 THEN NOT f.use_prior ELSE f.use_prior END AS use_prior, e.sta_cutoff, e.verb
  FROM feat f JOIN ev e USING (narration_id) WHERE e.verb <> 4)"""


@query("i5_feature_index_violations", V.cte(V.EV, V.BANK, V.FEAT, BROKEN) + """
SELECT 'late_clip' AS "check", narration_id AS id FROM idx WHERE sta_cutoff >= 0 AND NOT use_prior AND (sta_clip_end_s > sta_cutoff + 1e-6 OR sta_clip_end_s < 0)
UNION ALL SELECT 'prior_flag_wrong', narration_id FROM idx WHERE sta_cutoff < 0 AND (NOT use_prior OR sta_clip_end_s >= 0)
UNION ALL SELECT 'history_marked_prior', narration_id FROM idx WHERE sta_cutoff >= 0 AND use_prior
UNION ALL SELECT 'event_without_features', narration_id FROM ev WHERE verb = 4
UNION ALL SELECT 'unknown_event', concat('x', narration_id) FROM ev WHERE verb = 3 AND noun = 0
UNION ALL SELECT 'duplicate_row', CAST(event_id AS VARCHAR) FROM ev WHERE verb = 3 AND noun = 0""")
def i5(spark, sf):
    ev, f = V.action_events(spark, sf), V.event_features(spark, sf)
    j = ev.where("verb <> 4").select("narration_id", "verb", "noun", "start", "sta_cutoff").join(f, "narration_id")
    idx = j.select("narration_id", "row", "verb", "noun",
                   F.when((F.col("verb") == 1) & (F.col("sta_cutoff") >= 0), F.col("start")).otherwise(F.col("sta_clip_end_s")).alias("sta_clip_end_s"),
                   F.when(F.col("verb") == 2, ~F.col("use_prior")).otherwise(F.col("use_prior")).alias("use_prior"))
    strange = F.when((F.col("verb") == 3) & (F.col("noun") == 0), F.concat(F.lit("x"), F.col("narration_id")))
    idx = idx.withColumn("narration_id", F.explode(F.array_compact(F.array("narration_id", strange))))
    return C.check_event_features(idx, ev).select("check", "id")


@query("i6_prediction_violations", V.cte(V.EV) + """SELECT 'missing_prediction' AS "check", narration_id AS id FROM ev WHERE verb = 0
UNION ALL SELECT 'unexpected_prediction', concat('x', narration_id) FROM ev WHERE verb = 1 AND noun = 0
UNION ALL SELECT 'duplicate_prediction', narration_id FROM ev WHERE verb = 2
UNION ALL SELECT 'bad_verb_output', narration_id FROM ev WHERE verb = 3 UNION ALL SELECT 'bad_noun_output', narration_id FROM ev WHERE verb = 4""")
def i6(spark, sf):
    s = V.scored(spark, sf)
    verb = F.col("verb")
    p = s.where("verb <> 0").select(
        "narration_id", "verb", "noun", F.when(verb == 3, F.slice("verb_output", 1, 4)).otherwise(F.col("verb_output")).alias("verb_output"),
        F.when(verb == 4, F.transform("noun_output", lambda x, i: F.when(i == 2, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("noun_output")).alias("noun_output"))
    p = p.unionByName(p.where("verb = 2")).unionByName(
        p.where("verb = 1 AND noun = 0").withColumn("narration_id", F.concat(F.lit("x"), F.col("narration_id"))))
    return C.check_predictions(p, V.action_events(spark, sf), V.VERBS, V.NOUNS).select("check", "id")


@query("i7_manifest_windows", V.cte(V.EV) + """SELECT 'window_after_cutoff' AS "check", narration_id AS id FROM ev WHERE verb = 1
UNION ALL SELECT 'negative_cutoff_not_empty', narration_id FROM ev WHERE verb <> 1 AND noun < 10 AND sta_cutoff < 0""")
def i7(spark, sf):
    m = E.manifest_rows(V.action_events(spark, sf), 18000.0)
    w = F.col("observation")
    m = m.withColumn("observation", F.struct(w["start"].alias("start"), F.when(F.col("verb") == 1, w["end"] + 1).otherwise(w["end"]).alias("end"),
                                             w["inclusive_end"].alias("inclusive_end"), (w["empty"] & (F.col("noun") >= 10)).alias("empty")))
    return C.check_manifest(m, V.GAP).select("check", "id")


@query("i8_late_history", V.cte(V.EV, V.BANK, V.PROBES, V.PICKED, V.HIST) + "SELECT narration_id AS id, count(*) AS n FROM hist WHERE used_time + 1800 > sta_cutoff + 1e-6 GROUP BY 1")
def i8(spark, sf):
    shifted = V.history_rows(spark, sf).withColumn("used_time", F.col("used_time") + 1800)
    return C.check_before_cutoff(shifted).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("i9_score_violations", """SELECT vec_id AS id, 'negative_probability' AS "check" FROM embeddings WHERE list_min(embedding[1:5]) < 0
UNION ALL SELECT vec_id, 'sum_not_one' FROM embeddings WHERE abs(list_sum(embedding[1:5]::DOUBLE[]) - 1) > 2e-5""")
def i9(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("narration_id"), F.slice("embedding", 1, 5).alias("scores"))
    return C.check_scores(e, "scores", 5, "probabilities").select(F.col("id").cast("long").alias("id"), "check")


@query("i10_vector_shapes", """SELECT 'vector_shape' AS "check", CAST(64 - label % 3 AS VARCHAR) AS id, count(*) AS n FROM embeddings GROUP BY 2
UNION ALL SELECT 'row_out_of_range', CAST(vec_id AS VARCHAR), 1 FROM embeddings WHERE vec_id >= 450""")
def i10(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.expr("slice(embedding, 1, 64 - label % 3)").alias("tokens"))
    v = C.check_vectors(e, "tokens", rows=450)
    count = F.coalesce(F.regexp_extract("detail", r"(\d+)", 1).try_cast("long"), F.lit(1))
    return v.select("check", "id", count.alias("n"))


@query("i11_version_mismatch", """SELECT 'source_rows' AS id, concat('found ', count(*), ' expected 0') AS detail FROM events WHERE true HAVING count(*) <> 0""")
def i11(spark, sf):
    meta = V.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("source_rows"), F.lit("linear-1").alias("scorer"))
    return C.check_versions(meta, {"source_rows": "0", "scorer": "linear-1"}).select("id", "detail")


@query("i12_coarse_bank", V.cte(V.EV) + f"""SELECT video_id AS id, round((max(start) - min(start)) / (count(*) - 1), 3) AS spacing FROM ev
GROUP BY video_id HAVING count(*) > 1 AND (max(start) - min(start)) / (count(*) - 1) > 43200 + 1e-9""")
def i12(spark, sf):
    v = C.check_stride(V.bank(spark, sf), 43200.0)
    return v.select("id", F.round(F.col("detail").cast("double"), 3).alias("spacing"))


@query("u0_union", V.cte(V.EV, V.SPLIT) + "SELECT narration_id, subset FROM split")
def u0(spark, sf):
    s = SP.grouped_split(V.action_events(spark, sf))
    parts = {name: s.where(F.col("subset") == name).drop("subset") for name in ("train", "val")}
    return C.union_named(**parts).select("narration_id", "subset")
