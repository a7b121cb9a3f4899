"""The driver tables seen as annotated action events, clips, features, scores and runs.

Each Spark view has a SQL twin (a CTE) in ``CTE`` for the oracles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.temporal import event_clip_ends, history
from ..session import with_scalar

GAP, STRIDE, STEPS = 3600.0, 21600.0, 16
VERBS, NOUNS = 5, 20
DAY = 86400.0
# Verb class of each event type.
VERB_OF = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _week_micros() -> Column:
    ts = F.col("ts")
    second = (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")
    days = F.pmod(F.dayofmonth(ts) - 1, F.lit(7)).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * F.lit(60_000_000).cast("long") + second


def action_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an interval in seconds from the start of their week (the video) and two labels."""
    who = F.concat(F.lit("P"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    week = F.floor((F.dayofmonth("ts") - 1) / 7) + 1
    verb = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in VERB_OF.items()])
    noun = F.get_json_object("props", "$.k").cast("int") % NOUNS
    us = F.col("us")
    return table(spark, sf, "events").withColumn("us", _week_micros()).select(
        "event_id", F.concat(F.lit("n"), F.col("event_id")).alias("narration_id"), who.alias("participant_id"),
        F.concat(who, F.lit("_"), F.lpad(week.cast("string"), 2, "0")).alias("video_id"),
        (us / 1e6).alias("start"), (us / 1e6 + F.col("value") + 0.001).alias("stop"),
        ((us - int(GAP * 1e6)) / 1e6).alias("sta_cutoff"), verb.alias("verb"), noun.alias("noun"), "value")


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Clip index: a clip ends where an event starts; ``row`` numbers the clips."""
    return action_events(spark, sf).select("video_id", F.col("start").alias("t_end_s"), F.col("event_id").alias("row"))


def with_vectors(df: DataFrame, spark: SparkSession, sf: str, row: str = "row", name: str = "vector") -> DataFrame:
    """Attach the stored vector of a row (vectors are shared round robin)."""
    e = table(spark, sf, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("_vectors"))
    keyed = with_scalar(df, n).withColumn("vec_id", F.col(row) % F.col("_vectors"))
    return keyed.join(e.select("vec_id", F.col("embedding").alias(name)), "vec_id").drop("vec_id", "_vectors")


def history_rows(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return history(action_events(spark, sf), bank(spark, sf), STEPS, STRIDE, **kw)


def event_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature index of the last day before each cutoff, built from the frames."""
    index = event_clip_ends(action_events(spark, sf), frames(spark, sf), DAY, width=4 * STRIDE)
    return index.select("narration_id", F.substring("narration_id", 2, 20).cast("long").alias("row"), "video_id", "sta_clip_end_s", "use_prior",
                        (~F.col("use_prior")).alias("has_clip"))


def exact_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an exactly extracted clip that ends at the cutoff: the first three verbs."""
    return action_events(spark, sf).select("narration_id", F.col("event_id").alias("row"), F.col("sta_cutoff").alias("sta_clip_end_s"),
                                           ((F.col("verb") <= 2) & (F.col("sta_cutoff") >= 0)).alias("has_clip"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events with verb and noun scores taken from their vector."""
    v = with_vectors(action_events(spark, sf), spark, sf, "event_id")
    return v.withColumn("verb_output", F.slice("vector", 1, VERBS)).withColumn(
        "noun_output", F.slice("vector", VERBS + 1, NOUNS)).drop("vector")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return action_events(spark, sf).select("video_id", F.col("start").alias("pts"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment results: configuration, seed and score."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("configuration"), F.col("l_linenumber").alias("seed"))
            .agg(F.avg("l_discount").alias("score"), F.avg("l_tax").alias("tail_score")))


EV = """ev AS (
  SELECT event_id, concat('n', event_id) AS narration_id,
    concat('P', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS participant_id,
    concat('P', lpad(CAST(user_id AS VARCHAR), 5, '0'), '_',
           lpad(CAST(1 + (day(ts) - 1) // 7 AS VARCHAR), 2, '0')) AS video_id,
    us / 1e6 AS start, us / 1e6 + value + 0.001 AS stop, (us - 3600000000) / 1e6 AS sta_cutoff,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
      WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS verb,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 20 AS noun, value
  FROM (SELECT *, (((day(ts) - 1) % 7 * 24 + hour(ts)) * 60 + minute(ts)) * 60000000
          + microsecond(ts) AS us FROM events))"""
BANK = "bank AS (SELECT video_id, start AS t_end_s, event_id AS row_id FROM ev)"
PROBES = """probes AS (SELECT narration_id, video_id, sta_cutoff, CAST(k AS BIGINT) AS k,
    sta_cutoff - (16 - k) * 21600.0 AS tau, sta_cutoff - (16 - k) * 21600.0 + 1e-6 AS key
  FROM ev, range(1, 17) g(k))"""
PICKED = """picked AS (SELECT p.*, b.t_end_s, b.row_id FROM probes p
  ASOF LEFT JOIN bank b ON p.video_id = b.video_id AND p.key >= b.t_end_s)"""
HIST = """hist AS (SELECT narration_id, video_id, sta_cutoff, k, tau, valid,
    CASE WHEN valid THEN t_end_s END AS used_time, CASE WHEN valid THEN row_id END AS row_id
  FROM (SELECT *, coalesce(sta_cutoff >= 0 AND tau >= 0 AND tau - t_end_s <= 21600.0 + 1e-6, false) AS valid
        FROM picked))"""
VEC = """vec AS (SELECT e.event_id, v.embedding::DOUBLE[] AS vector FROM ev e
  JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings))"""
# The frame nearest to the last of 16 targets of the day before the cutoff, the earlier of two; `bank` holds the frames.
FEAT = """near AS (SELECT e.event_id, b.t_end_s, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(greatest(0.0, e.sta_cutoff - 86400.0)
    + (e.sta_cutoff - greatest(0.0, e.sta_cutoff - 86400.0)) * 15.5 / 16 - b.t_end_s), b.t_end_s) AS r
  FROM ev e JOIN bank b ON b.video_id = e.video_id AND b.t_end_s BETWEEN greatest(0.0, e.sta_cutoff - 86400.0) AND e.sta_cutoff),
feat AS (SELECT e.narration_id, e.event_id AS row_id, e.video_id, e.sta_cutoff, coalesce(n.t_end_s, -1.0) AS sta_clip_end_s, n.event_id IS NULL AS use_prior
  FROM ev e LEFT JOIN near n ON n.event_id = e.event_id AND n.r = 1)"""
SPLIT = """vids AS (SELECT DISTINCT video_id FROM ev),
held AS (SELECT video_id FROM (SELECT video_id, row_number() OVER (ORDER BY md5(concat('42:', video_id))) AS r,
    count(*) OVER () AS n FROM vids) WHERE r <= greatest(1, least(n - 1, CAST(round_even(n * 0.2, 0) AS BIGINT)))),
split AS (SELECT ev.*, CASE WHEN video_id IN (SELECT video_id FROM held) THEN 'val' ELSE 'train' END AS subset FROM ev)"""
SMAX = """sm AS (SELECT e.*, v.vector[1:5] AS zv, v.vector[6:25] AS zn FROM ev e JOIN vec v USING (event_id)),
sp AS (SELECT *, list_transform(zv, lambda x: exp(x - list_max(zv))) AS ev_, list_transform(zn, lambda x: exp(x - list_max(zn))) AS en_ FROM sm),
pr AS (SELECT *, list_transform(ev_, lambda x: x / list_sum(ev_)) AS pv, list_transform(en_, lambda x: x / list_sum(en_)) AS pn FROM sp)"""
RUNS = """runs AS (SELECT l_returnflag AS configuration, l_linenumber AS seed, avg(l_discount) AS score,
  avg(l_tax) AS tail_score FROM lineitem GROUP BY 1, 2)"""


def cte(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
