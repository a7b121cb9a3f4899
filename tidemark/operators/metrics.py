"""Ranking metrics, calibration and prior fallback.

Hits are counted per class before anything is averaged, and subsets are expanded only on those
counts, so the shuffled data is bounded by classes and masks, not by events."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import joint_id
from .batches import grid_hits, ranker
from .checks import SUM_TOLERANCE

FIELDS = ("verb", "noun", "action")


def ranked(scored: DataFrame, kind: str = "logits", num_nouns: int = 300, k: int = 5, search: int = 10) -> DataFrame:
    """Add ``top_verbs``, ``top_nouns`` and ``top_actions``: the ``k`` best ids of each, best first."""
    r = scored.withColumn("_top", ranker(kind, k, search, num_nouns)("verb_output", "noun_output"))
    return r.select(*scored.columns, *[F.col(f"_top.{f}s").alias(f"top_{f}s") for f in FIELDS])


def rank_hits(scored: DataFrame, kind: str = "logits", num_nouns: int = 300, keep: Sequence[str] = (),
              k: int = 5, search: int = 10) -> DataFrame:
    """Per event and field: the true class, whether it ranks first and whether it is in the top ``k``.
    Expects ``verb``, ``noun``, ``verb_output`` and ``noun_output``."""
    rank = ranker(kind, k, search, num_nouns)
    ranked = _checked(scored, kind).select(*keep, F.col("verb").cast("long").alias("_yv"), F.col("noun").cast("long").alias("_yn"),
                           rank("verb_output", "noun_output").alias("_top"))
    truth = {"verb": F.col("_yv"), "noun": F.col("_yn"), "action": joint_id("_yv", "_yn", num_nouns)}
    tops = {f: F.col(f"_top.{f}s").cast("array<bigint>") for f in FIELDS}
    rows = [F.struct(F.lit(f).alias("field"), truth[f].alias("y"), (F.get(tops[f], F.lit(0)) == truth[f]).alias("hit1"),
                     F.array_contains(tops[f], truth[f]).alias("hit5")) for f in FIELDS]
    return ranked.select(*keep, F.explode(F.array(*rows)).alias("h")).select(*keep, "h.*")


def _checked(scored: DataFrame, kind: str) -> DataFrame:
    """The same rows; a row without labels, with labels outside the scores or with scores that are missing, not finite or (for
    probabilities) negative or not of sum one raises when it is reached. No pass of its own."""
    def scores_bad(c):
        v = F.col(c).cast("array<double>")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        if kind == "probabilities":
            total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
            bad = bad | F.exists(v, lambda x: x < 0) | (F.abs(total - 1) > SUM_TOLERANCE)
        return F.coalesce(bad, F.lit(True))

    def label_bad(c):
        y = F.col(c)
        return F.coalesce((y < 0) | (y >= F.size(f"{c}_output")), F.lit(True))

    out = scored
    for c in ("verb", "noun"):
        message = F.lit(f"{c}: a label or score is missing, not finite or out of range")
        # on the scores, which the ranking reads first
        kept = F.col(f"{c}_output")
        raised = F.raise_error(message).cast(scored.schema[f"{c}_output"].dataType)
        out = out.withColumn(f"{c}_output", F.when(scores_bad(f"{c}_output") | label_bad(c), raised).otherwise(kept))
    return out


def class_hits(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by, field, class)."""
    return hits.groupBy(*by, "field", "y").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit1").alias("n1"),
                                               F.count_if("hit5").alias("n5"))


def macro_recall(hits: DataFrame, class_col: str = "y", by: Sequence[str] = (), hit: str = "hit5") -> DataFrame:
    """Mean over classes present of the per-class share of hits, in percent."""
    per = hits.groupBy(*by, class_col).agg((F.count_if(hit) / F.count(F.lit(1))).alias("_r"))
    return per.groupBy(*by).agg((100 * F.avg("_r")).alias("macro_recall"), F.count(F.lit(1)).alias("classes"))


def _scores(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("events"), (100 * F.sum("n1") / F.sum("n")).alias("top1"),
                                   (100 * F.sum("n5") / F.sum("n")).alias("top5"),
                                   (100 * F.avg(F.col("n5") / F.col("n"))).alias("mt5r"))


def rank_metrics(scored: DataFrame, by: Sequence[str] = (), kind: str = "logits", num_nouns: int = 300) -> DataFrame:
    """Top-1, top-5 and class-mean top-5 recall per field (and ``by`` group), in percent."""
    return _scores(class_hits(rank_hits(scored, kind, num_nouns, by), by), [*by, "field"])


def _primary(task: str) -> tuple[str, str]:
    if task not in ("AR", "STA"):
        raise ValueError("task must be AR or STA")
    return ("action_top1", "top1") if task == "AR" else ("action_mt5r", "mt5r")


def _masked(scored: DataFrame, masks: dict[str, dict[str, Column] | Column], kind: str, num_nouns: int) -> DataFrame:
    flags = {}
    for name, m in masks.items():
        for f in FIELDS:
            flags[f"_{name}_{f}"] = m[f] if isinstance(m, dict) else m
    for c, expr in flags.items():
        scored = scored.withColumn(c, F.coalesce(expr, F.lit(False)))
    hits = rank_hits(scored, kind, num_nouns, list(flags))
    own = [F.struct(F.lit(name).alias("subset"), F.coalesce(*[F.when(F.col("field") == f, F.col(f"_{name}_{f}"))
                                                              for f in FIELDS]).alias("in")) for name in masks]
    hits = hits.withColumn("_in", F.transform(F.filter(F.array(*own), lambda s: s["in"]), lambda s: s["subset"]))
    counts = class_hits(hits, ["_in"])
    return (counts.withColumn("subset", F.explode("_in")).groupBy("subset", "field", "y")
            .agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n5")]))


def evaluate(scored: DataFrame, task: str, subsets: dict[str, Column] | None = None, kind: str = "logits",
             num_nouns: int = 300) -> DataFrame:
    """One row per (subset, field); ``primary_score`` is action top-1 (AR) or action class-mean top-5
    recall (STA). An empty subset has 0 events and NULL scores."""
    _, key = _primary(task)
    if "all" in (subsets or {}):
        raise ValueError("'all' is added automatically")
    return _report(scored, {"all": F.lit(True), **(subsets or {})}, key, kind, num_nouns)


def evaluate_breakdown(scored: DataFrame, task: str, tail: DataFrame | None = None, unseen: Column | None = None,
                       kind: str = "logits", num_nouns: int = 300) -> DataFrame:
    """Overall / seen / unseen / tail. Tail differs per field: tail verb, tail noun, either for actions.
    ``tail`` is a (field, class_id) table of training tail classes, bounded by the label space."""
    _, key = _primary(task)
    masks: dict = {"overall": F.lit(True)}
    if unseen is not None:
        masks["unseen"], masks["seen"] = unseen, ~unseen
    if tail is not None:
        v = tail.where(F.col("field") == "verb").select(F.col("class_id").alias("verb"), F.lit(True).alias("_tail_v"))
        n = tail.where(F.col("field") == "noun").select(F.col("class_id").alias("noun"), F.lit(True).alias("_tail_n"))
        scored = scored.join(F.broadcast(v), "verb", "left").join(F.broadcast(n), "noun", "left")
        tv, tn = F.col("_tail_v").isNotNull(), F.col("_tail_n").isNotNull()
        masks["tail"] = {"verb": tv, "noun": tn, "action": tv | tn}
    return _report(scored, masks, key, kind, num_nouns)


def _report(scored: DataFrame, masks: dict, key: str, kind: str, num_nouns: int) -> DataFrame:
    measured = _scores(_masked(scored, masks, kind, num_nouns), ["subset", "field"])
    spark = scored.sparkSession
    spine = spark.createDataFrame([(s, f) for s in masks for f in FIELDS], "subset string, field string")
    full = spine.join(measured, ["subset", "field"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    primary = F.max(F.when(F.col("field") == "action", F.col(key))).over(Window.partitionBy("subset"))
    return full.withColumn("primary_score", primary)


def grid_search(scored: DataFrame, log_prior_verb: DataFrame, log_prior_noun: DataFrame, task: str,
                taus_v: Sequence[float], taus_n: Sequence[float], temperature: float = 1.0,
                mask: Column | None = None, num_nouns: int = 300) -> DataFrame:
    """Score every (tau_v, tau_n): columns i, j, tau_v, tau_n, value, is_best, baseline (value at
    tau = 0). AR compares each axis' own maximum, STA the joint top five.

    Each axis is ranked once per tau and event; events with the same class and hit pattern are
    counted together before the grid is expanded. The priors are one-row array tables, read here."""
    _primary(task)
    if not 0 < temperature < float("inf"):
        raise ValueError("temperature must be positive")
    if mask is not None:
        scored = scored.where(mask)
    # one row of class values each: bounded by the label space
    log_v, log_n = log_prior_verb.first()["log_prior"], log_prior_noun.first()["log_prior"]
    hits = grid_hits(task, list(taus_v), list(taus_n), log_v, log_n, float(temperature), num_nouns)
    y = joint_id("verb", "noun", num_nouns) if task == "STA" else F.lit(0).cast("long")
    patterns = (scored.select(y.alias("y"), hits("verb_output", "noun_output", "verb", "noun").alias("cells"))
                .groupBy("y", "cells").agg(F.count(F.lit(1)).alias("n")))
    wide = len(taus_n)
    counts = (patterns.select("y", "n", F.posexplode("cells").alias("cell", "hit"))
              .groupBy("cell", "y").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("h"), F.sum("n").alias("n")))
    # AR has a single class, so the mean over classes is the plain accuracy. Decimals add up alike in any order; cells that tie stay tied.
    share = F.col("h").cast("decimal(17,0)") / F.col("n").cast("decimal(17,0)")
    table = counts.groupBy("cell").agg(F.sum(share).alias("_sum"), F.count(F.lit(1)).alias("_classes"))
    table = table.withColumn("value", 100 * F.round("_sum", 12).cast("double") / F.col("_classes"))
    i, j = F.floor(F.col("cell") / wide).cast("int"), (F.col("cell") % wide).cast("int")

    def pick(taus, at):
        return F.array(*[F.lit(float(t)) for t in taus])[at]

    table = table.select("cell", i.alias("i"), j.alias("j"), pick(taus_v, i).alias("tau_v"), pick(taus_n, j).alias("tau_n"), "value")
    grid = Window.partitionBy()
    best = F.min_by("cell", F.struct(-F.col("value"), F.col("cell"))).over(grid)
    zero = [n for n, (a, b) in enumerate((a, b) for a in taus_v for b in taus_n) if abs(a) < 1e-12 and abs(b) < 1e-12]
    base = F.max(F.when(F.col("cell") == zero[0], F.col("value"))).over(grid) if zero else F.lit(None).cast("double")
    return table.select("i", "j", "tau_v", "tau_n", "value", (F.col("cell") == best).alias("is_best"), base.alias("baseline"))


def cold_start_scores(prior: DataFrame, log_prior: DataFrame, tau_v: float = 0.0, tau_n: float = 0.0) -> DataFrame:
    """Scores for events without history, per class: ``log prior - tau * log pi``, as float32."""
    tau = F.when(F.col("field") == "verb", F.lit(float(tau_v))).otherwise(F.lit(float(tau_n)))
    return (prior.select("field", "class_id", "prior").join(log_prior.select("field", "class_id", "log_prior"), ["field", "class_id"])
            .select("field", "class_id", (F.ln("prior") - tau * F.col("log_prior")).cast("float").alias("score")))


def use_prior(history_rows: DataFrame) -> DataFrame:
    """Per event, whether no history step is valid."""
    return history_rows.groupBy("narration_id").agg((~F.max("valid")).alias("use_prior"))


def with_prior_fallback(scored: DataFrame, history_rows: DataFrame, prior_scores: DataFrame) -> DataFrame:
    """Replace the scores of events without any valid step by the prior scores, a one-row table of
    ``verb_output`` and ``noun_output`` arrays. Events that have no history rows count as without."""
    p = prior_scores.select(F.col("verb_output").alias("_pv"), F.col("noun_output").alias("_pn"))
    flags = use_prior(history_rows)
    cold = F.coalesce(F.col("use_prior"), F.lit(True))
    keep = [c for c in scored.columns if c not in ("verb_output", "noun_output")]
    return (scored.join(flags, "narration_id", "left").join(F.broadcast(p), F.lit(True))
            .select(*keep, F.when(cold, F.col("_pv")).otherwise(F.col("verb_output").cast("array<double>")).alias("verb_output"),
                    F.when(cold, F.col("_pn")).otherwise(F.col("noun_output").cast("array<double>")).alias("noun_output"),
                    cold.alias("use_prior")))


def prior_arrays(table: DataFrame, value: str, log: bool = False, floor: float = 0.0) -> DataFrame:
    """One row ``(verb_output, noun_output)`` of per-class values, optionally as logarithms."""
    x = F.ln(F.col(value) + floor) if log else F.col(value).cast("double")
    pairs = [F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("class_id", x.alias("x"))))),
                         lambda s: s["x"]).alias(f"{f}_output") for f in ("verb", "noun")]
    return table.agg(*pairs)
