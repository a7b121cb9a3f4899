"""Class statistics, priors, weights and summaries. Class tables are bounded by the label space, so
windows over them are small however many events were counted."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import with_scalar


def class_counts(events: DataFrame, num_verbs: int = 97, num_nouns: int = 300, keep: Sequence[str] = ()) -> DataFrame:
    """``(field, class_id, n)`` with zero rows for absent classes, in one aggregation: the class
    spine joins the counted rows with weight zero. Verbs and nouns are counted each by itself. ``keep`` counts separately per extra column."""
    spark = events.sparkSession
    labels = events.select(*keep, F.explode(F.array(
        F.struct(F.lit("verb").alias("field"), F.col("verb").cast("int").alias("class_id")),
        F.struct(F.lit("noun").alias("field"), F.col("noun").cast("int").alias("class_id")))).alias("c")).where("c.class_id IS NOT NULL")
    counted = labels.groupBy(*keep, "c").agg(F.count(F.lit(1)).alias("n")).select(*keep, "c.*", "n")
    spine = (spark.range(num_verbs).select(F.lit("verb").alias("field"), F.col("id").cast("int").alias("class_id"))
             .unionByName(spark.range(num_nouns).select(F.lit("noun").alias("field"), F.col("id").cast("int").alias("class_id")))
             .withColumn("n", F.lit(0).cast("long")))
    if keep:
        groups = events.select(*keep).distinct()
        spine = groups.join(F.broadcast(spine), F.lit(True), "inner")
    return (counted.unionByName(spine).groupBy(*keep, "field", "class_id").agg(F.sum("n").alias("n"))
            .select(*keep, "field", "class_id", "n"))


def action_counts(events: DataFrame) -> DataFrame:
    """Events per (verb, noun) pair and its ``verb:noun`` name."""
    return (events.where(F.col("verb").isNotNull()).groupBy("verb", "noun").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("action", F.concat_ws(":", "verb", "noun")))


def event_counts(events: DataFrame, by: Sequence[str] | str) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _field() -> Window:
    return Window.partitionBy("field")


def prior(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed class shares ``(n + alpha) / (N + alpha * C)`` from ``class_counts``."""
    if not 0 < alpha < float("inf"):
        raise ValueError("smoothing must be positive")
    total, classes = F.sum("n").over(_field()), F.count(F.lit(1)).over(_field())
    return counts.withColumn("prior", (F.col("n") + alpha) / (total + alpha * classes))


def log_prior(counts: DataFrame, delta: float = 1e-4) -> DataFrame:
    """``log((n / N + delta) / (1 + delta * C))`` from ``class_counts``."""
    total, classes = F.sum("n").over(_field()), F.count(F.lit(1)).over(_field())
    return counts.withColumn("log_prior", F.ln((F.col("n") / total + delta) / (1 + delta * classes)))


def cold_start_prior(events: DataFrame, num_verbs: int = 97, num_nouns: int = 300, window_s: float = 5.0,
                     alpha: float = 0.1) -> DataFrame:
    """Prior over the actions that open a video (``start < window_s``); an error when there are none."""
    opening = class_counts(events.where(F.col("start") < window_s), num_verbs, num_nouns)
    used = F.sum("n").over(_field())
    guarded = F.when(used == 0, F.raise_error(F.lit("no action starts inside the cold-start window")).cast("long")) \
        .otherwise(F.col("n"))
    return prior(opening.withColumn("n", guarded), alpha)


def dense(table: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One array per field, ordered by class id (a sink format; at most the label space long)."""
    pairs = F.array_sort(F.collect_list(F.struct("class_id", value)))
    return table.groupBy(*by, "field").agg(F.transform(pairs, lambda s: s[value]).alias(value))


def class_weights(counts: DataFrame, power: float = -1.0) -> DataFrame:
    """Weights ``(n + 1) ** power`` scaled so that the average over (smoothed) samples is one."""
    m = F.col("n") + 1.0
    raw = F.pow(m, F.lit(float(power)))
    scale = F.sum(m).over(_field()) / F.sum(raw * m).over(_field())
    return counts.withColumn("weight", raw * scale)


def tail_classes(counts: DataFrame, head_share: float = 0.8, by: Sequence[str] = ("field",)) -> DataFrame:
    """Classes outside the most frequent ones that cover ``head_share`` of the instances: sorted by
    (-count, id), a class is tail when the count before it already reaches the share."""
    seen = counts.where(F.col("n") > 0)
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "class_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*by))
    return (seen.withColumn("_tail", before >= F.lit(float(head_share)) * total).where(F.col("_tail"))
            .select(*by, "class_id", "n"))


def tail_actions(train: DataFrame, rows: DataFrame, position: str, head_share: float = 0.8) -> DataFrame:
    """Flag rows whose (verb, noun) pair is outside the head of the training pairs (or never seen
    there). Equal counts keep the order of first appearance, given by ``position``.

    The pair table is bounded by the label space, not by the number of events."""
    pairs = train.groupBy("verb", "noun").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first"))
    order = Window.orderBy(F.col("n").desc(), "_first")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = pairs.agg(F.sum("n").alias("_total"))
    head = (with_scalar(pairs.withColumn("_before", before), total)
            .where(F.col("_before") < F.lit(float(head_share)) * F.col("_total")).select("verb", "noun")
            .withColumn("_head", F.lit(True)))
    return (rows.join(F.broadcast(head), ["verb", "noun"], "left")
            .withColumn("tail", F.col("_head").isNull()).select(*rows.columns, "tail"))


def split_summary(events: DataFrame, by: str = "subset") -> DataFrame:
    """Events, distinct videos and events without history per split."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("video_id").alias("videos"),
                                  F.count_if(F.col("sta_cutoff") < 0).alias("no_history"))


def split_members(split: DataFrame) -> DataFrame:
    """``(kind, id, subset, events, fraction)``: events per participant, video and action of every subset, and the share of the subset's events.

    Rows of kind ``subset`` hold the subset itself, with its share of all rows. The held-out videos and participants are the rows of their kind
    outside ``train``. Rows without a label are of no action. Groups are counted before they are divided, in one pass over the split."""
    action = F.when(F.col("verb").isNotNull(), F.concat_ws(":", "verb", "noun"))
    member = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("id")) for k, c in (
        ("subset", F.col("subset")), ("participant", F.col("participant_id")), ("video", F.col("video_id")), ("action", action)))))
    once = split.groupBy("subset", "participant_id", "video_id", "verb", "noun").agg(F.count(F.lit(1)).alias("n"))
    counted = (once.select("subset", "n", member.alias("m")).where("m.kind = 'subset' OR m.id IS NOT NULL")
               .groupBy("m", "subset").agg(F.sum("n").alias("events")).select("m.kind", "m.id", "subset", "events"))
    sizes = split.groupBy("subset").agg(F.count(F.lit(1)).alias("_of"))
    all_rows = split.agg(F.count(F.lit(1)).alias("_all"))
    named = counted.join(sizes.withColumnRenamed("subset", "_subset"), F.col("subset").eqNullSafe(F.col("_subset"))).drop("_subset")
    share = F.col("events") / F.when(F.col("kind") == "subset", F.col("_all")).otherwise(F.col("_of"))
    return with_scalar(named, all_rows).select("kind", "id", "subset", "events", share.alias("fraction"))


def coverage(split: DataFrame, head_share: float = 0.8) -> DataFrame:
    """Per field: share of training classes that validation contains, the same weighted by training
    instances, classes seen in validation only, and validation events of tail classes."""
    side = F.col("subset") == "train"
    c = (split.select("subset", F.explode(F.array(
            F.struct(F.lit("verb").alias("field"), F.col("verb").alias("class_id")),
            F.struct(F.lit("noun").alias("field"), F.col("noun").alias("class_id")))).alias("c"))
         .groupBy("c").agg(F.count_if(side).alias("n"), F.count_if(~side).alias("val_n"))
         .select("c.*", "n", "val_n"))
    order = Window.partitionBy("field").orderBy(F.col("n").desc(), "class_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("field"))
    c = c.withColumn("tail", (F.col("n") > 0) & (before >= F.lit(float(head_share)) * total))
    in_train, in_val = F.col("n") > 0, F.col("val_n") > 0
    return c.groupBy("field").agg(
        F.count_if(in_train).alias("train_classes"),
        (F.count_if(in_train & in_val) / F.greatest(F.lit(1), F.count_if(in_train))).alias("coverage"),
        (F.sum(F.when(in_val, F.col("n")).otherwise(0)) / F.greatest(F.lit(1), F.sum("n"))).alias("weighted_coverage"),
        F.array_sort(F.collect_set(F.when(~in_train, F.col("class_id")))).alias("val_only_classes"),
        F.sum(F.when(F.col("tail"), F.col("val_n")).otherwise(0)).alias("val_events_tail"))


def tail_action_events(split: DataFrame, tail: DataFrame) -> DataFrame:
    """Validation events whose verb or noun is a tail class (counted per pair before any join)."""
    pairs = split.where(F.col("subset") != "train").groupBy("verb", "noun").agg(F.count(F.lit(1)).alias("n"))
    v = tail.where(F.col("field") == "verb").select(F.col("class_id").alias("verb"), F.lit(True).alias("_tv"))
    n = tail.where(F.col("field") == "noun").select(F.col("class_id").alias("noun"), F.lit(True).alias("_tn"))
    hit = F.col("_tv").isNotNull() | F.col("_tn").isNotNull()
    return (pairs.join(F.broadcast(v), "verb", "left").join(F.broadcast(n), "noun", "left")
            .agg(F.coalesce(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.lit(0)).alias("val_events_tail_action")))


def health_summary(health: DataFrame, events: DataFrame) -> DataFrame:
    """Videos checked, failed and missing, and the events they affect."""
    failed = health.where(F.col("status") != "ok").select("video_id")
    videos = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    j = (health.select("video_id", (F.col("status") != "ok").alias("bad")).withColumn("_checked", F.lit(True))
         .join(videos, "video_id", "full_outer"))
    missing = F.col("_checked").isNull()
    bad = F.coalesce(F.col("bad"), F.lit(False))
    return j.agg(F.count("_checked").alias("videos"), F.count_if(bad).alias("failed_videos"),
                 F.count_if(missing).alias("missing_videos"),
                 F.coalesce(F.sum(F.when(bad | missing, F.col("n"))), F.lit(0)).alias("affected_events"))


def mean_sd(rows: DataFrame, by: Sequence[str] | str, metric: str, ddof: int = 1) -> DataFrame:
    """Mean, standard deviation and count. ``ddof=1`` gives 0 for a single value."""
    by = [by] if isinstance(by, str) else list(by)
    sd = F.stddev_samp(metric) if ddof == 1 else F.stddev_pop(metric)
    return rows.groupBy(*by).agg(F.avg(metric).alias("mean"),
                                 F.when(F.count(metric) > 0, F.coalesce(sd, F.lit(0.0))).alias("sd"),
                                 F.count(metric).alias("n"))


def density_hist(df: DataFrame, col: str, bins: int = 30, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Density per bin over ``[lo, hi]``, the last bin closed; empty bins are kept."""
    width = (hi - lo) / bins
    x = F.col(col)
    place = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(x.between(lo, hi)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n"))
    h = counted.unionByName(spine).groupBy("bin").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return h.select("bin", (lo + F.col("bin") * width).alias("bin_start"), "n",
                    F.try_divide(F.col("n"), total * F.lit(width)).alias("density"))


def masked_step_mean(outputs: DataFrame, value: str, valid: str) -> DataFrame:
    """Per array position, the mean of ``value`` over rows where ``valid`` holds there (0 if none)."""
    z = outputs.select(F.posexplode(F.arrays_zip(F.col(value).alias("x"), F.col(valid).alias("ok"))).alias("step", "z"))
    ok = F.col("z.ok").cast("boolean")
    total = F.sum(F.when(ok, F.col("z.x")).otherwise(0.0))
    return z.groupBy("step").agg((total / F.greatest(F.count_if(ok), F.lit(1))).alias("mean"),
                                 F.count_if(ok).alias("n"))


def branch_means(outputs: DataFrame, gates: str, used: Column, with_future: Column,
                 names: Sequence[str] = ("history", "present", "future")) -> DataFrame:
    """Mean gate weight per branch over rows that use the model, and over those with a future branch."""
    z = outputs.where(used).select(with_future.alias("_f"), F.posexplode(gates).alias("_i", "w"))
    branch = F.array(*[F.lit(n) for n in names])[F.col("_i")]
    return (z.groupBy("_i").agg(F.avg("w").alias("mean_weight"), F.avg(F.when(F.col("_f"), F.col("w"))).alias("mean_weight_with_future"))
            .select(branch.alias("branch"), "mean_weight", "mean_weight_with_future"))


def mass_by_group(outputs: DataFrame, weights: str, groups: dict[str, tuple[int, int]]) -> DataFrame:
    """Average weight mass per named half-open position range."""
    parts = [F.struct(F.lit(name).alias("group"),
                      F.aggregate(F.slice(F.col(weights).cast("array<double>"), lo + 1, hi - lo), F.lit(0.0),
                                  lambda a, x: a + x).alias("mass")) for name, (lo, hi) in groups.items()]
    return (outputs.select(F.explode(F.array(*parts)).alias("g")).groupBy("g.group")
            .agg(F.avg("g.mass").alias("mass")))


def position_means(outputs: DataFrame, weights: str) -> DataFrame:
    """Average weight per array position."""
    return (outputs.select(F.posexplode(F.col(weights).cast("array<double>")).alias("position", "w"))
            .groupBy("position").agg(F.avg("w").alias("mean_weight")))
