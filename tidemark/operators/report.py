"""Run reports: flattened run tables, seed summaries, ablations, horizons."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import config_name, config_seed, format_mean_sd, fusion_label, memory_label, present_label
from .stats import mean_sd

# Metric names kept per subset, and how subset names are spelled in result columns.
METRICS = ("action_mt5r", "verb_mt5r", "noun_mt5r", "action_top1")
ALIASES = {"all": "", "unseen": "unseen_", "tail": "tail_", "unseen_participants": "unseen_", "tail_actions": "tail_"}


# The settings whose runs a horizon compares.
HORIZON = {"anchor": True, "fusion": "aga", "memory": "scratch"}


def delta_vs(runs: DataFrame, reference: str, on: str = "seed", metric: str = "score", name: str = "configuration") -> DataFrame:
    """Difference to the reference configuration at the same seed; seeds it lacks drop out. A seed that the
    reference ran twice counts with the run that comes last by name (without a ``run`` column: the best)."""
    ref = _reference(runs, reference, on, metric, name)
    return runs.join(ref, on).withColumn("delta", F.col(metric) - F.col("_ref")).drop("_ref")


def _reference(runs: DataFrame, reference: str, on: str, metric: str, name: str) -> DataFrame:
    last = F.max_by(metric, "run") if "run" in runs.columns else F.max(metric)
    return runs.where(F.col(name) == reference).groupBy(on).agg(last.alias("_ref"))


def flat_scores(best_val: Column, breakdown: Column) -> list[Column]:
    """Result columns of one evaluation: plain, unseen and tail scores by either subset spelling, and
    the official breakdown's unseen and tail action score."""
    out = []
    for prefix in ("", "unseen_", "tail_"):
        spellings = [k for k, v in ALIASES.items() if v == prefix]
        for m in METRICS:
            out.append(F.coalesce(*[F.try_element_at(F.try_element_at(best_val, F.lit(s)), F.lit(m)).try_cast("double") for s in spellings]).alias(prefix + m))
    for group in ("unseen", "tail"):
        out.append(F.try_element_at(F.try_element_at(breakdown, F.lit(group)), F.lit("action_mt5r")).try_cast("double").alias(f"official_{group}_action_mt5r"))
    return out


def run_table(runs: DataFrame) -> DataFrame:
    """One row per finished run: options, readable labels and scores; the official breakdown wins over
    the run's own subset."""
    a = F.col("args")
    base = runs.where(F.col("best_val").isNotNull()).select(
        "run", F.col("args.mode").alias("mode"), F.col("args.steps").alias("steps"), F.col("args.seed").alias("seed"),
        fusion_label(a["fusion"], a["branches"], a["future_encoder"]).alias("fusion"),
        memory_label(a["memory_init"], a["freeze_memory"], a["step_features"], a["step_keys"]).alias("memory"),
        present_label(a["present_encoder"], a["freeze_present"]).alias("present"),
        (~F.coalesce(a["no_anchor"], F.lit(False))).alias("anchor"), "best_epoch",
        *flat_scores(F.col("best_val"), F.col("best_val_breakdown")))
    for g in ("unseen", "tail"):
        base = base.withColumn(f"{g}_best", F.coalesce(f"official_{g}_action_mt5r", f"{g}_action_mt5r"))
    return base


def init_rows(runs: DataFrame) -> DataFrame:
    """One "before training" row per present setting, from the first run (by name) that has one."""
    a = F.col("args")
    anchor = ~F.coalesce(a["no_anchor"], F.lit(False))
    alone = runs.where(F.col("best_val").isNotNull() & F.coalesce(F.col("init.probe_alone"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("anchor").orderBy("run"))
    return (alone.withColumn("anchor", anchor).withColumn("_r", first).where("_r = 1")
            .select(F.concat(F.col("run"), F.lit("@init")).alias("run"), F.lit("none").alias("mode"), F.lit(0).alias("steps"),
                    F.col("args.seed").alias("seed"), F.lit("–").alias("fusion"), F.lit("probe alone").alias("present"), "anchor",
                    *flat_scores(F.col("init.val"), F.col("init.breakdown"))))


def filter_runs(table: DataFrame, mode: str | None = None, steps: int | None = None, present: str | None = None,
                name_contains: str | None = None) -> DataFrame:
    """Runs that match every given option."""
    for col, value in (("mode", mode), ("steps", steps), ("present", present)):
        if value is not None:
            table = table.where(F.col(col) == value)
    return table.where(F.contains(F.col("run"), F.lit(name_contains))) if name_contains else table


def seed_summary(runs: DataFrame, metrics: Sequence[str] = ("action",), match: str | None = None) -> DataFrame:
    """Per configuration (run name without its seed): seeds and ``mean ± sd`` (ddof 1) per metric.
    A seed run twice counts with the run that comes last by name."""
    named = runs.select("*", config_name("run").alias("configuration"), config_seed("run").alias("seed_no"))
    if match:
        named = named.where(F.contains(F.col("configuration"), F.lit(match)))
    once = named.groupBy("configuration", "seed_no").agg(*[F.max_by(m, F.col("run")).alias(m) for m in metrics])
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), F.count(m).alias(f"{m}_n")]
    out = once.groupBy("configuration").agg(F.array_sort(F.collect_set("seed_no")).alias("seeds"), *aggs)
    for m in metrics:
        out = out.withColumn(f"{m}_text", format_mean_sd(f"{m}_mean", f"{m}_sd", f"{m}_n"))
    return out


def ablation(runs: DataFrame, reference: str, metrics: Sequence[str] = ("score",), name: str = "configuration",
             gates: DataFrame | None = None) -> DataFrame:
    """Per configuration: seeds, mean and sd (0 for one seed) of each metric, the same-seed delta of the
    first metric against ``reference`` (NULL for itself), and mean gate weights when given as
    (configuration, seed, history, present, future) or as rows of ``gate_summary``, which give a column per field, branch and mask."""
    main = metrics[0]
    ref = _reference(runs, reference, "seed", main, name)
    d = runs.join(ref, "seed", "left").withColumn("_delta", F.when(F.col(name) != reference, F.col(main) - F.col("_ref")))
    aggs = [F.array_sort(F.collect_set("seed")).alias("seeds")]
    for m in [*metrics, "_delta"]:
        label = "delta" if m == "_delta" else m
        aggs += [F.avg(m).alias(f"{label}_mean"), F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{label}_sd"),
                 F.count(m).alias(f"{label}_n")]
    out = d.groupBy(name).agg(*aggs)
    if gates is not None and "mask" in gates.columns:
        out = out.join(gate_columns(gates, name), name, "left")
    elif gates is not None:
        weights = gates.groupBy(name).agg(*[F.avg(b).alias(f"{b}_gate") for b in ("history", "present", "future")])
        out = out.join(weights, name, "left")
    return out


# Branches of a three-way gate in their stored order, and the label fields that have one.
BRANCHES, FIELDS = ("history", "present", "future"), ("verb", "noun")


def _thousandths(c: Column) -> Column:
    return F.rint(c * 1000) / 1000


def gate_weights(outputs: DataFrame, rounded: bool = True) -> DataFrame:
    """Mean gate weight per branch from run outputs (``sources.read_outputs``): ``(run, field, mask, events, history, present, future)``.

    Mask ``model`` holds the events that use the model instead of the prior, ``with_future`` those of them that have future features; a
    missing mark means no. Runs with two-way gates have a history weight only. A run or mask without gates gives no row. Weights have three decimals,
    as reports show them, unless ``rounded`` is off. One aggregation with partial sums: what is shuffled are a few numbers per run and task."""
    used = outputs.where(~F.coalesce(F.col("use_prior"), F.lit(False)))
    ahead = F.coalesce(F.col("future_available"), F.lit(False))
    aggs, rows = [], []
    for field in FIELDS:
        gates = F.col(f"{field}_gates")
        weights = {b: F.try_element_at(gates, F.lit(i)) for i, b in enumerate(BRANCHES, 1)}
        weights["history"] = F.coalesce(weights["history"], F.col(f"gate_{field}"))
        for mask, inside in (("model", F.lit(True)), ("with_future", ahead & gates.isNotNull())):
            names = {b: f"{field}_{mask}_{b}" for b in BRANCHES}
            aggs += [F.avg(F.when(inside, w)).alias(names[b]) for b, w in weights.items()]
            aggs.append(F.count(F.when(inside, weights["history"])).alias(f"{field}_{mask}_n"))
            shown = _thousandths if rounded else (lambda c: c)
            rows.append(F.struct(F.lit(field).alias("field"), F.lit(mask).alias("mask"), F.col(f"{field}_{mask}_n").alias("events"),
                                 *(shown(F.col(names[b])).alias(b) for b in BRANCHES)))
    return used.groupBy("run").agg(*aggs).select("run", F.inline(F.array(*rows))).where("events > 0")


def gate_summary(weights: DataFrame, runs: DataFrame, name: str = "configuration", rounded: bool = True) -> DataFrame:
    """Per configuration, field and mask: number of runs and the mean of their gate weights, each run counting once. ``runs`` has ``run`` and ``name``;
    runs without gates and gates without a run take no part."""
    joined = weights.join(runs.select("run", name), "run")
    shown = _thousandths if rounded else (lambda c: c)
    return joined.groupBy(name, "field", "mask").agg(F.count(F.lit(1)).alias("runs"), *(shown(F.avg(b)).alias(b) for b in BRANCHES))


def gate_columns(summary: DataFrame, name: str = "configuration") -> DataFrame:
    """The rows of ``gate_summary`` side by side: ``verb_history_gate`` ... ``noun_future_gate_with_future`` per configuration."""
    aggs = []
    for field in FIELDS:
        for mask, end in (("model", ""), ("with_future", "_with_future")):
            here = (F.col("field") == field) & (F.col("mask") == mask)
            aggs += [F.max(F.when(here, F.col(b))).alias(f"{field}_{b}_gate{end}") for b in BRANCHES]
    return summary.groupBy(name).agg(*aggs)


def horizon(table: DataFrame, present: str | None = None, metric: str = "action_mt5r", default: str = "probe (frozen)") -> DataFrame:
    """Mean and population sd of a metric by (mode, steps) of the runs with anchor, ``aga`` fusion and memory
    from scratch (where the table has these columns), for one present setting: the given one, else ``default`` if any run uses it, else the most frequent (ties to the first by name)."""
    rows = table.where(F.col(metric).isNotNull())
    for column, value in HORIZON.items():
        if column in table.columns:
            rows = rows.where(F.col(column) == F.lit(value))
    if present is None:
        uses = rows.groupBy("present").agg(F.count(F.lit(1)).alias("_n"))
        chosen = uses.orderBy((F.col("present") == default).desc(), F.col("_n").desc(), "present").limit(1)
        rows = rows.join(F.broadcast(chosen.select("present")), "present", "left_semi")
    else:
        rows = rows.where(F.col("present") == present)
    return mean_sd(rows, ["present", "mode", "steps"], metric, ddof=0)
