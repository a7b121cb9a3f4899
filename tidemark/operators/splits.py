"""Reproducible, leakage-free splits. Pseudo-random order is md5 of ``seed:video``, so it does not
depend on partitioning and any engine can recompute it."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import half_even_count, video_number
from ..session import with_scalar
from .checks import enforce, missing_keys
from .choice import best_of, thirds_in_band
from .events import with_subset
from .skew import running


def _hash(video: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(video)))


def _hash_threshold(videos: DataFrame, seed: int, take: Callable[[int], int]) -> tuple[str | None, int]:
    """The ``take(n)``-th smallest hash of the ``n`` videos (None for the 0-th), and ``n``. Looked up at once, so that plans that use a
    split carry one literal: a histogram of the first four digits (at most 65,536 rows) tells in which of its cells the hash lies, and only
    this cell is sorted."""
    hashed = videos.select(_hash("video_id", seed).alias("_h")).where("_h IS NOT NULL").distinct()
    cells = sorted((r["cell"], r["n"]) for r in hashed.groupBy(F.substring("_h", 1, 4).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in cells)
    rest = take(total) if total else 0
    for cell, n in cells:
        if 0 < rest <= n:
            inside = hashed.where(F.substring("_h", 1, 4) == cell).orderBy("_h").limit(rest)
            return inside.agg(F.max("_h")).first()[0], total
        rest -= n
    return None, total


def grouped_split(events: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Hold out whole videos: ``round(n * fraction)`` of them (half-even, at least one on each side).

    One hash is looked up at once; the events themselves are not shuffled."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between zero and one")
    cut, videos = _hash_threshold(events, seed, lambda n: max(1, min(n - 1, round(n * fraction))))
    if videos == 1:
        raise ValueError("a grouped split needs at least two videos")
    return events.withColumn("subset", F.when(_hash("video_id", seed) <= F.lit(cut), F.lit("val")).otherwise(F.lit("train")))


def split_halves(events: DataFrame, seed: int = 0) -> DataFrame:
    """Mark whole videos as half A (``n // 2`` of them) or B, to tune on one and report on the other."""
    cut, _ = _hash_threshold(events, seed, lambda n: n // 2)
    return events.withColumn("half", F.when(_hash("video_id", seed) <= F.lit(cut), F.lit("A")).otherwise(F.lit("B")))


def participant_pool(events: DataFrame, pool: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Participants of medium size: between the sizes at positions ``int(q * (n - 1))`` of the sorted
    list of sizes. Columns participant_id, n, participants, events.

    Positions are read from the histogram of sizes, which has at most sqrt(2 * events) rows."""
    sizes = events.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"))
    hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    whole = hist.agg(F.sum("_m").alias("participants"), F.sum(F.col("n") * F.col("_m")).alias("events"))
    marks = with_scalar(hist.select("n", upto.alias("_upto")), whole)

    def at(q):
        position = F.floor(F.lit(float(q)) * (F.col("participants") - 1))
        return F.min(F.when(F.col("_upto") > position, F.col("n")))

    bounds = marks.groupBy("participants", "events").agg(at(pool[0]).alias("_lo"), at(pool[1]).alias("_hi"))
    return (with_scalar(sizes, bounds).where(F.col("n").between(F.col("_lo"), F.col("_hi")))
            .select("participant_id", "n", "participants", "events"))


def band_limit(target: float, ks: Sequence[int], pool: tuple[float, float], band: float) -> int | None:
    """The largest number of participants with which a combination can still reach the band.

    At least a share ``1 - q`` of the participants are as large as the upper bound of the pool, so a
    pool member holds at most ``1 / ((1 - q) * participants)`` of all events; ``k`` of them reach
    ``target - band`` only when ``participants <= k / ((1 - q) * (target - band))``."""
    top, floor = 1 - pool[1], target - band
    if top <= 0 or floor <= 0:
        return None  # any number of participants may reach it
    return int(max(ks) / (top * floor)) + 1


def _candidates(events: DataFrame, target: float, ks: Sequence[int], pool: tuple[float, float], band: float) -> DataFrame:
    """Pool members that the best combination can have: all up to ``band_limit`` participants, else the largest."""
    members = participant_pool(events, pool)
    limit = band_limit(target, ks, pool, band)
    if limit is None:
        return members
    few = members.where(F.col("participants") <= limit)
    many = (members.where(F.col("participants") > limit)
            .orderBy(F.col("n").desc(), "participant_id").limit(max(ks)))
    return few.unionByName(many)


def combinations(events: DataFrame, target: float = 0.06, ks: Sequence[int] = (2, 3),
                 pool: tuple[float, float] = (0.25, 0.75), band: float = 0.01) -> DataFrame:
    """Candidate participant combinations with size, distance to the target and class coverage.

    Up to ``band_limit`` participants (240 with the defaults) all combinations are listed. Beyond
    it none can reach the band, every share lies below the target, and the best choice is the
    largest one, made of the largest members; only those are combined. Coverage is computed for
    combinations inside the band only."""
    ks = sorted(ks)
    members = _candidates(events, target, ks, pool, band)
    index = F.row_number().over(Window.orderBy("participant_id")) - 1
    members = members.withColumn("i", index).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
    lookup = F.broadcast(members.select("i", F.col("participant_id").alias("_p"), F.col("n").alias("_n")))
    grown = members.select(F.array("participant_id").alias("names"), "n", "events", "size", F.col("i").alias("at"))
    found = [grown] if 1 in ks else []
    for k in range(2, max(ks) + 1):
        later = F.when(F.col("at") + 1 < F.col("size"), F.sequence(F.col("at") + 1, (F.col("size") - 1).cast("int")))
        grown = (grown.withColumn("i", F.explode(later)).join(lookup, "i")
                 .select(F.array_append("names", F.col("_p")).alias("names"), (F.col("n") + F.col("_n")).alias("n"),
                         "events", "size", F.col("i").alias("at")))
        if k == 2:
            grown = grown.repartition("names")
        if k in ks:
            found.append(grown)
    share = F.col("n") / F.col("events")
    every = reduce(DataFrame.unionByName, found).select("names", "n", share.alias("fraction"),
                                                        F.abs(share - F.lit(float(target))).alias("distance"))
    outside = F.col("distance") > F.lit(float(band))
    classes = F.broadcast(
        events.join(F.broadcast(members.select("participant_id")), "participant_id", "left_semi")
        .groupBy("participant_id").agg(F.collect_set("verb").alias("verbs"), F.collect_set("noun").alias("nouns")))

    def distinct(c):
        return F.size(F.array_distinct(F.flatten(F.collect_list(c))))

    inside = (every.where(~outside).withColumn("participant_id", F.explode("names")).join(classes, "participant_id")
              .groupBy("names", "n", "fraction", "distance")
              .agg((distinct("verbs") + distinct("nouns")).alias("coverage")).withColumn("outside", F.lit(False)))
    return inside.unionByName(every.where(outside).withColumn("coverage", F.lit(0)).withColumn("outside", F.lit(True)))


def combination_counts(events: DataFrame, target: float = 0.06, pool: tuple[float, float] = (0.25, 0.75), band: float = 0.01) -> DataFrame:
    """How many pairs and triples of pool members lie inside and outside the band, and their events: members, outside,
    combinations, events. No combination is listed, however many there are.

    Counted on the histogram of sizes: pairs by their sum, and for each sum the thirds that bring it into the band, by binary search in running
    totals. Every triple is met three times that way; thirds that are one of the pair are taken off. What lies outside is the rest of all."""
    members = participant_pool(events, pool)
    hist = members.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.max("events").alias("all"))

    def inside(n):
        return F.abs(n / F.col("all") - F.lit(float(target))) <= F.lit(float(band))

    edges = [F.floor((F.lit(float(target)) + sign * F.lit(float(band))) * F.col("all")).cast("long") for sign in (-1, 1)]
    tried = [F.filter(F.sequence(e - 2, e + 2), inside) for e in edges]  # the comparison itself decides at the edges
    whole = (hist.agg(F.sum("m").alias("people"), F.sum(F.col("m") * F.col("n")).alias("rows"), F.max("all").alias("all"))
             .withColumn("low", F.array_min(tried[0])).withColumn("high", F.array_max(tried[1]))
             .withColumn("high", F.coalesce("high", F.col("low"))).withColumn("low", F.coalesce("low", "high")))
    sized = with_scalar(hist.select("n", "m"), whole.select("all", "low", "high"))
    sizes = hist.agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("_sizes"))
    pairs = (with_scalar(sized, sizes).withColumn("_s", F.explode(F.filter("_sizes", lambda s: s["n"] >= F.col("n"))))
             .select("all", F.col("n").alias("a"), F.col("m").alias("m_a"), F.col("_s.n").alias("b"), F.col("_s.m").alias("m_b")))
    a, b = F.col("a"), F.col("b")
    ways = F.when(a == b, F.expr("m_a * (m_a - 1) div 2")).otherwise(F.col("m_a") * F.col("m_b"))
    pairs = pairs.withColumn("ways", ways).where("ways > 0")
    within = pairs.where(inside(a + b)).agg(F.coalesce(F.sum("ways"), F.lit(0)).alias("c"), F.coalesce(F.sum(ways * (a + b)), F.lit(0)).alias("e"))
    again = pairs.select("ways", "all", F.explode(F.array(2 * a + b, a + 2 * b)).alias("s")).where(inside(F.col("s"))).agg(
        F.coalesce(F.sum("ways"), F.lit(0)).alias("again"), F.coalesce(F.sum(F.col("ways") * F.col("s")), F.lit(0)).alias("again_e"))
    sums = pairs.groupBy((a + b).alias("s")).agg(F.sum("ways").alias("ways"))
    buckets = 8
    met = (sums.withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int")).groupBy("bucket")
           .cogroup(sized.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).groupBy("bucket"))
           .applyInArrow(thirds_in_band, "c long, e long").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("e"), F.lit(0)).alias("e")))
    third = with_scalar(met, again).selectExpr("(c - again) div 3 AS c", "(e - again_e) div 3 AS e")
    every = (with_scalar(within, whole).selectExpr("2L AS members", "c", "e", "people * (people - 1) div 2 AS all_c", "(people - 1) * rows AS all_e")
             .unionByName(with_scalar(third, whole).selectExpr("3L AS members", "c", "e", "(people * (people - 1) div 2) * (people - 2) div 3 AS all_c",
                                                              "((people - 1) * (people - 2) div 2) * rows AS all_e")))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("outside"), F.col("c").alias("combinations"), F.col("e").alias("events")),
                              F.struct(F.lit(True).alias("outside"), (F.col("all_c") - F.col("c")).alias("combinations"),
                                       (F.col("all_e") - F.col("e")).alias("events"))))
    return every.select("members", sides.alias("_s")).select("members", "_s.*").where("combinations > 0")


def best_combination(events: DataFrame, target: float = 0.06, ks: Sequence[int] = (2, 3),
                     pool: tuple[float, float] = (0.25, 0.75), band: float = 0.01) -> DataFrame:
    """The first of ``combinations`` by outside, coverage (most), distance and names, without listing them: names, n, distance, outside, coverage; no
    row when there is none. Combinations have up to three members.

    Of members that have one size and the same classes the first ``max(ks)`` names are kept: any other can be replaced by one of them. Each unit
    gets all members that are left (size, name, classes) and some of the first positions of a combination."""
    if not ks or min(ks) < 1 or max(ks) > 3:
        raise ValueError("combinations have one to three members")
    members = _candidates(events, target, ks, pool, band)
    labels = F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("verb").cast("int").alias("class_id")),
                               F.struct(F.lit(1).alias("field"), F.col("noun").cast("int").alias("class_id"))))
    found = (events.select("participant_id", labels.alias("label")).where("label.class_id IS NOT NULL")
             .select("participant_id", (F.col("label.class_id").cast("long") * 2 + F.col("label.field")).alias("class"))
             .groupBy("participant_id").agg(F.array_sort(F.collect_set("class")).alias("classes")))
    known = members.join(found, "participant_id", "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<bigint>")))
    alike = Window.partitionBy("n", "classes").orderBy("participant_id")
    needed = (known.where("participant_id IS NOT NULL").withColumn("place", F.row_number().over(alike)).where(F.col("place") <= max(ks))
              .select("participant_id", "n", "events", "classes"))
    buckets = F.greatest(F.lit(8), F.ceil(F.col("members") / 128)).cast("int")
    sized = with_scalar(needed, needed.agg(F.count(F.lit(1)).alias("members"))).withColumn("buckets", buckets)
    units = sized.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("members")
    best = units.groupBy("bucket").applyInArrow(best_of(tuple(ks), float(target), float(band)),
                                                "names array<string>, n long, distance double, outside boolean, coverage int")
    return best.orderBy("outside", F.col("coverage").desc(), "distance", "names").limit(1)


def choose_unseen(events: DataFrame, target: float = 0.06, ks: Sequence[int] = (2, 3),
                  pool: tuple[float, float] = (0.25, 0.75), band: float = 0.01) -> DataFrame:
    """Whole participants to hold out: the combination inside the band that covers most classes, else
    the one closest to the target; then the closer share, then the names decide."""
    return best_combination(events, target, ks, pool, band).select(F.explode("names").alias("participant_id"))


def latest_videos(events: DataFrame, fraction: float = 0.08, max_fraction: float = 0.15,
                  exclude: DataFrame | None = None) -> DataFrame:
    """Per participant the newest videos to hold out: newest first while less than ``fraction`` of
    the events is taken and the video does not push the share past ``max_fraction``; never the
    oldest video. Both limits grow with the running count, so a filter equals the stop rule."""
    videos = events.groupBy("participant_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    if exclude is not None:
        videos = videos.join(exclude.select("participant_id"), "participant_id", "left_anti")
    number = F.coalesce(video_number("video_id"),
                        F.raise_error(F.concat(F.lit("unexpected video id: "), F.col("video_id"))).cast("int"))
    videos = videos.withColumn("number", number)
    r = running(videos, ["participant_id"], [F.col("number").desc(), F.col("video_id").desc()],
                F.floor(F.col("number") / 1024), F.col("n"), descending=True)
    taken, after, total = F.col("_before"), F.col("_before") + F.col("n"), F.col("_total")
    keep = ((after < total) & (taken < F.lit(float(fraction)) * total)
            & (after <= F.lit(float(max_fraction)) * total))
    return r.where(keep).select("participant_id", "video_id", "number", "n")


def hybrid_split(events: DataFrame, unseen: Sequence[str] | None = None, unseen_fraction: float = 0.06,
                 seen_fraction: float = 0.08, seen_max_fraction: float = 0.15) -> DataFrame:
    """Unseen participants (given or chosen) plus the latest videos of everybody else."""
    spark = events.sparkSession
    if unseen:
        held = spark.createDataFrame([(p,) for p in sorted(set(unseen))], "participant_id string")
        enforce(missing_keys(held, events, "participant_id").select(
            F.lit("unknown_participant").alias("check"), F.col("participant_id").alias("id"), F.lit("").alias("detail")))
    else:
        # at most three names, used twice below: decide them once
        names = [r["participant_id"] for r in choose_unseen(events, unseen_fraction).collect()]
        if not names:
            raise ValueError("no participant combination reaches the target; name the unseen participants")
        held = spark.createDataFrame([(n,) for n in names], "participant_id string")
    seen = latest_videos(events, seen_fraction, seen_max_fraction, held)
    return with_subset(events, held, seen)
