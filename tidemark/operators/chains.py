"""Greedy selection along timelines: a point is kept when it lies more than a distance after the last kept one.

Points whose predecessor is further away than the distance (*leaders*) are always kept, so a selection is decided from its leaders
on. Time is cut into buckets; a bucket knows its points, those just before it and those just after it. Each bucket follows the links "next
point that would be kept" by pointer doubling over its sorted array. What follows a leader in a bucket is final. A run that goes on into
the next bucket marks the point at which it enters; a bucket without a leader maps each possible entry to the entry of the next
bucket. These links are doubled by joins, in as many rounds as the logarithm of the buckets of the longest run, until no mark is new; the entered buckets
are then finished. No run and no video is gathered: a task holds one bucket at a time of a run, whatever the run's length."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .sweep import SHELVES_PER_TASK, group_ids, last_before, numbers

KEPT, OPEN, LINK, MARK = 0, 1, 2, 3


def next_kept(group: np.ndarray, time: np.ndarray, eps: float) -> np.ndarray:
    """For each point of arrays sorted by group and time the first of its group more than `eps` later; len(time) for none."""
    n = len(time)
    after = last_before(group, time, group, time + eps) + 1
    padded = np.append(time, np.inf)
    for _ in range(4):  # time + eps is rounded: the rule is on the difference
        early = (after < n) & (padded[after] - time <= eps)
        after = after + early
        late = (after - 1 > np.arange(n)) & (padded[after - 1] - time > eps)
        after = after - late
        if not (early | late).any():
            break
    owner = np.append(group, -1)
    return np.where(owner[after] == group, after, n)


def reached(start: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Which points the marked ones reach over `link` (len(link) for the end), themselves included."""
    mark, jump = np.append(start, False), np.append(link, len(link))
    while True:
        before = mark.copy()
        mark[jump[np.flatnonzero(mark)]] = True
        mark[-1] = False
        jump = jump[jump]
        if (mark == before).all():
            return mark[:-1]


def _cells(points: DataFrame, by: list[str], eps: float, width: float) -> DataFrame:
    """Every point in its bucket (`_own`), and in the buckets beside it that it can matter to."""
    w, t = F.lit(float(width)), F.col("_t")
    own = F.floor(t / w)
    beside = F.array(F.struct(own.alias("_b"), F.lit(True).alias("_own")),
                     F.when(t - F.lit(2.001 * eps) < own * w, F.struct((own - 1).alias("_b"), F.lit(False).alias("_own"))),
                     F.when(t + F.lit(1.001 * eps) >= (own + 1) * w, F.struct((own + 1).alias("_b"), F.lit(False).alias("_own"))))
    return points.select(*by, "_t", "_r", F.inline(F.array_compact(beside)))


def _shelf(df: DataFrame, by: list[str]):
    shelves = SHELVES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*by, "_b"), F.lit(shelves)).alias("_shelf")


def _sorted(table: pa.Table, by: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    group, time = group_ids(table, [*by, "_b"]), numbers(table, "_t")
    order = np.lexsort((time, group))
    return table.take(pa.array(order)), group[order], time[order]


def greedy(points: DataFrame, by: list[str], time: str, row: str, eps: float, width: float) -> DataFrame:
    """The kept points (``by``, ``time`` double, ``row`` long) of `points`, which have one row per group and time. `width` is the bucket's length, at least 8 times `eps`."""
    if width < 8 * eps:
        raise ValueError("width must be at least 8 times eps")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    plain = points.select(*by, F.col(time).cast("double").alias("_t"), F.col(row).cast("long").alias("_r"))
    cells = _cells(plain, by, eps, width)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    out_schema = f"{keys}, _b long, _t double, _r long, _kind int, _to double"

    def first_pass(table: pa.Table) -> pa.Table:
        table, group, t = _sorted(table, by)
        n = len(t)
        own = np.asarray(table.column("_own").combine_chunks().cast(pa.int8())).astype(bool)
        begins = np.ones(n, bool)
        begins[1:] = group[1:] != group[:-1]
        leader = begins.copy()
        leader[1:] |= t[1:] - t[:-1] > eps
        leader &= own  # the first of a bucket has its predecessors beside it
        link = next_kept(group, t, eps)
        inside = np.where(np.append(own, False)[link], link, n)  # stays in the bucket
        kept = reached(leader, inside)
        # up to the first leader of its bucket a point is open
        place = np.where(leader, np.arange(n), -1)
        begin = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        led = np.maximum.accumulate(place) >= begin
        is_open = own & ~led
        # where a chain leaves its bucket: doubled until all have left or ended
        beyond = np.append(link, n)
        stop = np.append(~own, True)
        jump = np.where(stop, np.arange(n + 1), beyond)
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        leaves = jump[:n]
        after = (leaves < n) & np.append(~own, False)[leaves] & (np.append(t, np.inf)[leaves] > t)
        has_leader = np.zeros(group.max(initial=0) + 1, bool)
        has_leader[group[leader]] = True
        marks = np.flatnonzero(kept & after & own)
        marks = np.unique(leaves[marks])
        bucket = np.asarray(table.column("_b"))
        entry = t < bucket * width + 2.001 * eps  # where a run from the bucket before can come in
        links = np.flatnonzero(is_open & after & entry & ~has_leader[group])
        parts = [(np.flatnonzero(kept & own), KEPT, None), (np.flatnonzero(is_open), OPEN, None), (links, LINK, leaves[links]), (marks, MARK, None)]
        at = np.concatenate([p for p, _, _ in parts])
        kind = np.repeat([k for _, k, _ in parts], [len(p) for p, _, _ in parts]).astype(np.int32)
        to = np.concatenate([np.full(len(p), np.nan) if target is None else t[target] for p, _, target in parts])
        taken = table.take(pa.array(at))
        return pa.table({**{c: taken.column(c) for c in by}, "_b": pa.array(bucket[at]), "_t": pa.array(t[at]), "_r": taken.column("_r"),
                         "_kind": pa.array(kind), "_to": pa.array(to, mask=np.isnan(to))})

    first = checkpointed(cells.groupBy(_shelf(cells, by)).applyInArrow(first_pass, out_schema))
    kept = first.where(F.col("_kind") == KEPT).select(*by, "_t", "_r")
    marks = first.where(F.col("_kind") == MARK).select(*by, "_t").distinct()
    if not marks.isEmpty():
        entered = _double(marks, first.where(F.col("_kind") == LINK).select(*by, "_t", "_to"), by)
        entered = entered.withColumn("_b", F.floor(F.col("_t") / F.lit(float(width))))
        rest = first.where(F.col("_kind") == OPEN).select(*by, "_b", "_t", "_r")
        both = rest.unionByName(entered.withColumn("_in", F.lit(True)), allowMissingColumns=True)

        def second_pass(table: pa.Table) -> pa.Table:
            is_entry = np.asarray(table.column("_in").combine_chunks().is_valid())
            entries, table = table.filter(pa.array(is_entry)), table.filter(pa.array(~is_entry))
            ids = group_ids(pa.concat_tables([table, entries]), [*by, "_b"])
            group, t = ids[:table.num_rows], numbers(table, "_t")
            order = np.lexsort((t, group))
            table, group, t = table.take(pa.array(order)), group[order], t[order]
            at = last_before(group, t, ids[len(t):], numbers(entries, "_t"))
            start = np.zeros(len(t), bool)
            start[at[(at >= 0) & (np.append(t, np.nan)[at] == numbers(entries, "_t"))]] = True
            taken = table.take(pa.array(np.flatnonzero(reached(start, next_kept(group, t, eps)))))
            return taken.select([*by, "_t", "_r"])

        kept = kept.unionByName(both.groupBy(_shelf(both, by)).applyInArrow(second_pass, f"{keys}, _t double, _r long"))
    return kept.select(*by, F.col("_t").alias(time), F.col("_r").alias(row))


def _double(marks: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Every point that the marks reach over the links (``_t`` to ``_to``), by doubling: links and marks are stored after each round."""
    marks, links = checkpointed(marks), checkpointed(links)
    many = marks.count()
    while not links.isEmpty():
        new = marks.join(links, [*by, "_t"]).select(*by, F.col("_to").alias("_t"))
        marks = checkpointed(marks.unionByName(new).distinct())
        onward = links.select(*by, F.col("_t").alias("_to"), F.col("_to").alias("_end"))
        links = checkpointed(links.join(onward, [*by, "_to"]).select(*by, "_t", F.col("_end").alias("_to")))
        before, many = many, marks.count()
        if many == before:
            break
    return marks
