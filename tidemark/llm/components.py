"""Connected components of a graph of long ids, by alternating large-star and small-star steps; every step is a join."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """id, component for every id in `edges` (a, b); a component is called after its smallest id. Edges are rewired until each id
    points at its component; no node's edges are gathered in one place. A round stores its edges twice and stops after the first
    step where that moved none and no id has two edges; jobs and tasks, of which the driver keeps records, are few."""
    now = checkpointed(_downward(edges))
    while True:
        # large-star: an edge leads on to the smallest neighbour of its lower end
        onward = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = checkpointed(now.join(onward, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")))
        if not large.where("moved").take(1) and not now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            break
        # small-star: an id and its lower neighbours get an edge to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rewired = F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("a", "b"))))
        now = checkpointed(_downward(large.join(least, "a").select(rewired)))
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _downward(edges: DataFrame) -> DataFrame:
    a, b = F.greatest("a", "b"), F.least("a", "b")
    return edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct()
