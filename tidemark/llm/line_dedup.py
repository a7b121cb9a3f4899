"""Removal of repeated runs of lines, with a suffix array over line ids; DataFrame functions only.

The lines of all documents, in the order of (doc_id, line), form one sequence of ids; nothing matches across the end of a
document. Suffixes are ranked by distributed prefix doubling: a rank at depth d orders suffixes by their first d lines. The
next depth, 2d, ranks the pairs (rank of this line, rank of the line d further on): distinct pairs are sorted over the cluster
and numbered in that order. A suffix that shares its first d lines with no other one needs no further rank and is left out,
so each depth holds only text that is repeated to that depth; the last is the one at which nothing repeats.

All suffixes with one rank at depth d are an interval of the suffix array with longest common prefixes of at least d: the places
of one repeated run. Two ranks that overlap give a depth that is no power of two, such as `least`. In each interval at depth
`least` the earliest place stays and the next `least` lines of every other place go; the union of these is what is not first
of all maximal repeated runs. `depth` of a place is the deepest rank at which it is still not the earliest.

Lines are texts between line feeds, compared by a 64-bit hash of the text without white space at its ends. Lines without a
word are no part of the sequence and are never removed. Null texts have no lines and stay null; empty tables give no rows.
Rows that share an id are told apart by their text, rows that share both are treated alike."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed

LEAST = 2
EDGES = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
DOC, AT = "doc", "i"


def _document() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))


def sequence(docs: DataFrame) -> DataFrame:
    """doc, i (place among the lines that have a word), line (place in the text), key. Numbered inside each row, without a shuffle."""
    lines = F.transform(F.split("text", "\n"), lambda x, line: F.struct(line.alias("line"), F.regexp_replace(x, EDGES, "").alias("content")))
    keyed = F.transform(F.filter(lines, lambda x: x["content"] != ""), lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["content"]).alias("key")))
    return (docs.select(_document().alias(DOC), F.posexplode(keyed).alias(AT, "s"))
            .select(DOC, F.col(AT).cast("long").alias(AT), F.col("s.line").alias("line"), F.col("s.key").alias("key")))


def _numbered(places: DataFrame, *by: str) -> DataFrame:
    """What occurs at more than one place, numbered in its order, with the earliest place. Stored, as numbers depend on where
    the sorted partitions are cut."""
    shared = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(DOC, AT)).alias("earliest")).where("n > 1").drop("n")
    return checkpointed(shared.orderBy(*by).withColumn("next", F.monotonically_increasing_id()))


def _ahead(level: DataFrame, shift: int) -> DataFrame:
    """Places with their rank and the rank `shift` lines further on, where that line has one."""
    there = Window.partitionBy(DOC).orderBy(AT).rangeBetween(shift, shift)
    return level.withColumn("then", F.first("rank").over(there)).where("then IS NOT NULL")


def _ranked(level: DataFrame, shift: int) -> tuple[DataFrame, DataFrame]:
    """Ranks at the depth that two ranks `shift` apart give: (doc, i, rank), stored, and the places that aren't the earliest of theirs."""
    pairs = _ahead(level, shift)
    numbers = _numbered(pairs, "rank", "then")
    joined = checkpointed(pairs.join(numbers, ["rank", "then"]).select(DOC, AT, F.col("next").alias("rank"), (F.struct(DOC, AT) != F.col("earliest")).alias("later")))
    return joined.drop("later"), joined.where("later").select(DOC, AT)


def repeats(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The places whose next `least` lines stand at an earlier place too, as (doc, i, depth), and the lines that occur more than once,
    as (doc, i, line, rank). Both are stored."""
    lines = sequence(docs)
    numbers = _numbered(lines, "key")
    once = checkpointed(lines.join(numbers, "key").select(DOC, AT, "line", F.col("next").alias("rank"), (F.struct(DOC, AT) != F.col("earliest")).alias("later")))
    level, later, depth = once.select(DOC, AT, "rank"), once.where("later").select(DOC, AT), 1
    found = [later.where(F.lit(least <= 1)).withColumn("depth", F.lit(1))]
    while True:
        if depth < least <= 2 * depth and least != 2 * depth:
            found.append(_ranked(level, least - depth)[1].withColumn("depth", F.lit(least)))
        level, later = _ranked(level, depth)
        depth *= 2
        if not level.take(1):
            break
        if depth >= least:
            found.append(later.withColumn("depth", F.lit(depth)))
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    return places.groupBy(DOC, AT).agg(F.max("depth").alias("depth")), once.select(DOC, AT, "line", "rank")


def removed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, gone (places in the text of the lines to remove) and deepest, for documents that lose lines. The arrays are as long as a
    document has lines."""
    places, lines = repeats(docs, least)
    covered = places.select(DOC, "depth", F.explode(F.sequence(F.col(AT), F.col(AT) + least - 1)).alias(AT)).groupBy(DOC, AT).agg(F.max("depth").alias("depth"))
    return covered.join(lines.select(DOC, AT, "line"), [DOC, AT]).groupBy(DOC).agg(F.collect_set("line").alias("gone"), F.max("depth").alias("deepest"))


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` with `text` as it is after removal, and n_lines, n_removed, deepest (0: nothing repeated). Other columns pass."""
    own = ["_lines", "_doc", "n_lines", "n_removed", "deepest"]
    rest = [c for c in docs.columns if c not in (*own, "text")]
    gone = removed_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), least).dropDuplicates([DOC]).select(F.col(DOC).alias("_doc"), F.col("gone").alias("_gone"), F.col("deepest").alias("_deepest"))
    lines = F.split(F.col("text"), "\n")
    joined = docs.withColumn("text", F.col("text").cast("string")).withColumn("_doc", _document()).join(gone, "_doc", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.get(F.col("_lines"), i))))
    return joined.withColumn("_lines", lines).select(
        *(F.col(f"`{c}`") for c in rest), text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"), F.coalesce("_deepest", F.lit(0)).alias("deepest"))
