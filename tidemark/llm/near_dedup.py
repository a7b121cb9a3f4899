"""Near-duplicates by a signature-coordinate inverted join.

1. Every document gets the set of its word shingles and a MinHash signature of `COORDINATES` values. Documents with the same set are
   one node from here on, named by the smallest id.
2. Each (coordinate, value) pair is a posting list. Lists of one document go first, and with them every document that has too few
   pairs left to reach MATCHES collisions. Pairs have a global order, rare ones first; two documents with MATCHES collisions
   share one of the first COORDINATES - MATCHES + 1 pairs of each, so a document is posted under these only.
3. In a list, collisions are counted on whole signatures; a partner whose set size rules the similarity out is skipped. Documents
   with MATCHES collisions are of one family.
4. In a family, links are confirmed on full sets: 100 * intersection >= percent * union. Components of confirmed links are the
   classes.

Neither lists nor families are expanded into pairs. Each has a pivot, which all members meet; those who match it are linked to it. A
member and its pivot meet once, however many lists they share. Groups whose members are then known to be connected are done. In the
others, members unlike the pivot meet each other, and those not too far from the pivot (by the triangle inequality of both
distances) meet the ones that match it; pairs of one component are skipped. Only ids travel until it is clear who meets: members
are dealt to units of at most `UNIT_BYTES` of signatures or sets, and a unit compares tiles of `BLOCK` by `BLOCK` by products of matrices
and returns only the links that join a tile's members to their smallest. A group of u members unlike its pivot costs at most
u times its size in comparisons, and its sets are copied once per `UNIT_BYTES` of them.

Null and empty texts have no set and are linked with nothing. Texts of fewer words than a shingle have one, the whole sequence. Nodes are the
different sets: rows that share an id are linked with each other, whether their texts are the same or not. Rows without an id
link nobody; they are of the class that has their set. MATCHES is the largest count that a link at the threshold misses with a chance below
`MISSES` (1 in 20,000): 27 at 80 percent, 30 at 85."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed
from .components import components
from .words import Words, mix, ngrams, slices

COORDINATES, MISSES = 48, 1 / 20_000
BLOCK, UNIT_ROWS, UNIT_BYTES, TASK_BYTES = 512, 8192, 1 << 23, 1 << 25
_SEEDS = np.random.default_rng(77).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int) -> int:
    """Collisions that a pair must have: as many as all but `MISSES` of the pairs at the threshold reach."""
    p, tail = percent / 100, 0.0
    for count in range(COORDINATES + 1):
        tail += comb(COORDINATES, count) * p ** count * (1 - p) ** (COORDINATES - count)  # at most `count` collisions
        if tail >= MISSES:
            break
    if not count:
        raise ValueError(f"{COORDINATES} coordinates are too few for {percent} percent")
    return count


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts one after the other, sorted within each, and where each text begins."""
    words = Words(column, lower=True)
    hashes, counts, first = words.hashes(), words.counts, words.first
    number = np.where(counts >= size, counts - size + 1, 0)
    document = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(document)) - np.repeat(np.cumsum(number) - number, number) + first[:-1][document]
    grams = ngrams(hashes, size)[at]
    for n in range(1, size):  # the short ones
        some = np.flatnonzero(counts == n)
        if len(some):
            grams = np.concatenate([grams, mix(ngrams(hashes, n)[first[:-1][some]] + np.uint64(n))])
            document = np.concatenate([document, some])
    order = np.lexsort((grams, document))
    grams, document = grams[order], document[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (document[1:] != document[:-1])
    grams, document = grams[new], document[new]
    return grams, np.searchsorted(document, np.arange(len(counts) + 1))


def set_names(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits for each set of shingles, as two signed longs; sets begin at `starts` and are not empty."""
    name = np.empty((len(starts), 2), np.uint64)
    if len(starts):
        name[:, 0] = np.add.reduceat(mix(grams), starts)
        name[:, 1] = np.bitwise_xor.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return name.view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, begin = shingle_sets(part.column("text"), size)
            sizes = np.diff(begin)
            some = sizes > 0
            signature = np.zeros((len(sizes), COORDINATES), np.uint32)
            name = np.zeros((len(sizes), 2), np.int64)
            if some.any():
                starts = begin[:-1][some]
                for j, seed in enumerate(_SEEDS):
                    signature[some, j] = np.minimum.reduceat(grams * seed, starts) >> np.uint64(32)
                name[some] = set_names(grams, starts)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(sizes), pa.array(name[:, 0]), pa.array(name[:, 1]),
                pa.array([row.tobytes() for row in signature], pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return run


def _least_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each of the ids left and right reaches over the links of a boolean matrix."""
    left, right = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    rows, columns = linked.any(1), linked.any(0)
    linked = linked[rows][:, columns]
    if not linked.size:
        return left, right
    a, b = left[rows], right[columns]
    while True:
        b_new = np.minimum(b, np.where(linked, a[:, None], top).min(0))
        a_new = np.minimum(a, np.where(linked, b_new, top).min(1))
        if (a_new == a).all() and (b_new == b).all():
            break
        a, b = a_new, b_new
    left[rows], right[columns] = a, b
    return left, right


NEAR, SHELL, FAR = 0, 1, 2  # matches the pivot; may match one that does; can't


def _meet_pivots(pairs: DataFrame, payloads: DataFrame, levels: Callable) -> DataFrame:
    """(id, p_id, level) of the pairs, stored."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                level = levels(part.column("payload").to_pylist(), np.asarray(part.column("n")),
                               part.column("p_payload").to_pylist(), np.asarray(part.column("p_n")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("p_id"), pa.array(level.astype(np.int32))], names=["id", "p_id", "level"])

    theirs = payloads.select(F.col("id").alias("p_id"), F.col("n").alias("p_n"), F.col("payload").alias("p_payload"))
    return checkpointed(pairs.join(payloads, "id").join(theirs, "p_id").mapInArrow(meet, "id long, p_id long, level int"))


def _units(members: DataFrame) -> DataFrame:
    """Where the members (grp, id, bytes, level, component) of undecided groups meet: kind, u, m, side per unit, stored."""
    counts = [F.max("component").alias("top"), F.min("component").alias("low")]
    for name, which in (("unlike", F.col("level") > NEAR), ("near", F.col("level") == NEAR), ("shell", F.col("level") == SHELL)):
        rows, size = F.count(F.when(which, 1)), F.coalesce(F.sum(F.when(which, F.col("bytes"))), F.lit(0))
        counts.append(F.greatest(F.ceil(rows / UNIT_ROWS), F.ceil(size / UNIT_BYTES)).cast("int").alias(name))  # in units
    undecided = members.groupBy("grp").agg(*counts).where("top <> low")
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    unit = lambda kind, u, m, side: F.struct(F.lit(kind).alias("kind"), u.alias("u"), m.alias("m"), side.cast("int").alias("side"))
    every = lambda count, make: F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)
    none = F.array().cast("array<struct<kind:int,u:int,m:int,side:int>>")
    among = every("unlike", lambda x: unit(0, F.least(own("unlike"), x), F.greatest(own("unlike"), x), own("unlike") > x))
    near = every("near", lambda x: unit(1, own("unlike"), x, F.lit(0)))
    theirs = every("unlike", lambda x: unit(1, x, own("near"), F.lit(1)))
    shell = F.col("level") == SHELL
    units = F.when(F.col("level") > NEAR, F.concat(among, F.when(shell, near).otherwise(none))).otherwise(F.when(F.col("shell") > 0, theirs).otherwise(none))
    return checkpointed(members.join(undecided, "grp").select("grp", "id", "bytes", "component", F.inline(units)))


def _compare_units(in_block: Callable):
    def compare(table: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        table = table.sort_by([(c, "ascending") for c in ("grp", "kind", "u", "m", "side", "component", "id")])
        key = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("grp", "kind", "u", "m", "side")])
        ids, n, component = (np.asarray(table.column(c)) for c in ("id", "n", "component"))
        payload = table.column("payload").to_pylist()
        unit = np.flatnonzero(np.concatenate([[True], (key[:4, 1:] != key[:4, :-1]).any(0)])) if table.num_rows else []
        for begin, end in zip(unit, [*unit[1:], table.num_rows]):
            alone = key[1, begin] == 0 and key[2, begin] == key[3, begin]  # a block with itself
            middle = end if alone else begin + int(np.searchsorted(key[4, begin:end], 1))
            for i in range(begin, middle, BLOCK):
                left = slice(i, min(i + BLOCK, middle))
                for j in range(i if alone else middle, end, BLOCK):
                    right = slice(j, min(j + BLOCK, end))
                    if component[left][0] == component[left][-1] == component[right][0] == component[right][-1]:
                        continue  # sorted: all of one component
                    linked = in_block(payload[left], n[left], payload[right], n[right])
                    linked |= ids[left, None] == ids[None, right]
                    for own, label in zip((ids[left], ids[right]), _least_labels(linked, ids[left], ids[right])):
                        out_a.append(own[own != label])
                        out_b.append(label[own != label])
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
        return pa.table({"a": joined[0], "b": joined[1]})

    return compare


def _classes(groups: DataFrame, payloads: DataFrame, levels: Callable, in_block: Callable) -> DataFrame:
    """id, component of the members that links inside groups connect. groups: grp, id, rank (the greatest becomes the pivot), bytes (of the
    payload); payloads: id, n, payload. `levels(payloads, sizes, pivot payloads, pivot sizes)` gives NEAR, SHELL or FAR row by row,
    `in_block(payloads, sizes, payloads, sizes)` a matrix of links."""
    pivots = groups.groupBy("grp").agg(F.max(F.struct("rank", "id")).alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    paired = groups.join(pivots, "grp").select("grp", "id", "bytes", F.col("pivot.id").alias("p_id"))
    met = _meet_pivots(paired.where("id <> p_id").select("id", "p_id").distinct(), payloads, levels)
    near = met.where(F.col("level") == NEAR).select(F.col("id").alias("a"), F.col("p_id").alias("b"))
    # one step towards components: the smallest matching pivot, and the smallest that this one matches; same names are connected
    hooks = near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("hook"))
    hooks = hooks.select("id", F.least("hook", "id").alias("hook"))
    onward = hooks.select(F.col("id").alias("hook"), F.col("hook").alias("next"))
    hooks = hooks.join(onward, "hook", "left").select("id", F.coalesce("next", "hook").alias("component"))
    members = (paired.join(met, ["id", "p_id"], "left").join(hooks, "id", "left")
               .select("grp", "id", "bytes", F.coalesce("level", F.lit(NEAR)).alias("level"), F.coalesce("component", "id").alias("component")))
    units = _units(checkpointed(members))  # stored, so that plans stay small
    size = units.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if not size["rows"]:
        return components(near)
    bucket = F.pmod(F.xxhash64("grp", "kind", "u", "m"), F.lit(max(8, -(-size["bytes"] // TASK_BYTES), -(-size["rows"] // (4 * UNIT_ROWS))))).alias("bucket")
    far = units.join(payloads, "id").groupBy(bucket).applyInArrow(_compare_units(in_block), "a long, b long")
    return components(near.union(far))


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _signature_rules(percent: int):
    least = matches(percent)

    def matrix(payloads) -> np.ndarray:
        return np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), COORDINATES)

    def pivot(own, n, theirs, m):
        count = (matrix(own) == matrix(theirs)).sum(1)
        return np.where((count >= least) & _fits(n, m, percent), NEAR, np.where(count >= 2 * least - COORDINATES, SHELL, FAR))

    def block(own, n, theirs, m):
        a, b = matrix(own), matrix(theirs)
        count = np.zeros((len(a), len(b)), np.uint8)
        for j in range(COORDINATES):
            count += a[:, j, None] == b[None, :, j]
        return (count >= least) & _fits(n[:, None], m[None], percent)

    return pivot, block


def _set_rules(percent: int):
    def flat(payloads):
        return np.frombuffer(b"".join(payloads), np.uint64)

    def enough(common, n, m):
        return 100 * common >= percent * (n + m - common)

    def pivot(own, n, theirs, m):
        common = np.fromiter((len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                              for a, b in zip(own, theirs)), np.int64, len(own))
        return np.where(enough(common, n, m), NEAR, np.where(100 * common >= (2 * percent - 100) * (n + m - common), SHELL, FAR))

    def block(own, n, theirs, m):
        a, b = flat(own), flat(theirs)
        row, column = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
        shared = np.intersect1d(a, b)
        at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
        in_a, in_b = at_a < len(shared), at_b < len(shared)
        in_a[in_a] = shared[at_a[in_a]] == a[in_a]
        in_b[in_b] = shared[at_b[in_b]] == b[in_b]
        row, at_a, column, at_b = row[in_a], at_a[in_a], column[in_b], at_b[in_b]
        common = np.zeros((len(n), len(m)), np.float32)
        for begin in range(0, len(shared), 4096):
            x, y = np.zeros((len(n), 4096), np.float32), np.zeros((len(m), 4096), np.float32)
            some = (at_a >= begin) & (at_a < begin + 4096)
            x[row[some], at_a[some] - begin] = 1
            some = (at_b >= begin) & (at_b < begin + 4096)
            y[column[some], at_b[some] - begin] = 1
            common += x @ y.T
        return enough(common.astype(np.int64), n[:, None], m[None])

    return pivot, block


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text). Signatures, families and their sets are stored in the
    checkpoint folder between the steps."""
    least = matches(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = checkpointed(docs.mapInArrow(_sign(size), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"))
    named = ["set_a", "set_b", "n_shingles"]
    filled = signed.where("n_shingles > 0")
    sets = filled.groupBy(*named).agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("payload"))
    nodes = checkpointed(sets.select(*named, "doc_id", "payload", F.monotonically_increasing_id().alias("id")))  # stored: the numbers stay
    signatures = nodes.where("doc_id IS NOT NULL").select("id", F.col("n_shingles").alias("n"), "payload")

    posted = signatures.mapInArrow(_posted, "id long, pair long")
    counts = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = posted.join(counts, "pair")
    order, all_own = Window.partitionBy("id").orderBy("often", "pair"), Window.partitionBy("id")
    placed = (shared.withColumn("place", F.row_number().over(order)).withColumn("left", F.count(F.lit(1)).over(all_own))
              .withColumn("score", F.sum("often").over(all_own)).where(F.col("left") >= least))
    # pairs of one document stand before all others in the order
    prefix = placed.where(F.col("place") + (COORDINATES - F.col("left")) <= COORDINATES - least + 1)
    prefix = checkpointed(prefix.select(F.col("pair").alias("grp"), "id", F.col("score").alias("rank"), F.lit(4 * COORDINATES).cast("long").alias("bytes")))
    families = _classes(prefix, signatures, *_signature_rules(percent))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, begin = shingle_sets(part.column("text"), size)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            name = set_names(grams, begin[some])
            right = (name[:, 0] == np.asarray(part.column("set_a"))[some]) & (name[:, 1] == np.asarray(part.column("set_b"))[some])
            some = some[right]  # an id may have further texts
            payload = pa.array([grams[begin[i]:begin[i + 1]].tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("grp").take(pa.array(some)), part.column("id").take(pa.array(some)), pa.array(n[some]),
                                              part.column("rank").take(pa.array(some)), payload], names=["grp", "id", "n", "rank", "payload"])

    rank = prefix.groupBy("id").agg(F.max("rank").alias("rank"))
    family = families.select("id", F.col("component").alias("grp")).join(rank, "id").join(nodes.select("id", "doc_id", "set_a", "set_b"), "id")
    texts = docs.join(family, "doc_id").select("grp", "id", "rank", "set_a", "set_b", "text")
    full = texts.mapInArrow(full_sets, "grp long, id long, n long, rank long, payload binary").groupBy("id").agg(
        *(F.first(c).alias(c) for c in ("grp", "n", "rank", "payload")))  # the same text may be there twice
    full = checkpointed(full)
    linked = _classes(full.select("grp", "id", "rank", (8 * F.col("n")).alias("bytes")), full.select("id", "n", "payload"), *_set_rules(percent))

    if not filled.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        numbered = filled.select(*named, "doc_id").join(nodes.select(*named, "id"), named).where("doc_id IS NOT NULL")
        smallest = numbered.groupBy("doc_id").agg(F.min("id").alias("b"))
        same_id = numbered.join(smallest, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")
        linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same_id))
    found = nodes.select(*named, "doc_id", "id").join(linked, "id", "left").select(*named, "doc_id", F.coalesce("component", "id").alias("component"))
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = found.join(smallest, "component").select(*named, "component_id")
    out = signed.join(found, named, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each coordinate of a signature: the pair as one number."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("payload").to_pylist()), np.uint32).reshape(batch.num_rows, COORDINATES).astype(np.uint64)
        pairs = values | np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("id")), COORDINATES)), pa.array(pairs.reshape(-1).view(np.int64))], names=["id", "pair"])
