"""The best combination of one, two or three members, by meeting in the middle.

Members are ordered by size. For each pair only those thirds are looked at, found by binary search, whose size brings the sum into the band; once
a combination is known that covers as many classes as the pair can reach, only those at least as close to the target. Classes are bit
sets. Members of one size and one set of classes can replace each other, so only the first few names of each are kept. No triples
are rows; tasks share out the first members and each returns its best."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

SEED, CHUNK, PAIRS = 32, 1 << 18, 1 << 10


class Search:
    """The best combination so far: inside the band by coverage, distance and names, else the closest by distance and names."""

    def __init__(self, sizes: np.ndarray, names: np.ndarray, bits: np.ndarray, total: int, target: float, band: float):
        self.n, self.rank, self.bits = sizes.astype(np.int64), names.astype(np.int64), bits
        self.total, self.target, self.band = total, target, band
        if len(sizes) >= 1 << 21:
            raise ValueError("more than two million members after removing alike ones; narrow the pool")
        self.most = int(np.bitwise_count(bits).sum(1, dtype=np.int64).max(initial=0))
        self.full = int(np.bitwise_count(np.bitwise_or.reduce(bits, axis=0)).sum()) if len(bits) else 0
        self.best: dict[bool, tuple] = {}  # outside: (-coverage, distance, name key, positions)

    def distance(self, sums: np.ndarray) -> np.ndarray:
        return np.abs(sums / self.total - self.target)

    def offer(self, positions: np.ndarray, outside: bool) -> None:
        """Combinations as rows of positions; those on the other side of the band are ignored."""
        away = self.distance(self.n[positions].sum(1))
        right = (away > self.band) == outside
        positions, away = positions[right], away[right]
        if not len(positions):
            return
        covered = np.zeros(len(positions), np.int64)
        if not outside:
            union = self.bits[positions[:, 0]]
            for column in positions.T[1:]:
                union = union | self.bits[column]
            covered = np.bitwise_count(union).sum(1, dtype=np.int64)
        top = np.flatnonzero(covered == covered.max())
        top = top[away[top] == away[top].min()]
        ranks = np.sort(self.rank[positions[top]], axis=1) + 1
        key = np.zeros(len(top), np.int64)
        for column in range(3):  # a name that is a beginning of another comes first, as in arrays
            key = key << 21 | (ranks[:, column] if column < ranks.shape[1] else 0)
        one = key.argmin()
        found = (-int(covered[top[one]]), float(away[top[one]]), int(key[one]), tuple(positions[top[one]]))
        self.best[outside] = min(self.best.get(outside, found), found)

    def reach(self, away: float) -> tuple[int, int]:
        """Sums that may be as close as this to the target."""
        return int(np.floor((self.target - away) * self.total)) - 1, int(np.ceil((self.target + away) * self.total)) + 1

    def thirds(self, a: int, outside: bool) -> None:
        """All triples that begin with position a and may be better than the best so far."""
        for begin in range(a + 1, len(self.n), PAIRS):
            b = np.arange(begin, min(begin + PAIRS, len(self.n)))
            sums, known = self.n[a] + self.n[b], self.best.get(outside)
            if outside:
                if known is None or known[1] > 0:  # the closest third of each pair first
                    at = np.searchsorted(self.n, self.target * self.total - sums)
                    near = np.concatenate([np.stack([np.full_like(b, a), b, np.clip(at + d, b + 1, len(self.n) - 1)], 1) for d in (-1, 0, 1)])
                    self.offer(near[near[:, 2] > near[:, 1]], outside)
                    known = self.best.get(outside)
                    if known is None:
                        continue
                low, high = self.reach(known[1])
                lo, hi = np.full(len(b), low), np.full(len(b), high)
            else:
                low, high = self.reach(self.band)
                lo, hi = np.full(len(b), low), np.full(len(b), high)
                if known is not None:
                    bound = np.minimum(self.full, np.bitwise_count(self.bits[a] | self.bits[b]).sum(1, dtype=np.int64) + self.most)
                    same, (low, high) = bound == -known[0], self.reach(known[1])
                    lo[same], hi[same] = low, high
                    hi[bound < -known[0]] = -1
            first = np.maximum(np.searchsorted(self.n, lo - sums, "left"), b + 1)
            count = np.maximum(np.searchsorted(self.n, hi - sums, "right") - first, 0)
            self._expand(a, b, first, count, outside)

    def _expand(self, a: int, b: np.ndarray, first: np.ndarray, count: np.ndarray, outside: bool) -> None:
        upto = np.cumsum(count)
        for begin in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
            at = np.arange(begin, min(begin + CHUNK, int(upto[-1])))
            pair = np.searchsorted(upto, at, "right")
            self.offer(np.stack([np.full_like(at, a), b[pair], first[pair] + at - (upto[pair] - count[pair])], 1), outside)


def best_of(ks: Sequence[int], target: float, band: float):
    """Arrow function of one unit (bucket, buckets, participant_id, n, events, classes): the best combinations whose smallest member falls to it."""
    def run(table: pa.Table) -> pa.Table:
        names = np.array(table.column("participant_id").to_pylist(), dtype=object)
        sizes = np.asarray(table.column("n"))
        by_name = np.empty(len(names), np.int64)
        by_name[sorted(range(len(names)), key=lambda i: names[i])] = np.arange(len(names))
        order = np.lexsort((by_name, sizes))
        classes = table.column("classes").combine_chunks().take(pa.array(order))
        owner = np.repeat(np.arange(len(order)), np.asarray(classes.value_lengths()))
        known, bit = np.unique(np.asarray(classes.flatten()), return_inverse=True)
        bits = np.zeros((len(order), max(1, -(-len(known) // 64))), np.uint64)
        np.bitwise_or.at(bits, (owner, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        names = names[order]
        search = Search(sizes[order], by_name[order], bits, table.column("events")[0].as_py(), target, band)

        rich = np.sort(np.argsort(-np.bitwise_count(bits).sum(1, dtype=np.int64), kind="stable")[:SEED])  # a first answer, so that less is looked at
        i, j, k = np.meshgrid(rich, rich, rich, indexing="ij")
        if 3 in ks:
            search.offer(np.stack([x[(i < j) & (j < k)] for x in (i, j, k)], 1), False)
        own = np.arange(table.column("bucket")[0].as_py(), len(order), table.column("buckets")[0].as_py())
        for outside in (False, True):
            if outside and False in search.best:
                break
            if 1 in ks:
                search.offer(own[:, None], outside)
            for a in own if max(ks) > 1 else ():
                later = np.arange(a + 1, len(order))
                if 2 in ks:
                    search.offer(np.stack([np.full_like(later, a), later], 1), outside)
                if 3 in ks:
                    search.thirds(int(a), outside)
        out = [(sorted(names[list(at)]), int(search.n[list(at)].sum()), away, outside, -covered) for outside, (covered, away, _, at) in search.best.items()]
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.list_(pa.string()), pa.int64(), pa.float64(), pa.bool_(), pa.int32())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["names", "n", "distance", "outside", "coverage"])

    return run


def thirds_in_band(sums: pa.Table, sizes: pa.Table) -> pa.Table:
    """Of pair sums (s, ways) and all sizes (n, m, low, high): how many thirds bring them to low .. high, and the events of these triples."""
    if not sums.num_rows or not sizes.num_rows or sizes.column("low")[0].as_py() is None:
        return pa.table({"c": pa.array([0], pa.int64()), "e": pa.array([0], pa.int64())})
    sizes = sizes.sort_by("n")
    n, m, s, ways = (np.asarray(t.column(c)).astype(np.int64) for t, c in ((sizes, "n"), (sizes, "m"), (sums, "s"), (sums, "ways")))
    low, high = (sizes.column(c)[0].as_py() for c in ("low", "high"))
    count, events = (np.concatenate([[0], np.cumsum(x)]) for x in (m, m * n))
    first, last = np.searchsorted(n, low - s, "left"), np.searchsorted(n, high - s, "right")
    thirds = count[last] - count[first]
    return pa.table({"c": [int((ways * thirds).sum())], "e": [int((ways * (thirds * s + events[last] - events[first])).sum())]})
