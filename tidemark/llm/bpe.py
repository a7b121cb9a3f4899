"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every neighbouring pair that has a rank waits in the bucket of that rank, which
holds list positions. Which buckets hold anything is kept in a bitmap of three levels, so that find-first-set gives the
lowest rank in three steps, whatever the length. Entries are never deleted: one whose pair has changed since is passed over
when its bucket is emptied. The work is proportional to the bytes of a pre-token (each merge adds at most two entries), so
one pre-token of a megabyte costs what a megabyte of short ones does.

Null texts are empty and give no ids; other columns are ignored."""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .pretokens import PieceMemory, rank_table
from .words import as_strings, slices

SLICE = 1 << 22


class RankQueue:
    """Buckets of positions per rank; each level's word has a bit per 64 words below it."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.high = 0

    def push(self, rank: int, position) -> None:
        """A position, or an array of positions; buckets of positions are heaps."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position) if isinstance(position, int) else bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, top = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[top] = self.middle.get(top, 0) | 1 << (word & 63)
        self.high |= 1 << top

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        if not self.high:
            return -1
        top = (self.high & -self.high).bit_length() - 1
        bits = self.middle[top]
        word = top << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        """Drop the bucket of a rank."""
        del self.buckets[rank]
        word, top = rank >> 6, rank >> 12
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.middle[top] ^= 1 << (word & 63)
            if not self.middle[top]:
                self.high ^= 1 << top


class BytePairs:
    """Encoding by ranks: the lowest-ranked neighbouring pair merges first, the leftmost of equals before the others."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        #: rank of the token that two tokens make, filled as pairs are met
        self.pair_rank: dict[tuple[int, int], int] = {}

    def _rank(self, left: int, right: int) -> int:
        found = self.pair_rank.get((left, right))
        if found is None:
            found = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            if len(self.pair_rank) >= 1_000_000:
                self.pair_rank.clear()
            self.pair_rank[left, right] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        token = [self.byte_rank[b] for b in piece]
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue, rank_of = RankQueue(), self._rank
        waiting = [-1] * n  # the rank under which the pair that begins here waits now
        for i in range(n - 1):
            rank = rank_of(token[i], token[i + 1])
            if rank >= 0:
                waiting[i] = rank
                queue.push(rank, i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            while bucket:
                i = heappop(bucket)
                if waiting[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[j]
                token[i], after[i], waiting[j] = rank, k, -1
                token[j] = -1
                lowest = rank
                if k < n:
                    before[k] = i
                    waiting[i] = other = rank_of(rank, token[k])
                    if other >= 0:
                        queue.push(other, i)
                        lowest = min(lowest, other)
                else:
                    waiting[i] = -1
                h = before[i]
                if h >= 0:
                    waiting[h] = other = rank_of(token[h], rank)
                    if other >= 0:
                        queue.push(other, h)
                        lowest = min(lowest, other)
                if lowest < rank:  # a lower rank has come up: it goes first
                    break
            if not bucket:
                queue.close(rank)
        return [t for t in token if t >= 0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PairTable:
    """Ranks of neighbouring tokens, for arrays of them: sorted keys and their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[left] << 32 | ranks[right], rank) for token, rank in ranks.items() for cut in range(1, len(token))
                 if (left := token[:cut]) in ranks and (right := token[cut:]) in ranks]
        found.sort()
        self.keys, self.ranks = (np.array(column, np.int64) for column in zip(*found))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two make no token; a token of -1 is the end of a piece."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def encode_many(pieces: list[bytes], pairs: BytePairs, table: PairTable) -> list[bytes]:
    """Ids of many short pieces as bytes. They lie in one linked list with a stop between two, and one rank queue holds
    the pairs of all: when a rank comes up, the leftmost such pair of every piece merges at once. Pieces don't touch,
    so each piece sees its own merges in the order in which it would alone."""
    if not pieces:
        return []
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    stops = np.cumsum(lengths + 1) - 1
    token = np.full(len(piece) + 1, -1, np.int64)  # the last entry also stands before the first
    body = np.ones(len(piece), bool)
    body[stops] = False
    token[:-1][body] = np.array(pairs.byte_rank, np.int64)[data]
    after = np.arange(1, len(token) + 1)
    before = np.arange(-1, len(token) - 1)
    waiting = np.full(len(token), -1, np.int64)
    waiting[:-1] = table(token[:-1], token[1:])
    queue = RankQueue()

    def push(ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for begin, end in zip(cuts, cuts[1:]):
            queue.push(int(ranks[begin]), positions[begin:end])

    some = np.flatnonzero(waiting >= 0)
    if len(some):
        push(waiting[some], some)
    while (rank := queue.first()) >= 0:
        bucket = queue.buckets[rank]
        at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
        at = at[waiting[at] == rank]  # the others are stale
        if len(at) > 1:
            owner = piece[at]
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = owner[1:] != owner[:-1]
            rest, at = at[~leftmost], at[leftmost]
        else:
            rest = at[:0]
        if len(rest):
            bucket[:] = [rest]
        else:
            queue.close(rank)
        if not len(at):
            continue
        gone = after[at]
        following = after[gone]
        token[at], token[gone], waiting[gone] = rank, -2, -1
        after[at], before[following] = following, at
        previous = before[at]
        right = table(token[at], token[following])
        left = table(token[previous], token[at])
        waiting[at], waiting[previous] = right, left
        ranks, positions = np.concatenate([right, left]), np.concatenate([at, previous])
        some = ranks >= 0
        if some.any():
            push(ranks[some], positions[some])
    kept = token[:-1] >= 0
    ids = token[:-1][kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(piece[kept], minlength=len(pieces)))).tolist()
    return [ids[begin:end] for begin, end in zip([0, *ends], ends)]


class Encoder:
    """Ids of whole texts by a published rank file and splitting pattern."""

    def __init__(self, ranks: str, pattern: str):
        self.pairs, self.split = BytePairs(rank_table(ranks)), regex.compile(pattern)
        self.table = PairTable(self.pairs.ranks)
        self.memory = PieceMemory(self._one)

    def _one(self, piece: str) -> bytes:
        ids = array("I")
        for part in self.split.findall(piece):
            ids.extend(self.pairs.encode(part.encode()))
        return ids.tobytes()

    def _many(self, pieces: list[str]) -> list[bytes]:
        ranks, whole = self.pairs.ranks, []
        parts = [[part.encode() for part in self.split.findall(piece)] for piece in pieces]
        new = list({part for own in parts for part in own if part not in ranks})
        known = dict(zip(new, encode_many(new, self.pairs, self.table)))
        for own in parts:
            whole.append(b"".join(known[part] if part in known else ranks[part].to_bytes(4, "little") for part in own))
        return whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.memory.ids_of_all(texts, self._many)

    def decode(self, ids: bytes) -> bytes:
        return self.pairs.decode(memoryview(ids).cast("I"))


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Every row of `docs` with its ids and the bytes they decode to: doc_id, ids (binary, little-endian 32 bits), decoded (binary)."""
    return _mapped(docs, ranks, pattern, lambda ids, decoded: (ids, decoded), "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """As `encode_documents`, but with digests instead of ids and bytes, which then never leave the worker."""
    def digest(ids: bytes, decoded: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _mapped(docs, ranks, pattern, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, ranks: str, pattern: str, derive, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for part in slices(batches, most=SLICE):
            encoded = encoder.encode(as_strings(part.column("text")).to_pylist())
            rows = [(doc, *derive(ids, encoder.decode(ids))) for doc, ids in zip(part.column("doc_id").to_pylist(), encoded)]
            names = [field.split()[0] for field in schema.split(", ")]
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(values, types[field.split()[1]]) for values, field in zip(zip(*rows), schema.split(", "))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
