"""Removal of word passages that also stand in an earlier document, by compressed FM-indexes.

Every window of `least` words belongs to its anchor: of the n-grams of `ANCHOR` words inside it, the one with the smallest hash, so
equal windows have equal anchors wherever they stand. Anchors that only one document has are counted out first. Around each other
anchor a document gives a fragment, the words of all windows that belong to it; fragments with one anchor meet in one shard, and
fragments that are alike within a part of the table travel once. An anchor that is found at very many places is spread: its windows travel
singly, each by its own hash, so no shard gathers what one common passage brings.

A shard's different fragments form one text, which is indexed by a suffix array cut at depth 64, its Burrows-Wheeler transform and a
wavelet matrix of packed bits with rank counts. Documents' fragments are streamed through it by backward search, one word at a time
from their end; at `least` words the match is reported and widened to its parent one word shallower, so every window costs one step.
A match is the suffix-array interval of a window, and the smallest document in it decides: a window goes if that document is smaller
than its own.

Words are compared by 48 bits of a hash. Null and empty texts have no words. Rows without an id neither lose words nor cost others any.
Rows that share an id are told apart by their text, and are not earlier than each other. Other columns are ignored."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .words import SPACE, Words, inside, mix, ngrams, powers, slices

LEAST, ANCHOR = 50, 16
OFTEN = 1 << 14
SLICE = 1 << 20
SHARD_WORDS = 1 << 19
WORD_BYTES = 6


class Anchored:
    """Windows of a slice of texts, grouped by anchor: anchor, document, first and last window start (places in the slice)."""

    def __init__(self, words: Words, least: int):
        self.hashes = words.hashes()
        starts = inside(words.first, least)
        if not len(starts):
            self.anchor = np.zeros(0, np.int64)
            self.document = self.begin = self.end = np.zeros(0, np.int64)
            return
        grams = ngrams(self.hashes, ANCHOR)
        mask = np.uint64((1 << 20) - 1)
        place = np.arange(len(grams), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts)[:len(grams)].astype(np.uint64)
        least_of = (grams & ~mask) | (place & mask)  # of equal hashes the leftmost
        width, span = 1, least - ANCHOR + 1
        while 2 * width <= span:
            least_of = np.minimum(least_of[:-width], least_of[width:])
            width *= 2
        if span > width:
            least_of = np.minimum(least_of[:-(span - width)], least_of[span - width:])
        at = starts + ((least_of[starts] - place[starts]) & mask).astype(np.int64)
        owner = words.document[starts]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
        self.begin, self.end = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        self.anchor, self.document = grams[at[first]].view(np.int64), owner[first]


class FMIndex:
    """Backward search over a sequence of symbols that ends in a stop (0, which matches nothing)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.depth = len(text), depth
        rank = text.astype(np.int64)
        needed = {1 << ((d or 1).bit_length() - 1) for d in (depth, depth - 1)}
        ranks, k = {1: rank}, 1
        while k < depth:
            later = np.zeros(self.n, np.int64)
            later[:-k or None] = rank[k:] + 1 if k < self.n else 0
            rank = np.unique(rank * np.int64(self.n + int(rank.max(initial=0)) + 2) + later, return_inverse=True)[1].reshape(-1)
            k *= 2
            if k in needed:
                ranks[k] = rank
        self.suffixes = np.argsort(rank, kind="stable")
        before = text[self.suffixes - 1].copy()
        before[self.suffixes == 0] = 0
        self.symbols = int(text.max(initial=0)) + 1
        self.levels = []
        now = before
        for bit in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            words = np.packbits(np.pad(ones, (0, -len(ones) % 64 + 64)), bitorder="little").view(np.uint64)
            sums = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            self.levels.append((bit, words, sums, int((~ones).sum())))
            now = np.concatenate([now[~ones], now[ones]])
        every = np.arange(self.symbols)
        counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))[:-1]])
        self.base = counts - self._descend(every, np.zeros(self.symbols, np.int64))
        self.at_depth, self.parent = self._groups(ranks, depth), self._groups(ranks, depth - 1)

    def _groups(self, ranks: dict[int, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the suffix array the interval of suffixes that share its first `depth` symbols."""
        power = 1 << (depth.bit_length() - 1)
        rank, shift = ranks[power], depth - power
        second = np.zeros(self.n, np.int64)
        second[:self.n - shift] = rank[shift:] + 1
        a, b = rank[self.suffixes], second[self.suffixes]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        sizes = np.diff(np.append(first, self.n))
        return np.repeat(first, sizes), np.repeat(first + sizes, sizes)

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for bit, words, sums, zeros in self.levels:
            at = places >> 6
            ones = sums[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            places = np.where(symbols >> bit & 1, zeros + ones, places - ones)
        return places

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left; empty where it doesn't occur."""
        base = self.base[symbols]
        return base + self._descend(symbols, low), base + self._descend(symbols, high)

    def matches(self, pattern: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, low, high) for every window of `depth` symbols of any pattern that occurs. A window that fails at some symbol tells
        which windows to its left can't occur either; the search goes on with the next that can."""
        out, end = [], len(pattern)
        low, high, begin = np.array([0]), np.array([self.n]), end
        while end >= self.depth:
            if begin == end - self.depth:
                out.append((begin, int(low[0]), int(high[0])))
                low, high, end = self.parent[0][low], self.parent[1][low], end - 1
                continue
            symbol = pattern[begin - 1:begin]
            if 0 < symbol[0] < self.symbols:
                low, high = self.step(symbol, low, high)
            if not 0 < symbol[0] < self.symbols or low[0] >= high[0]:
                end = end - 1 if 0 < symbol[0] < self.symbols and begin < end else begin - 1
                low, high, begin = np.array([0]), np.array([self.n]), end
                continue
            begin -= 1
        return out

    def stream(self, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, visit) -> None:
        """Backward search over many parts of the indexed text at once; `visit(parts, starts, low)` gets each window's match."""
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), self.n)
        active = np.arange(len(begins))
        for t in range(int(sizes.max(initial=0))):
            longer = sizes[active] > t
            active, low, high = active[longer], low[longer], high[longer]
            place = sizes[active] - 1 - t
            low, high = self.step(text[begins[active] + place], low, high)
            if t + 1 >= self.depth:
                visit(active, place, low)
                low, high = self.parent[0][low], self.parent[1][low]


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            found = Anchored(Words(part.column("text")), least)
            order = np.lexsort((found.anchor, found.document))
            document, anchor = found.document[order], found.anchor[order]
            first = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (anchor[1:] != anchor[:-1])])) if len(order) else order
            rows = pa.array(document[first])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), part.column("doc_id").take(rows), part.column("h").take(rows), pa.array(np.diff(np.append(first, len(order))))],
                                             names=["anchor", "doc_id", "h", "places"])

    return run


FRAGMENT = "key long, alike long, doc_id long, h long, start long, words binary"


def _fragments(least: int):
    """Of documents with `shared` anchors (anchor, often). Of fragments that are alike in a slice only the first carries its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some_shared = (batch.filter(pc.is_valid(batch.column("shared"))) for batch in batches)
        for part in slices(some_shared, most=SLICE):
            words = Words(part.column("text"))
            found = Anchored(words, least)
            lists = part.column("shared")
            wanted = lists.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
            salt = mix(np.arange(1, part.num_rows + 1, dtype=np.uint64))
            want = np.asarray(wanted.field("anchor")).view(np.uint64) ^ salt[owner]
            often = set((want[np.asarray(wanted.field("often"))]).tolist())
            mine = found.anchor.view(np.uint64) ^ salt[found.document]
            some = np.isin(mine, want)
            begin, end, key, document = found.begin[some], found.end[some], found.anchor[some], found.document[some]
            if often:
                single = np.isin(mine[some], np.fromiter(often, np.uint64, len(often)))
                number = np.where(single, end - begin + 1, 1)
                each = np.repeat(np.arange(len(begin)), number)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
                single = single[each]
                begin = begin[each] + offset
                end = np.where(single, begin, end[each])
                key, document = key[each].copy(), document[each]
                key[single] = ngrams(found.hashes, least)[begin[single]].view(np.int64) if single.any() else key[single]
            size = end - begin + least
            grams = np.zeros(len(found.hashes) + 1, np.uint64)
            np.cumsum(found.hashes * powers(0xD6E8FEB86659FD93, len(found.hashes)), out=grams[1:])
            back = powers(pow(0xD6E8FEB86659FD93, -1, 1 << 64), len(found.hashes) + 1)
            alike = mix((grams[begin + size] - grams[begin]) * back[begin] + size.astype(np.uint64))
            first = np.zeros(len(begin), bool)
            first[np.unique(alike, return_index=True)[1]] = True
            short = np.ascontiguousarray(found.hashes.view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES:])
            content = [short[b:b + n].tobytes() if new else None for b, n, new in zip(begin.tolist(), size.tolist(), first.tolist())]
            rows = pa.array(document)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(alike.view(np.int64)), part.column("doc_id").take(rows), part.column("h").take(rows), pa.array(begin - words.first[:-1][document]), pa.array(content, pa.binary())],
                names=["key", "alike", "doc_id", "h", "start", "words"])

    return run


def _search(rows: list[pa.Table], least: int) -> pa.RecordBatch:
    """What goes of the rows of a shard: doc_id, h, start, n."""
    table = pa.concat_tables(rows).combine_chunks()
    documents = np.asarray(table.column("doc_id"))
    _, which = np.unique(np.asarray(table.column("alike")), return_inverse=True)
    which = which.reshape(-1)
    content: list = [None] * (int(which.max(initial=-1)) + 1)
    for i, words in zip(which.tolist(), table.column("words").to_pylist()):
        if words is not None:
            content[i] = words
    sizes = np.fromiter((len(c) // WORD_BYTES for c in content), np.int64, len(content))
    smallest = np.full(len(content), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, documents)
    flat = np.zeros((int(sizes.sum()), 8), np.uint8)
    flat[:, :WORD_BYTES] = np.frombuffer(b"".join(content), np.uint8).reshape(-1, WORD_BYTES)
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    body = np.ones(len(text), bool)
    body[begins + sizes] = False
    text[body] = np.unique(flat.view(np.uint64).reshape(-1), return_inverse=True)[1].reshape(-1) + 1
    index = FMIndex(text, least)
    owner = np.repeat(np.arange(len(content)), sizes + 1)
    first = np.flatnonzero(index.at_depth[0] == np.arange(len(text)))
    lowest = np.repeat(np.minimum.reduceat(smallest[owner[index.suffixes]], first), np.diff(np.append(first, len(text))))
    found = np.full(len(text), np.iinfo(np.int64).max)  # at each window's start, the smallest document that has it

    def visit(parts: np.ndarray, starts: np.ndarray, low: np.ndarray) -> None:
        found[begins[parts] + starts] = lowest[low]

    index.stream(text, begins, sizes, visit)
    out = []
    starts, number = np.asarray(table.column("start")), sizes - least + 1
    for row, (c, doc) in enumerate(zip(which.tolist(), documents.tolist())):
        goes = found[begins[c]:begins[c] + number[c]] < doc
        if goes.all():
            out.append((row, starts[row], number[c] + least - 1))
        elif goes.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], goes.astype(np.int8), [0]])))
            out += [(row, starts[row] + a, b - a + least - 1) for a, b in zip(edge[::2], edge[1::2])]
    row, start, n = np.array(out, np.int64).reshape(-1, 3).T
    return pa.RecordBatch.from_arrays([table.column("doc_id").take(pa.array(row)).combine_chunks(), table.column("h").take(pa.array(row)).combine_chunks(), pa.array(start), pa.array(n)], names=["doc_id", "h", "start", "n"])


def _shards(least: int):
    """Over rows sorted by key: shards of about `SHARD_WORDS` words, never cut inside a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            weight = np.cumsum(_lengths(batch.column("words")))
            begin = 0
            if held and len(keys) and keys[0] != last and size >= SHARD_WORDS:
                yield _search(held, least)
                held, size = [], 0
            for end in ends:
                here = (weight[end - 1] - (weight[begin - 1] if begin else 0)) // WORD_BYTES if end > begin else 0
                if end < len(keys) and size + here >= SHARD_WORDS:
                    held.append(pa.Table.from_batches([batch.slice(begin, end - begin)]))
                    yield _search(held, least)
                    held, size, begin = [], 0, end
            if begin < len(keys):
                held.append(pa.Table.from_batches([batch.slice(begin)]))
                size += int((weight[-1] - (weight[begin - 1] if begin else 0)) // WORD_BYTES)
                last = keys[-1]
        if held:
            yield _search(held, least)

    return run


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)


def earlier_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, h, start, n: runs of words (they may overlap) to remove. docs: doc_id, text, h (a hash of the text), and what else there is."""
    anchors = docs.select("doc_id", "text", "h").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_anchors(least), "anchor long, doc_id long, h long, places long")
    shared = (anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("places").alias("n"))
              .where("low < high").select("anchor", (F.col("n") > OFTEN).alias("often")))
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "often")).alias("shared"))
    # the left side is, column by column, that of the join which applies the result, so texts are shuffled once for both
    fragments = docs.join(wanted, ["doc_id", "h"], "left").select(*docs.columns, "shared").mapInArrow(_fragments(least), FRAGMENT)
    return fragments.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(least), "doc_id long, h long, start long, n long")


def kept_bytes(words: Words, keep: np.ndarray) -> list[bytes]:
    """Of each text the kept words, joined by one space."""
    data, offsets = words.data, words.offsets
    change = np.zeros(len(data) + 1, np.int32)
    change[words.starts[keep]] += 1
    change[words.ends[keep]] -= 1
    stay = np.cumsum(change)[:-1] > 0
    gaps = words.ends[keep]
    gaps = gaps[gaps < offsets[1:][words.document[keep]]]
    stay[gaps] = True
    out = np.where(SPACE[data], np.uint8(32), data)[stay].tobytes()
    ends = np.concatenate([[0], np.cumsum(stay)])[offsets]
    return [out[a:b].rstrip(b" ") for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _apply(derive, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            words = Words(part.column("text"))
            spans = part.column("spans")
            flat = spans.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(spans.offsets)))
            change = np.zeros(len(words.starts) + 1, np.int64)
            start = words.first[:-1][owner] + np.asarray(flat.field("start"))
            np.add.at(change, start, 1)
            np.add.at(change, start + np.asarray(flat.field("n")), -1)
            keep = np.cumsum(change)[:-1] == 0
            removed = np.bincount(words.document[~keep], minlength=part.num_rows)
            texts = kept_bytes(words, keep)
            own = [part.column(name) for name in part.schema.names if name not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts), pa.array(removed.astype(np.int64)), derive(part, texts, removed)], names=names)

    return run


def _with_spans(docs: DataFrame, least: int) -> DataFrame:
    docs = docs.withColumn("h", F.xxhash64("text"))
    spans = (earlier_passages(docs, least)
             .groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    return docs.join(spans, ["doc_id", "h"], "left").withColumn("spans", F.coalesce("spans", none)).drop("h")


def remove_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return _with_spans(plain, least).select("doc_id", "text", "spans").mapInArrow(
        _apply(lambda part, texts, removed: pa.array([hashlib.sha256(t).hexdigest() for t in texts]), ["doc_id", "n_words", "n_removed", "kept_sha256"]), schema)


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` with the texts as they are after removal: texts that lose words become the kept words joined by one space, others stay.
    Documents that lose all their words are left out. Other columns pass, whatever they are called."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def texts_of(part: pa.RecordBatch, texts: list[bytes], removed: np.ndarray) -> pa.Array:
        return pa.array([t.decode() if gone else old for t, gone, old in zip(texts, removed.tolist(), part.column("text").to_pylist())], pa.string())

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    done = _with_spans(rows, least).select("row", "text", "spans").mapInArrow(_apply(texts_of, ["row", "n_words", "n_removed", "text"]), schema)
    return done.where("n_removed = 0 OR n_removed < n_words").select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
