"""Quality rules: n-gram perplexity within bands of the document's language, after plain counts.

The model is an interpolated modified Kneser-Ney model over bytes, of order `ORDER`, one for each value of `lang`. Spark counts
the n-grams of all documents (each task adds up its own first), and joins and aggregates derive continuation counts,
discounts, back-off weights and probabilities, all of which stay. White space counts as one space.

Scoring joins the texts with the model on Spark. Texts are dealt into units of about `UNIT_BYTES`, packed, and shuffled once. A unit asks
for its distinct n-grams, cut by ranges of their hashes; each range of the model answers with probabilities, and the unit adds
them up along its texts. No task holds more of the model than a range or the n-grams of its unit. The model has counted the texts it
scores, so each n-gram has an entry; one without is an error. `Arrays` scores any n-gram, with back-off, where a model fits in memory.

Bands: per language the median of log-perplexity over all documents of at least `LEAST_WORDS` words, and below and above it
`SPREADS` times the distance to the quartile there, but `LEAST_WIDTH` at least. A document outside is rejected, as is
one that fails the base counts. Null languages form a group; null texts have no words and fail."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed
from .words import SPACE, Words, as_strings, inside, inverse, mix, ngrams, powers, slices, text_bytes, BASE, _RANDOM

ORDER = 5
UNIT_BYTES, RANGE_ROWS, ASKED_ROWS = 1 << 25, 1 << 19, 1 << 23
LEAST_WORDS, SPREADS, LEAST_WIDTH = 50, 6.0, 0.1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BYTES = 8 * ORDER
COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def language_key(lang: str | None) -> int:
    """24 bits that stand for a language beside the bytes of an n-gram."""
    data = np.frombuffer(("?" if lang is None else "=" + lang).encode(), np.uint8).astype(np.uint64)
    return int(mix((data * powers(BASE, len(data))).sum(keepdims=True))[0] >> np.uint64(40))


def grams_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, with its language: 24 bits and `ORDER` bytes; and where each text begins."""
    data, offsets = text_bytes(part.column("text"))
    data = np.where(SPACE[data], np.uint8(32), data)
    langs = part.column("lang").to_pylist()
    keys = {lang: language_key(lang) for lang in set(langs)}
    lengths = np.diff(offsets)
    padded = np.zeros(len(data) + (ORDER - 1) * len(lengths), np.uint64)  # zeros stand before each text
    at = np.arange(len(data)) + np.repeat((ORDER - 1) * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = data
    grams = np.zeros(len(padded), np.uint64)
    for back in range(ORDER):
        grams[back:] |= padded[:len(padded) - back] << np.uint64(8 * back)
    language = np.repeat(np.array([keys[lang] for lang in langs], np.uint64), lengths)
    return grams[at] | language << np.uint64(BYTES), offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    def added(held):
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in held])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    held, size = [], 0
    for part in slices(batches):
        grams, _ = grams_of(part)
        if not len(grams):
            continue
        held.append(np.unique(grams, return_counts=True))
        size += len(held[-1][0])
        if size > 2_000_000:
            held = [added(held)]
            size = len(held[0][0])
            if size > 1_000_000:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*added(held))


def _pieces(order: int):
    """Of an n-gram of `order`: language and context, and its suffix of one less."""
    gram, low = F.col("gram"), (1 << 8 * (order - 1)) - 1
    language = F.shiftrightunsigned(gram, BYTES)
    return F.shiftright(gram.bitwiseAND(F.lit((1 << 8 * order) - 1)), 8), gram.bitwiseAND(F.lit(low)), language


def model(docs: DataFrame) -> list[DataFrame]:
    """For each order from 1: lang, gram (its bytes as a number), p (probability), back (weight of what follows it as a context,
    null if nothing does) and n. `docs` has text and lang."""
    # a few tasks for each core are enough to keep all busy, and each adds up more before the shuffle
    tasks = max(32, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    counted = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).coalesce(tasks).mapInArrow(_count, "gram long, n long")
    top = checkpointed(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    tables = {ORDER: top.select(F.shiftrightunsigned("gram", BYTES).alias("lang"), F.col("gram").bitwiseAND(F.lit((1 << BYTES) - 1)).alias("gram"), "n")}
    for order in range(ORDER - 1, 0, -1):  # how many different bytes stand before it
        tables[order] = tables[order + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    out: list[DataFrame] = []
    for order in range(1, ORDER + 1):
        grams = tables[order]
        n = {i: F.count(F.when(F.col("n") == i, 1)).cast("double") for i in range(1, 5)}
        seen = grams.groupBy("lang").agg(*(n[i].alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # with too few n-grams for the usual discounts, half a count
        cut = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.0), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(0.5)
               for i in (1, 2, 3)]
        discounts = seen.select("lang", *(c.alias(f"d{i}") for i, c in enumerate(cut, 1)))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # discounts are one row for each language; a context has at most 256 n-grams, so its window is small
        grams = grams.join(F.broadcast(discounts), "lang").select("lang", "gram", "n", taken.alias("taken"), F.shiftright("gram", 8).alias("context"))
        same = Window.partitionBy("lang", "context")
        total = F.sum("n").over(same)
        direct = grams.select("lang", "gram", "n", "context", ((F.col("n") - F.col("taken")) / total).alias("direct"), (F.sum("taken").over(same) / total).alias("back"))
        contexts = direct.groupBy("lang", "context").agg(F.first("back").alias("back"))
        if order == 1:
            kinds = F.lit(1.0 / 256)
            ready = direct.select("lang", "gram", "n", (F.col("direct") + F.col("back") * kinds).alias("p"))
            root = contexts.select("lang", F.col("back").alias("root"))
            ready = ready.join(root, "lang")
        else:
            lower = out[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
            ready = (direct.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(lower, ["lang", "suffix"])
                     .select("lang", "gram", "n", (F.col("direct") + F.col("back") * F.col("p_lower")).alias("p"), F.lit(None).cast("double").alias("root")))
            weights = contexts.select("lang", F.col("context").alias("gram"), F.col("back").alias("weight"))
            # the zeros before a text are a context, but no n-gram
            out[-1] = out[-1].join(weights, ["lang", "gram"], "full").select(
                "lang", "gram", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(1e-12)).alias("p"), "root", F.col("weight").alias("back"))
        out.append(checkpointed(ready.withColumn("back", F.lit(None).cast("double"))))
    return out


def hashed(keys: np.ndarray, order: int) -> np.ndarray:
    """Hash of language and n-gram (24 bits, then `ORDER` bytes of which the last `order` count)."""
    kept = np.uint64(((1 << 24) - 1) << BYTES | (1 << 8 * order) - 1)
    return mix(((keys & kept) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15))


class Sorted:
    """Sorted hashes, each with a place."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(4, min(22, len(hashes).bit_length() + 1))  # where hashes with the same leading bits begin
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(hashes >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash and whether it has one: from the directory on, hashes are passed while they are smaller."""
        if not len(self.hashes):
            return np.zeros(len(wanted), np.int32), np.zeros(len(wanted), bool)
        last = np.int32(len(self.hashes) - 1)
        at = np.minimum(self.directory[wanted >> self.shift], last)
        there = self.hashes[at]
        behind = np.flatnonzero((there < wanted) & (at < last))
        while len(behind):
            at[behind] += 1
            there[behind] = self.hashes[at[behind]]
            behind = behind[(there[behind] < wanted[behind]) & (at[behind] < last)]
        return at, there == wanted


class Arrays:
    """A whole model in the memory of one process: per order sorted hashes, log-probabilities and log back-off weights."""

    def __init__(self, tables: list[DataFrame]):
        self.orders, self.places = [], []
        for order, frame in enumerate(tables, 1):
            data = frame.select(F.shiftleft("lang", BYTES).bitwiseOR(F.col("gram")).alias("key"), "p", "back").toArrow()
            hashes = hashed(np.asarray(data.column("key"), np.int64).view(np.uint64), order)
            at = np.argsort(hashes)
            back = np.asarray(data.column("back").fill_null(1.0), np.float64)
            self.orders.append((np.log(np.asarray(data.column("p"), np.float64))[at].astype(np.float32), np.log(np.maximum(back, 1e-12))[at].astype(np.float32)))
            self.places.append(Sorted(hashes[at]))
        roots = tables[0].groupBy("lang").agg(F.max("root").alias("root")).collect()  # a row for each language
        self.unknown = {row["lang"]: float(np.log(max(row["root"], 1e-12) / 256)) for row in roots}

    def find(self, keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        return self.places[order - 1].find(hashed(keys, order))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        rest = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            at, there = self.find(keys[rest], order)
            out[rest[there]] += self.orders[order - 1][0][at[there]]
            rest = rest[~there]
            if not len(rest):
                return out
            if order > 1:  # weight of the context, which is an n-gram of one less
                own = keys[rest]
                context = own & np.uint64(((1 << 24) - 1) << BYTES) | (own & np.uint64((1 << 8 * order) - 1)) >> np.uint64(8)
                at, there = self.find(context, order - 1)
                out[rest[there]] += self.orders[order - 2][1][at[there]]
        languages = (keys[rest] >> np.uint64(BYTES)).astype(np.int64)
        for language in np.unique(languages):
            out[rest[languages == language]] += np.float32(self.unknown.get(int(language), np.log(1 / 256)))
        return out


def _run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    words = Words(column)
    data, offsets, n = words.data, words.offsets, len(words.counts)
    solid = ~SPACE[data]
    chars = _run_sums(solid & ((data & 0xC0) != 0x80), offsets)
    symbols = _run_sums(SYMBOLS[data], offsets)
    # lines: they end at a line feed or with the text
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    has_word = _run_sums(solid, np.append(starts, len(data))) > 0
    starts, ends = starts[has_word], ends[has_word]
    document = np.searchsorted(offsets, starts, "right") - 1
    ends = ends - (data[ends - 1] == 10)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(BASE, len(data)), out=sums[1:])
    lines = mix((sums[ends] - sums[starts]) * powers(inverse(BASE), len(data) + 1)[starts])
    alike = np.unique(mix(lines) + document.astype(np.uint64) * np.uint64(BASE), return_index=True)[1]
    duplicate = np.bincount(document, minlength=n) - np.bincount(document[alike], minlength=n)
    # words in windows of three that occur twice
    covered = np.zeros(len(words.starts) + 1, np.int64)
    at = inside(words.first, 3)
    if len(at):
        owner = words.document
        key = mix(ngrams(words.hashes(), 3)[at]) + owner[at].astype(np.uint64) * np.uint64(BASE)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        covered[3:] -= np.bincount(at[twice], minlength=len(covered))[:-3]
    repeated = _run_sums(np.cumsum(covered)[:-1] > 0, words.first)
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicate, "n_repeat_words": repeated}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A compressed block for each unit among some `UNIT_BYTES` of texts."""
    def out(held):
        table = pa.Table.from_batches(held).combine_chunks()
        units = np.asarray(table.column("unit"))
        order = np.argsort(units, kind="stable")
        cuts = np.flatnonzero(np.diff(units[order], prepend=-1, append=-1))
        blocks = []
        for begin, end in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            rows = table.take(pa.array(order[begin:end])).drop_columns(["unit"])
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows)
            blocks.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(units[order][cuts[:-1]]), pa.array(blocks, pa.binary())], names=["unit", "block"])

    held, size = [], 0
    for part in slices(batches):
        held.append(part)
        size += part.nbytes
        if size > UNIT_BYTES:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def _unpacked(blocks: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for block in blocks.to_pylist():
        yield from slices(pa.ipc.open_stream(block))


def _ranges(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Range, first and last place for all ranges of sorted hashes that have any."""
    own = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else []
    return ((int(own[begin]), begin, end) for begin, end in zip(cuts, cuts[1:]))


def _answers(top: DataFrame, packed: DataFrame, bits: int) -> DataFrame:
    """unit, hashes, values: the log-probabilities of all n-grams of each unit, by ranges."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            hashes = hashed(np.concatenate([np.asarray(b.column("key"), np.int64) for b in held]).view(np.uint64), ORDER)
            at = np.argsort(hashes)
            hashes, values = hashes[at], np.log(np.concatenate([np.asarray(b.column("p"), np.float64) for b in held]))[at].astype(np.float32)
            rows = [(r, hashes[a:b].tobytes(), values[a:b].tobytes()) for r, a, b in _ranges(hashes, bits)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["range", "hashes", "values"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > 2_000_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def ask(table: pa.Table) -> pa.Table:
        held, size = [], 0
        for part in _unpacked(table.column("block")):
            held.append(np.unique(grams_of(part)[0]))
            size += len(held[-1])
            if size > 4_000_000:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
        hashes = np.sort(hashed(np.unique(np.concatenate(held)), ORDER)) if held else np.zeros(0, np.uint64)
        rows = [(r, hashes[a:b].tobytes()) for r, a, b in _ranges(hashes, bits)]
        return pa.table({"range": pa.array([r for r, _ in rows], pa.int64()), "unit": pa.array([table.column("unit")[0].as_py()] * len(rows), pa.int64()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        hashes, values = (np.frombuffer(b"".join(known.column(c).to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("values", np.float32)))
        order = np.argsort(hashes)
        places, values, out = Sorted(hashes[order]), values[order], []
        for wanted in asked.column("hashes").to_pylist():
            at, there = places.find(np.frombuffer(wanted, np.uint64))
            if not there.all():
                raise ValueError("the model lacks n-grams of the texts: it must be counted over the same rows")
            out.append(values[at].tobytes())
        return pa.table({"unit": asked.column("unit"), "hashes": asked.column("hashes"), "values": pa.array(out, pa.binary())})

    model_rows = top.select(F.shiftleft("lang", BYTES).bitwiseOR(F.col("gram")).alias("key"), "p").mapInArrow(entries, "range long, hashes binary, values binary")
    asked = packed.groupBy("unit").applyInArrow(ask, "range long, unit long, hashes binary")
    return model_rows.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(answer, "unit long, hashes binary, values binary")


def measure(docs: DataFrame, top: DataFrame) -> DataFrame:
    """The base counts and log_perplexity (per byte; null for an empty text) of every row. `top` is the highest order of the
    model of these rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    units, entries = max(4 * cores, -(-size // UNIT_BYTES)), top.count()
    ranges = max(4 * cores, -(-entries // RANGE_ROWS), -(-min(size, units * entries) // ASKED_ROWS))
    # what decides on the unit is the row alone, so that both readers below deal alike; they share one shuffle
    packed = docs.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units))).mapInArrow(_packed, "unit long, block binary")

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, values = (np.frombuffer(b"".join(answers.column(c).to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("values", np.float32)))
        order = np.argsort(hashes)
        places, values, out = Sorted(hashes[order]), values[order], []
        for part in _unpacked(texts.column("block")):
            found = counts_of(part.column("text"))
            grams, offsets = grams_of(part)
            at, there = places.find(hashed(grams, ORDER))
            if not there.all():
                raise ValueError("n-grams of a unit without an answer")
            sums = np.concatenate([[0.0], np.cumsum(values[at], dtype=np.float64)])
            sizes = np.diff(offsets)
            mean = -(sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, sizes)
            out.append(pa.table([part.column("doc_id"), part.column("lang"), *(pa.array(v.astype(np.int64)) for v in found.values()), pa.array(mean, mask=sizes == 0)],
                                names=["doc_id", "lang", *found, "log_perplexity"]))
        return pa.concat_tables(out)

    answers = _answers(top, packed, (ranges - 1).bit_length())
    return packed.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(run, COUNTS + ", log_perplexity double")


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed, the band of the language, and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    at = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = measured.where(F.col("n_words") >= LEAST_WORDS).groupBy(F.col("lang").alias("band_lang")).agg(at.alias("at"))
    low, middle, high = (F.col("at")[i] for i in range(3))
    bands = bands.select("band_lang", (middle - F.greatest(SPREADS * (middle - low), F.lit(LEAST_WIDTH))).alias("lower"),
                         (middle + F.greatest(SPREADS * (high - middle), F.lit(LEAST_WIDTH))).alias("upper"))
    inside_band = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return (measured.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
            .withColumn("base_failed", failed).withColumn("kept", ~failed & inside_band))


def quality(docs: DataFrame) -> DataFrame:
    """Counts, perplexity and verdict of every row of `docs` (doc_id, lang, text). What is measured is kept in the checkpoint
    folder, as bands need it before verdicts do."""
    return judge(checkpointed(measure(docs, model(docs)[-1])))
