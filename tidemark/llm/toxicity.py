"""Toxicity scores of whole documents by a bidirectional gated recurrent network with attention pooling.

A word enters the network as two vectors side by side: one of the word itself (hashed) and one of its characters: the
element-wise largest of the vectors of its byte 4-grams, edges included, so that unseen forms of a known word are
recognised. Windows of `SPAN` words, each beginning `STEP` words after the one before it and the last ending with the
document, so that any `SPAN - STEP` words that follow each other stand whole in one, are read in both directions; attention weighs the states, and their weighted sum gives a window's logit. A document
scores as its most toxic window. Training (numpy, in one task) takes a bounded sample of labelled documents; every window
of every document is scored on the executors.

Null and empty texts have one window without words. Labels other than 0 and 1 are left out of the sample, of repeated labels
the larger counts. Without both classes in the sample no network is trained and all scores are 0."""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import SLICE_BYTES, Words, as_strings, mix, slices

SPAN, STEP = 64, 32
HIDDEN, WORD_SIZE, CHAR_SIZE, ATTENTION = 8, 12, 12, 8
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 16
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 800, 1600, 1 << 15
BATCH = 2048
KEEP_WORD, DECAY = 0.3, 2e-3


@dataclass
class Vocabulary:
    """The different words of some texts: row of each in the word table, its 4-grams' rows, and where these begin."""
    word_row: np.ndarray
    gram_row: np.ndarray
    begin: np.ndarray


def read_words(column: pa.Array) -> tuple[Words, Vocabulary, np.ndarray]:
    """Words of the texts in lower case, the different ones, and which of them each word is."""
    words = Words(column, lower=True)
    hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    starts, lengths = words.starts[first], (words.ends - words.starts)[first]
    # bytes of the different words with one edge mark before and two behind
    begin = np.concatenate([[0], np.cumsum(lengths + 3)])
    owner = np.repeat(np.arange(len(first)), lengths + 3)
    place = np.arange(begin[-1]) - begin[owner]
    inner = (place > 0) & (place <= lengths[owner])
    marked = np.full(len(owner), 1, np.uint64)
    marked[inner] = words.data[(starts[owner] + place - 1)[inner]]
    marked = np.concatenate([marked, np.ones(3, np.uint64)])
    grams = mix(marked[:-3] << np.uint64(24) | marked[1:-2] << np.uint64(16) | marked[2:-1] << np.uint64(8) | marked[3:])
    whole = place < lengths[owner]  # a word of n bytes and its edges has n grams
    rows = (grams[whole] % np.uint64(CHAR_ROWS)).astype(np.int64)
    return words, Vocabulary((hashes % np.uint64(WORD_ROWS)).astype(np.int64), rows, np.cumsum(np.concatenate([[0], lengths]))[:-1]), which.reshape(-1)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of each window; every document has one at least."""
    counts = np.diff(first)
    number = 1 + np.maximum(0, -((SPAN - counts) // STEP))
    document = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(document)) - np.repeat(np.cumsum(number) - number, number)
    start = np.minimum(place * STEP, np.maximum(0, counts[document] - SPAN))
    return document, first[:-1][document] + start, np.minimum(SPAN, counts[document])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        shapes = {"word": (WORD_ROWS, WORD_SIZE), "char": (CHAR_ROWS, CHAR_SIZE), "attend": (ATTENTION, 2 * h), "attend_b": (ATTENTION, 1),
                  "focus": (1, ATTENTION), "out": (1, 2 * h), "out_b": (1, 1)}
        for way in ("f", "b"):
            shapes |= {f"in_{way}": (3 * h, size), f"bias_{way}": (3 * h, 1), f"again_{way}": (3 * h, h)}
        spread = {"word": 0.0, "char": 0.02}
        return cls({k: (rng.normal(0, spread.get(k, 1 / np.sqrt(s[1])), s) * (not k.startswith(("bias", "attend_b", "out_b")))).astype(np.float32) for k, s in shapes.items()})

    def vectors(self, vocabulary: Vocabulary, keep_word: np.ndarray | None = None) -> np.ndarray:
        """(features, different words + 1); the last is the vector of no word."""
        w = self.weights
        word = w["word"][vocabulary.word_row]
        if keep_word is not None:
            word = word * keep_word[:, None]
        chars = np.maximum.reduceat(w["char"][vocabulary.gram_row], vocabulary.begin, axis=0) if len(vocabulary.begin) else np.zeros((0, CHAR_SIZE), np.float32)
        both = np.concatenate([word, chars], axis=1)
        return np.concatenate([both, np.zeros((1, both.shape[1]), np.float32)]).T.copy()

    def run(self, projected: dict[str, np.ndarray], index: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows. index: (SPAN, windows) into the vocabulary. With `keep`, also what training needs."""
        w, h = self.weights, HIDDEN
        span, n = index.shape
        state = np.empty((span, 2 * h, n), np.float32)
        real = (np.arange(span)[:, None] < lengths).astype(np.float32)
        ragged = not real.all()
        kept: dict = {"f": [], "b": []}
        for way, part, times in (("f", slice(0, h), range(span)), ("b", slice(h, 2 * h), range(span - 1, -1, -1))):
            again, now = w[f"again_{way}"], np.zeros((h, n), np.float32)
            for t in times:
                x = projected[way].take(index[t], axis=1)
                u = again @ now
                gates = _sigmoid(x[:2 * h] + u[:2 * h])
                z, r = gates[:h], gates[h:]
                new = np.tanh(x[2 * h:] + r * u[2 * h:])
                then = new + z * (now - new)
                if ragged:
                    then = now + real[t] * (then - now)
                if keep:
                    kept[way].append((t, now, z, r, new, u[2 * h:]))
                state[t, part] = now = then
        hidden = np.tanh(np.matmul(w["attend"], state) + w["attend_b"])
        focus = np.matmul(w["focus"], hidden)[:, 0]
        focus = np.where(real > 0, focus, np.float32(-1e9))
        focus = np.exp(focus - focus.max(0))
        focus *= real
        share = focus / np.maximum(focus.sum(0), np.float32(1e-9))
        pooled = (state * share[:, None]).sum(0)
        logits = (w["out"] @ pooled + w["out_b"])[0]
        return (logits, (state, real, hidden, share, pooled, kept)) if keep else logits

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {way: self.weights[f"in_{way}"] @ vectors + self.weights[f"bias_{way}"] for way in ("f", "b")}

    def gradient(self, index: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary, labels: np.ndarray, weight: np.ndarray, keep_word: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.weights, HIDDEN
        vectors = self.vectors(vocabulary, keep_word)
        logits, (state, real, hidden, share, pooled, kept) = self.run(self.project(vectors), index, lengths, keep=True)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        d = ((_sigmoid(logits) - labels) * weight).astype(np.float32)[None]
        g["out"], g["out_b"] = d @ pooled.T, d.sum(1, keepdims=True)
        d_pooled = w["out"].T @ d
        d_state = share[:, None] * d_pooled
        d_share = (state * d_pooled).sum(1)
        d_focus = share * (d_share - (share * d_share).sum(0))
        g["focus"] = np.einsum("tn,tan->a", d_focus, hidden)[None]
        d_hidden = w["focus"].T[None] * d_focus[:, None] * (1 - hidden ** 2)
        g["attend"], g["attend_b"] = np.einsum("tan,thn->ah", d_hidden, state), d_hidden.sum((0, 2))[:, None]
        d_state += np.matmul(w["attend"].T, d_hidden)
        d_vectors = np.zeros_like(vectors)
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            d_projected = np.zeros((vectors.shape[1], 3 * h), np.float32)
            carry = np.zeros((h, index.shape[1]), np.float32)
            for t, now, z, r, new, u_new in reversed(kept[way]):
                d_then = d_state[t, part] + carry
                m = real[t]
                d_in = d_then * m
                d_new = d_in * (1 - z) * (1 - new ** 2)
                d_z = d_in * (now - new) * z * (1 - z)
                d_r = d_new * u_new * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r])
                carry = d_then * (1 - m) + d_in * z + w[f"again_{way}"].T @ d_u
                g[f"again_{way}"] += d_u @ now.T
                np.add.at(d_projected, index[t], np.concatenate([d_z, d_r, d_new]).T)
            d_projected = d_projected.T
            g[f"in_{way}"], g[f"bias_{way}"] = d_projected @ vectors.T, d_projected.sum(1, keepdims=True)
            d_vectors += w[f"in_{way}"].T @ d_projected
        d_vectors = d_vectors.T[:-1]
        np.add.at(g["word"], vocabulary.word_row, d_vectors[:, :WORD_SIZE] * keep_word[:, None])
        owner = np.repeat(np.arange(len(vocabulary.begin)), np.diff(np.append(vocabulary.begin, len(vocabulary.gram_row))))
        chosen = w["char"][vocabulary.gram_row] == vectors.T[:-1, WORD_SIZE:][owner]
        np.add.at(g["char"], vocabulary.gram_row, chosen * d_vectors[owner, WORD_SIZE:])
        return g

    def window_logits(self, vocabulary: Vocabulary, which: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        projected = self.project(self.vectors(vocabulary))
        out = np.empty(len(start), np.float32)
        for begin in range(0, len(start), BATCH):
            part = slice(begin, begin + BATCH)
            out[part] = self.run(projected, window_index(which, start[part], length[part], len(vocabulary.word_row)), length[part])
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        """Score of each text."""
        words, vocabulary, which = read_words(column)
        document, start, length = windows(words.first)
        logits = self.window_logits(vocabulary, which, start, length)
        best = np.maximum.reduceat(logits.astype(np.float64), np.searchsorted(document, np.arange(len(words.first) - 1)))
        return 1 / (1 + np.exp(-np.clip(self.scale * best + self.shift, -500, 500)))


def window_index(which: np.ndarray, start: np.ndarray, length: np.ndarray, nothing: int) -> np.ndarray:
    at = np.arange(SPAN)[:, None]
    index = np.append(which, nothing)[np.minimum(start + at, len(which))]
    return np.where(at < length, index, nothing)


def _adam(network: Network, moments: dict, gradient: dict, step: int, rate: float) -> None:
    for k, g in gradient.items():
        m, v = moments.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        if k in ("word", "char"):
            network.weights[k] *= np.float32(1 - DECAY)
        network.weights[k] -= np.float32(rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)) * m / (np.sqrt(v) + np.float32(1e-7))


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 10, least_steps: int = 300, batch: int = 256, seed: int = 7) -> Network | None:
    """Fit on documents. In the first round a window takes its document's label. From then on a toxic document is
    represented by its most toxic window, and clean windows are half those that look most toxic, half drawn. At last the
    two numbers that turn the highest logit into a score are fitted."""
    if len(set(labels.tolist())) < 2:
        return None
    network, rng = Network.fresh(seed), np.random.default_rng(seed)
    words, vocabulary, which = read_words(texts)
    document, start, length = windows(words.first)
    target = labels[document].astype(np.float32)
    moments: dict = {}
    step = 0
    for epoch in range(rounds):
        toxic, clean = np.flatnonzero(target == 1), rng.permutation(np.flatnonzero(target == 0))
        if epoch:
            logits = network.window_logits(vocabulary, which, start, length)
            ranked = np.lexsort((-logits[toxic], document[toxic]))
            toxic = toxic[ranked[np.diff(document[toxic][ranked], prepend=-1) > 0]]
            many = max(256, len(toxic))
            hard = clean[np.argsort(-logits[clean], kind="stable")]
            pool = [toxic, hard[:many], clean[:many]]
        else:
            pool = [toxic, clean[:2 * len(toxic)]]
        pool = np.concatenate(pool)
        passes = max(2 if epoch else 1, -(-least_steps * batch // (rounds * len(pool))))
        order = np.concatenate([rng.permutation(pool) for _ in range(passes)])
        for begin in range(0, len(order), batch):
            part = order[begin:begin + batch]
            used, index = np.unique(window_index(which, start[part], length[part], len(vocabulary.word_row)), return_inverse=True)
            index = index.reshape(SPAN, -1)
            real = used[used < len(vocabulary.word_row)]
            ends = np.append(vocabulary.begin, len(vocabulary.gram_row))
            sizes = ends[real + 1] - ends[real]
            begins = np.cumsum(sizes) - sizes
            rows = np.arange(int(sizes.sum())) - np.repeat(begins, sizes) + np.repeat(ends[real], sizes)
            own = Vocabulary(vocabulary.word_row[real], vocabulary.gram_row[rows], begins)
            step += 1
            keep_word = (rng.random(len(real)) < KEEP_WORD).astype(np.float32) / np.float32(KEEP_WORD)
            gradient = network.gradient(index, length[part], own, target[part], np.full(len(part), 1 / len(part), np.float32), keep_word)
            _adam(network, moments, gradient, step, 0.01 * (1 - 0.8 * epoch / rounds))
    best = np.maximum.reduceat(network.window_logits(vocabulary, which, start, length).astype(np.float64), np.searchsorted(document, np.arange(len(labels))))
    network.scale, network.shift = _calibrate(best, labels)
    return network


def _calibrate(best: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic fit of one number, pulled slightly towards (1, 0), by Newton's method with halved steps."""
    x = np.stack([best, np.ones_like(best)])
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(value):
        s = np.clip(value @ x, -40, 40)
        return (np.log1p(np.exp(s)) - labels * s).sum() + 0.05 * ((value - prior) ** 2).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        slope = x @ (p - labels) + 0.1 * (theta - prior)
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.1 * np.eye(2), slope)
        while loss(theta - move) > loss(theta) and np.abs(move).max() > 1e-9:
            move /= 2
        theta = theta - move
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Network | None:
    """Train on documents whose crc32(doc_id as text) modulo `fold` is not 0: at most `SAMPLE_TOXIC` and `SAMPLE_CLEAN` of each
    class, the first by a hash of their id of those that `docs` holds with texts of at most `SAMPLE_BYTES`. The bounded sample is gathered in
    one task, which trains and returns the network; None where a class has no such document."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
             .where(F.crc32(F.col("doc_id").cast("string")) % fold != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    here = known.join(short.select("doc_id"), "doc_id", "left_semi")  # before the limit: labels may be those of other documents

    def part(toxic: int, most: int) -> DataFrame:
        picked = here.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        return short.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(most).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"doc_id": [], "text": pa.array([], pa.string()), "toxic": []})]).sort_by("doc_id")
        network = train(as_strings(rows.column("text")), np.asarray(rows.column("toxic"), np.int64)) if rows.num_rows else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], names=["network"])

    sample = part(1, SAMPLE_TOXIC).union(part(0, SAMPLE_CLEAN)).coalesce(1)
    found = sample.mapInArrow(run, "network binary").collect()
    return pickle.loads(found[0]["network"]) if found else None


def score(docs: DataFrame, network: Network | None, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted and trained of every row of `docs`. The network (under 7 MB, whatever the input) is broadcast. Without
    one `trained` is false and all scores are 0."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in slices(batches, most=SLICE_BYTES):
            scores = net.score(part.column("text")) if net else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(np.full(part.num_rows, net is not None))],
                                             names=["doc_id", "held_out", "score", "predicted", "trained"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, trained boolean")


def clean(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in slices(batches, most=SLICE_BYTES):
            yield part.filter(pa.array(net.score(part.column("text")) < 0.5)) if net else part

    return docs.mapInArrow(run, docs.schema)
