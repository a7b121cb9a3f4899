"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: text between two block-level tags, with the path of open elements above it (names, ids,
words of classes). A bidirectional LSTM in numpy reads the page's blocks in order, each as a vector of its path, a vector of
its hashed words and a few measures, and labels every block as article or not. It sees the whole page, whatever its length.

Labels for training come from the pages: what stands in a landmark (`article`, `main`) and not in a navigation, side or
comment element is article; without landmarks, all blocks of the innermost container that holds over half of the text which is neither linked nor in
elements named like page furniture, headings and short blocks included. Sampled pages are also shown with other names for the same elements and with further furniture (sidebars, notices, forms, comments
of readers), so that neither a name nor a place alone decides. The sample is bounded: `SAMPLE_PAGES` pages of any size, of each the first and last
`SAMPLE_BLOCKS` blocks with at most `SAMPLE_TEXT` code points each; one task trains on it. All pages are labelled whole on the executors.

Scripts, styles, heads, comments, templates and form controls hold no blocks. Character references are decoded, white space
inside a block becomes one space, blocks are joined by one line feed. Null and empty pages, and pages without an article block,
give an empty text. Unclosed and stray tags are tolerated. Rows with equal ids are pages of their own."""
from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import Words, as_strings, slices

SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_TEXT = 240, 200, 2000
PATH_ROWS, WORD_ROWS = 1 << 12, 1 << 13
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 16, 8, 4, 16
# HTML elements by what they do to text.
BREAKING = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul
    caption label""".split())
CONTAINERS = frozenset("article body center div main section td".split())
SILENT = frozenset("script style template noscript head title textarea select button option svg math iframe object canvas audio video".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("""nav aside footer form header menu menubar navbar navigation sidebar footer ad ads advert advertisement banner promo sponsored
    sponsor cookie consent notice newsletter subscribe comment comments respond disqus related share social breadcrumb widget popup modal""".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, attributes: str) -> str:
    """A path entry: the element and the words of its class, id and role."""
    if not attributes:
        return tag
    words = [w for found in _NAMED.findall(attributes) for w in re.split(r"[^a-z0-9]+", "".join(found).lower()) if w]
    return " ".join([tag, *words])


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, position, link_depth = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(entry for _, entry in stack), text, linked))
            parts.clear()
        linked = 0

    def leave(name: str) -> bool:
        nonlocal link_depth
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                link_depth -= sum(tag == "a" for tag, _ in stack[depth:])
                del stack[depth:]
                return True
        return False

    page = page or ""
    while True:
        found = _TOKEN.search(page, position)
        text = page[position:found.start() if found else len(page)]
        if text:
            parts.append(text)
            if link_depth:
                linked += len(text)
        if not found:
            break
        position = found.end()
        closing, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                end = _CLOSE[tag].search(page, position)
                if tag == "head" and not end:  # a head that never closes hides nothing
                    continue
                position = end.end() if end else len(page)
            continue
        if tag in BREAKING:
            flush()
            if closing:
                leave(tag)
            else:
                if tag in ("p", "li", "td", "th", "tr", "dd", "dt"):
                    if any(name == tag for name, _ in stack[-4:]):
                        _close_same(stack, tag, leave)
                elif stack and any(name == "p" for name, _ in stack[-3:]):
                    leave("p")
                if tag not in EMPTY:
                    stack.append((tag, _names(tag, attributes)))
        elif tag == "br":
            parts.append(" ")
        elif tag not in EMPTY and not attributes.endswith("/"):
            if closing:
                leave(tag)
            else:
                stack.append((tag, _names(tag, attributes)))
                link_depth += tag == "a"
    flush()
    return out


def _close_same(stack: list[tuple[str, str]], tag: str, leave) -> None:
    """An item closes an open one of its kind, unless a list or table has begun in between."""
    for name, _ in reversed(stack):
        if name == tag:
            leave(tag)
            return
        if name in BREAKING:
            return


def weak_labels(page: list[Block]) -> np.ndarray:
    """1 for the blocks that count as article when the network is trained."""
    heads = [{entry.split()[0] for entry in block.path} for block in page]
    named = [{word for entry in block.path for word in entry.split()} & FURNITURE for block in page]
    if any(h & {"article", "main"} for h in heads):
        return np.array([bool(h & {"article", "main"}) and not n for h, n in zip(heads, named)], np.float32)
    # without landmarks: all that stands in the innermost container with over half of the text that is neither linked nor in furniture
    text = [0 if n else len(b.text) - b.linked for b, n in zip(page, named)]
    inside: dict[tuple[str, ...], int] = {}
    for block, size in zip(page, text):
        for end in range(len(block.path) + 1):
            if end and block.path[end - 1].split()[0] in CONTAINERS:
                inside[block.path[:end]] = inside.get(block.path[:end], 0) + size
    most = [path for path, size in inside.items() if 2 * size > sum(text)]
    home = max(most, key=len, default=())
    menu = [b.path[-1:] == ("li",) and b.linked >= len(b.text) for b in page]
    return np.array([not n and not m and b.path[:len(home)] == home for b, n, m in zip(page, named, menu)], np.float32)


# Other ways in which pages name the same things.
_ARTICLE = [("article",), ("main",), ("main", "article"), ("div content",), ("div content main",), ("div post body",), ("section entry content",),
            ("div article body",), ("div story",), ("div text",)]
_OTHERS = {"nav": [("nav",), ("div nav",), ("div menu",), ("header", "nav"), ("div navbar",), ("ul menu",)],
           "footer": [("footer",), ("div footer",), ("div copyright",), ("footer site footer",)],
           "ad": [("div ad",), ("div ads",), ("div advert",), ("aside promo",), ("div sponsored",), ("ins adsbygoogle",), ("div banner",)]}
_EXTRA = [(("aside",), "li", 3), (("div sidebar",), "p", 3), (("aside", "ul related"), "li", 4), (("div cookie notice",), "p", 1), (("div consent banner",), "p", 1),
          (("form newsletter",), "label", 2), (("form",), "p", 2), (("section comments", "div comment"), "p", 4), (("div comments", "article comment"), "p", 4),
          (("ol commentlist", "li comment"), "p", 3), (("header",), "p", 2), (("header site header",), "h1", 1), (("div share social",), "li", 3),
          (("article", "section comments"), "p", 3), (("article", "aside"), "p", 2), (("div breadcrumb",), "li", 3), (("div popup modal",), "p", 2)]


def varied(page: list[Block], labels: np.ndarray, others: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The same page with elements of other names and with further furniture around the article."""
    names = _ARTICLE[rng.integers(len(_ARTICLE))]
    swaps = {kind: ways[rng.integers(len(ways))] for kind, ways in _OTHERS.items()}
    out, marks = [], []

    def renamed(entry: str, label: float) -> tuple[str, ...]:
        words = entry.split()
        if label and words[0] in ("article", "main"):
            return names
        return next((ways for kind, ways in swaps.items() if kind in words), (entry,))

    for block, label in zip(page, labels):
        out.append(Block(tuple(n for entry in block.path for n in renamed(entry, label)), block.text, block.linked))
        marks.append(label)
    for _ in range(int(rng.integers(1, 4))):
        above, leaf, most = _EXTRA[rng.integers(len(_EXTRA))]
        inside = np.flatnonzero(np.array(marks) > 0)
        places = [0, len(out)] if not len(inside) else [0, int(inside[0]), int(inside[-1]) + 1, int(inside[-1]) + 1, len(out)]
        at = places[rng.integers(len(places))]
        new = [Block(("html", "body", *above, leaf), others[rng.integers(len(others))], 0) for _ in range(int(rng.integers(1, most + 1)))]
        new = [Block(b.path, b.text, len(b.text) if leaf == "li" and "comment" not in above[-1] else 0) for b in new]
        out[at:at], marks[at:at] = new, [0.0] * len(new)
    return out, np.array(marks, np.float32)


class Labeller:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size, h = PATH_SIZE + WORD_SIZE + MEASURES, HIDDEN
        shapes = {"path": (PATH_ROWS, PATH_SIZE), "word": (WORD_ROWS, WORD_SIZE), "out": (1, 2 * h), "out_b": (1, 1)}
        for way in ("f", "b"):
            shapes |= {f"in_{way}": (4 * h, size), f"bias_{way}": (4 * h, 1), f"again_{way}": (4 * h, h)}
        scale = {"path": 0.1, "word": 0.02}
        self.weights = {k: (rng.normal(0, scale.get(k, 1 / np.sqrt(s[1])), s) * (not k.startswith(("bias", "out_b")))).astype(np.float32) for k, s in shapes.items()}
        self._paths: dict[tuple[str, ...], np.ndarray] = {}

    def path_rows(self, path: tuple[str, ...]) -> np.ndarray:
        rows = self._paths.get(path)
        if rows is None:
            if len(self._paths) > 100_000:
                self._paths.clear()
            tokens = {word for entry in path for word in entry.split()} | {f"<{entry}" for entry in path[-2:]} | {f"^{path[-1]}" if path else "^"}
            rows = self._paths[path] = np.array(sorted(zlib.crc32(t.encode()) % PATH_ROWS for t in tokens), np.int64)
        return rows

    def features(self, page_blocks: list[Block]) -> dict:
        """Rows of the tables and measures of blocks; blocks of several pages may follow each other."""
        different = {path: i for i, path in enumerate(dict.fromkeys(b.path for b in page_blocks))}
        rows = [self.path_rows(path) for path in different]
        words = Words(pa.array([b.text for b in page_blocks], pa.large_string()), lower=True)
        counts = words.counts
        sizes = np.array([len(b.text) for b in page_blocks], np.float32)
        linked = np.array([b.linked for b in page_blocks], np.float32)
        stops = np.array([b.text.count(".") + b.text.count(",") for b in page_blocks], np.float32)
        measures = np.stack([np.log1p(sizes) / 5, np.minimum(1, linked / np.maximum(1, sizes)), np.log1p(counts).astype(np.float32) / 4, np.minimum(1, stops / np.maximum(1, counts))], 1)
        return {"path": np.array([different[b.path] for b in page_blocks], np.int64), "path_row": np.concatenate(rows) if rows else np.zeros(0, np.int64),
                "path_begin": np.cumsum([0, *map(len, rows)])[:-1], "word_row": (words.hashes() % np.uint64(WORD_ROWS)).astype(np.int64),
                "word_begin": words.first[:-1], "counts": counts, "measures": measures.astype(np.float32)}

    def vectors(self, f: dict) -> np.ndarray:
        """(blocks + 1, features); the last is no block. Every block has words, as empty ones are left out."""
        w = self.weights
        paths = np.add.reduceat(w["path"][f["path_row"]], f["path_begin"], axis=0)[f["path"]]
        words = np.add.reduceat(w["word"][f["word_row"]], f["word_begin"], axis=0) / f["counts"][:, None].astype(np.float32)
        both = np.concatenate([paths, words, f["measures"]], 1)
        return np.concatenate([both, np.zeros((1, both.shape[1]), np.float32)])

    def run(self, vectors: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits (blocks, pages) for index (blocks, pages) into `vectors`; places past a page's end hold the last."""
        w, h = self.weights, HIDDEN
        span, n = index.shape
        real = (index < len(vectors) - 1).astype(np.float32)
        states = np.empty((span, 2 * h, n), np.float32)
        for way, part, times in (("f", slice(0, h), range(span)), ("b", slice(h, 2 * h), range(span - 1, -1, -1))):
            projected = w[f"in_{way}"] @ vectors.T + w[f"bias_{way}"]
            again = w[f"again_{way}"]
            now, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in times:
                x = projected.take(index[t], axis=1) + again @ now
                gates = np.tanh(x[:3 * h] * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                i, f, o = gates[:h], gates[h:2 * h], gates[2 * h:]
                g = np.tanh(x[3 * h:])
                new_cell = (f * cell + i * g) * real[t]
                squashed = np.tanh(new_cell)
                new = o * squashed * real[t]
                if keep is not None:
                    keep.append((way, t, now, cell, i, f, o, g, squashed))
                states[t, part] = now = new
                cell = new_cell
        if keep is not None:
            keep.append((states, real))
        return np.matmul(w["out"], states)[:, 0] + w["out_b"][0, 0]

    def gradient(self, f: dict, index: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, h = self.weights, HIDDEN
        vectors, kept = self.vectors(f), []
        logits = self.run(vectors, index, kept)
        states, real = kept.pop()
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        d = ((p - labels) * real / real.sum()).astype(np.float32)
        loss = float(-(np.log(np.where(labels > 0, p, 1 - p) + 1e-9) * real).sum() / real.sum())
        grad["out"], grad["out_b"] = np.einsum("tn,thn->h", d, states)[None], d.sum().reshape(1, 1)
        d_states = w["out"].T[None] * d[:, None]
        d_vectors = np.zeros_like(vectors)
        carry = {way: [np.zeros((h, index.shape[1]), np.float32)] * 2 for way in "fb"}
        d_projected = {way: np.zeros((len(vectors), 4 * h), np.float32) for way in "fb"}
        for way, t, now, cell, i, f_, o, g, squashed in reversed(kept):
            d_now, d_cell = carry[way]
            d_now = (d_now + d_states[t, slice(0, h) if way == "f" else slice(h, 2 * h)]) * real[t]
            d_cell = (d_cell + d_now * o * (1 - squashed ** 2)) * real[t]
            d_x = np.concatenate([d_cell * g * i * (1 - i), d_cell * cell * f_ * (1 - f_), d_now * squashed * o * (1 - o), d_cell * i * (1 - g ** 2)])
            carry[way] = [w[f"again_{way}"].T @ d_x, d_cell * f_]
            grad[f"again_{way}"] += d_x @ now.T
            np.add.at(d_projected[way], index[t], d_x.T)
        for way in "fb":
            grad[f"in_{way}"], grad[f"bias_{way}"] = d_projected[way].T @ vectors, d_projected[way].sum(0)[:, None]
            d_vectors += d_projected[way] @ w[f"in_{way}"]
        d_vectors = d_vectors[:-1]
        d_paths = np.zeros((len(f["path_begin"]), PATH_SIZE), np.float32)
        np.add.at(d_paths, f["path"], d_vectors[:, :PATH_SIZE])
        np.add.at(grad["path"], f["path_row"], np.repeat(d_paths, np.diff(np.append(f["path_begin"], len(f["path_row"]))), axis=0))
        np.add.at(grad["word"], f["word_row"], np.repeat(d_vectors[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] / f["counts"][:, None], f["counts"], axis=0).astype(np.float32))
        return loss, grad

    def texts(self, pages: list[str | None]) -> list[str]:
        cut = [blocks(page) for page in pages]
        flat = [block for page in cut for block in page]
        verdict = np.zeros(len(flat), bool)
        if flat:
            vectors = self.vectors(self.features(flat))
            sizes = np.array([len(page) for page in cut])
            begins = np.cumsum(sizes) - sizes
            order = np.argsort(sizes, kind="stable")
            order = order[sizes[order] > 0]
            for some in np.array_split(order, max(1, -(-len(order) // 96))):
                index = padded(begins[some], sizes[some], len(flat))
                logits = self.run(vectors, index)
                real = index < len(flat)
                verdict[index[real]] = logits[real] > 0
        out, at = [], 0
        for page in cut:
            out.append("\n".join(block.text for block, yes in zip(page, verdict[at:at + len(page)]) if yes))
            at += len(page)
        return out


def padded(begins: np.ndarray, sizes: np.ndarray, nothing: int) -> np.ndarray:
    at = np.arange(int(sizes.max()))[:, None]
    return np.where(at < sizes, begins + at, nothing)


def example(page: str) -> tuple[list[Block], np.ndarray] | None:
    """What the training sees of a page: blocks and labels, made of the whole page, of its beginning and end."""
    found = blocks(page)
    if not found:
        return None
    marks = weak_labels(found)
    if len(found) > 2 * SAMPLE_BLOCKS:
        found, marks = found[:SAMPLE_BLOCKS] + found[-SAMPLE_BLOCKS:], np.concatenate([marks[:SAMPLE_BLOCKS], marks[-SAMPLE_BLOCKS:]])
    return [Block(b.path, b.text[:SAMPLE_TEXT], min(b.linked, SAMPLE_TEXT)) for b in found], marks


def train(known: list[tuple[list[Block], np.ndarray]], epochs: int = 6, least_steps: int = 60, batch: int = 24, seed: int = 11) -> Labeller | None:
    """Fit on examples as they are and varied, more often where they are few."""
    labeller, rng, moments, step = Labeller(seed), np.random.default_rng(seed), {}, 0
    if not known:
        return None
    epochs = max(epochs, -(-least_steps // -(-len(known) // batch)))
    others = [block.text for page, _ in known for block in page[:12]]
    for epoch in range(epochs):
        shown = [pair if rng.random() < 0.3 else varied(*pair, others, rng) for pair in known]
        shown.sort(key=lambda pair: len(pair[0]))
        groups = [shown[i:i + batch] for i in range(0, len(shown), batch)]
        for group in (groups[i] for i in rng.permutation(len(groups))):
            f = labeller.features([block for page, _ in group for block in page])
            sizes = np.array([len(page) for page, _ in group])
            index = padded(np.cumsum(sizes) - sizes, sizes, int(sizes.sum()))
            labels = np.append(np.concatenate([marks for _, marks in group]), 0)[index]
            step += 1
            _, gradient = labeller.gradient(f, index, labels)
            for k, g in gradient.items():
                m, v = moments.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                rate = 0.01 * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
                labeller.weights[k] -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-7))
    labeller._paths.clear()
    return labeller


def fit(pages: DataFrame) -> Labeller | None:
    """Train on `SAMPLE_PAGES` pages, the first by a hash of their row of those with text outside tags; None if there are none. Executors make the examples, one task
    trains on them and returns the labeller."""
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?:^|>)\s*[^<\s]"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            made = [example(page) for page in as_strings(part.column("html")).to_pylist()]
            some = [i for i, pair in enumerate(made) if pair]
            shown = [pickle.dumps(([(b.path, b.text, b.linked) for b in made[i][0]], made[i][1].tobytes())) for i in some]
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(some, pa.int64())), pa.array(shown, pa.binary())], names=["key", "example"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*(sum((b.column(i).to_pylist() for b in held), []) for i in range(2)))) if (held := list(batches)) else []
        read = [pickle.loads(shown) for _, shown in rows]
        labeller = train([([Block(*b) for b in page], np.frombuffer(marks, np.float32)) for page, marks in read])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(labeller)], pa.binary())], names=["labeller"])

    picked = keyed.select("key").distinct().orderBy("key").limit(SAMPLE_PAGES)
    rows = keyed.join(F.broadcast(picked), "key").dropDuplicates(["key"])
    found = rows.mapInArrow(examples, "key long, example binary").coalesce(1).mapInArrow(run, "labeller binary").collect()
    return pickle.loads(found[0]["labeller"]) if found else None


def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """page_id, url, text and n_chars of every row. The labeller (under 1 MB) is broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "html"):
            html = as_strings(part.column("html")).to_pylist()
            texts = model.texts(html) if model else [""] * len(html)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
