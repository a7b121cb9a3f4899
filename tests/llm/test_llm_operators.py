"""Operators for training corpora against brute force, on small fixtures with nulls, ties, repeats and clashing names."""
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import bpe, components, html_text, line_dedup, near_dedup, neighbours, packing, perplexity, substring_dedup, token_counts, toxicity
from tidemark.llm.pretokens import library_pieces
from tidemark.llm.queries import english_pieces
from tidemark.llm.words import Words, inside, ngrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "é b\tc\n", " x", "y ", "a b c a b c", "\n\nx\r\ny\n", "日本 🙂 a b\x85c", "a\x1cb"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, langs=None):
    rows = [(i if ids is None else ids[i], t, "en" if langs is None else langs[i], "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def babble(rng, n, vocabulary=400):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def test_words_are_those_of_the_pattern():
    words = Words(pa.array(ODD))
    got = [[bytes(words.data[words.starts[j]:words.ends[j]]).decode() for j in range(a, b)] for a, b in zip(words.first, words.first[1:])]
    assert got == [WORD.findall(t or "") for t in ODD]
    flat = list(itertools.chain(*got))
    assert len(set(zip(flat, words.hashes().tolist()))) == len(set(flat))
    assert len(ngrams(words.hashes(), 3)[inside(words.first, 3)]) == sum(max(0, len(g) - 2) for g in got)


def test_substring_dedup(spark):
    rng = np.random.default_rng(1)
    passage, long = babble(rng, 55), babble(rng, 400)
    texts = [babble(rng, 30) + " " + passage + " " + babble(rng, 40), long, passage, babble(rng, 5) + "\n" + passage, long, long[:600] + " " + babble(rng, 60), "x " * 120, "x " * 120, *ODD]
    texts += [babble(rng, int(n)) for n in rng.integers(0, 120, 20)]
    docs = frame(spark, texts, ids=[*range(len(texts) - 1), None])
    first, want = {}, {}
    for doc, text in sorted((r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - 49):
            if first.setdefault(tuple(words[s:s + 50]), doc) < doc:
                gone[s:s + 50] = [True] * 50
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.remove_digests(docs).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(texts)
    clash = docs.withColumn("row", F.lit(1)).withColumn("n_words", F.lit("a")).withColumn("h", F.lit(2))
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove(clash).collect()}
    assert left[2 if 2 in left else 0] and 4 not in left and left[1] == long
    assert substring_dedup.remove_digests(docs.limit(0)).count() == 0


def test_substring_dedup_spreads_frequent_passages(spark, monkeypatch):
    rng = np.random.default_rng(2)
    passage = babble(rng, 60)
    texts = [babble(rng, 20, 10 ** 8) + " " + passage + " " + babble(rng, 20, 10 ** 8) for _ in range(12)]
    want = sorted(tuple(r) for r in substring_dedup.remove_digests(frame(spark, texts)).collect())
    monkeypatch.setattr(substring_dedup, "OFTEN", 3)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    assert sorted(tuple(r) for r in substring_dedup.remove_digests(frame(spark, texts)).collect()) == want
    assert sum(r[2] for r in want) == 11 * 60


def test_backward_search():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 5, 300)
    text[-1] = 0
    index = substring_dedup.FMIndex(text, 6)
    for turn in range(20):
        pattern = rng.integers(1, 7, 40) if turn % 2 else text[turn * 10:turn * 10 + 40]
        want = {s: k for s in range(len(pattern) - 5) if not (pattern[s:s + 6] == 0).any()
                and (k := sum((text[i:i + 6] == pattern[s:s + 6]).all() for i in range(len(text) - 5)))}
        assert {s: high - low for s, low, high in index.matches(pattern)} == want


def brute_classes(rows, size, percent):
    sets = {}
    for doc, text in rows:
        words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[doc] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    label = {doc: doc for doc in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {doc: (len(s), label[doc], label[doc] == doc) for doc, s in sets.items()}


def test_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = list(ODD) + ["A b", "a B", "a b", "", None]
    for _ in range(4):
        base = babble(rng, int(rng.integers(20, 150))).split()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(copy))
    docs = frame(spark, texts)
    want = brute_classes(list(enumerate(texts)), 3, 85)
    assert {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 3, 85).collect()} == want
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 3, 85).collect()} == want
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rng = np.random.default_rng(21)
    one, two, three = (babble(rng, 60).split() for _ in range(3))
    near = lambda words: " ".join([*words[:30], "new", *words[31:]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, near(one)), (3, near(two)), (9, " ".join(three)), (None, " ".join(three)), (None, "alone in its class"), (5, " ".join(one))]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]), 3, 70).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (5, 3, False), (7, 3, False), (3, 3, True), (9, 9, True), (None, 9, False), (None, None, True)], key=str)


def test_a_family_mostly_unlike_its_pivot(spark, monkeypatch):
    rng = np.random.default_rng(22)
    base = babble(rng, 80, 10 ** 6).split()
    texts = []
    for i in range(150):  # each near the base and a chain to the next, few near each other
        copy = list(base)
        for at in range(i % 12, len(copy), 12):
            copy[at] = f"x{i % 12}"
        copy[i % 80] = f"y{i}"
        texts.append(" ".join(copy))
    texts += [babble(rng, 60, 10 ** 6) for _ in range(20)]
    want = brute_classes(list(enumerate(texts)), 2, 75)
    docs = frame(spark, texts)
    assert {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 2, 75).collect()} == want
    for name, value in (("BLOCK", 7), ("UNIT_ROWS", 20), ("UNIT_BYTES", 3000)):
        monkeypatch.setattr(near_dedup, name, value)
    assert {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 2, 75).collect()} == want


def test_near_duplicates_at_the_threshold_of_the_pipeline(spark):
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(8000):  # 40 words of 50 are common
        words = [f"w{x}" for x in rng.choice(10 ** 6, 50, replace=False)]
        texts += [" ".join(words[:45]), " ".join(words[:40] + words[45:])]
    signed = pa.Table.from_batches(near_dedup._sign(1)([pa.record_batch({"doc_id": pa.array(range(16000)), "text": pa.array(texts)})]))
    values = np.frombuffer(b"".join(signed.column("signature").to_pylist()), np.uint32).reshape(8000, 2, near_dedup.COORDINATES)
    collisions = (values[:, 0] == values[:, 1]).sum(1)
    few = np.flatnonzero((collisions >= 27) & (collisions < 30))[:5]
    rows = [(int(i), texts[i]) for at in few for i in (2 * at, 2 * at + 1)]
    assert len(few)
    got = {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]), 1, 80).collect()}
    assert got == brute_classes(rows, 1, 80) and sum(kept for *_, kept in got.values()) == len(few)
    assert [near_dedup.matches(percent) for percent in (80, 85, 100)] == [27, 30, 48]
    with pytest.raises(ValueError):
        near_dedup.matches(5)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 70), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50}


def test_components_of_stars_take_few_tasks(spark):
    context, group = spark.sparkContext, "components of stars"
    edges = spark.createDataFrame([(i, i % 7) for i in range(7, 700)], "a long, b long").repartition(8).checkpoint()
    context.setJobGroup(group, group)
    try:
        got = components.components(edges)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    assert sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info) <= 20
    assert {r["id"]: r["component"] for r in got.collect()} == {i: i % 7 for i in range(700)}


def test_toxicity_learns_and_defines_odd_texts(spark):
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(240):
        words = babble(rng, int(rng.integers(20, 150))).split()
        if i % 3 == 0:
            for at in rng.integers(0, len(words), 3):
                words[at] = "vile" + "abcdefgh"[rng.integers(8)]
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    docs = frame(spark, texts + ODD)
    network = toxicity.fit(docs, spark.createDataFrame([(i, y, y) for i, y in enumerate(labels)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, lang int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, network).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values() if r["doc_id"] < 240) == len(held)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values()) and len(got) == len(texts) + len(ODD)
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {(r["score"], r["trained"]) for r in toxicity.score(docs, None).collect()} == {(0.0, False)}
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    strangers = spark.range(1000, 40_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    alike = toxicity.fit(docs, known.union(strangers))  # labels of documents that aren't there change nothing
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, alike).collect()} == {i: r["score"] for i, r in got.items()}


def test_toxicity_gradient():
    network = toxicity.Network.fresh()
    words, vocabulary, which = toxicity.read_words(pa.array(["the cat sat on a mat " * 6, "dogs bark loud", ""]))
    _, start, length = toxicity.windows(words.first)
    index = toxicity.window_index(which, start, length, len(vocabulary.word_row))
    labels = np.array([1, 0, 1], np.float32)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    gradient = network.gradient(index, length, vocabulary, labels, np.ones(3), np.ones(len(vocabulary.word_row)))

    def loss():
        x = network.run(network.project(network.vectors(vocabulary)), index, length).astype(np.float64)
        return (np.log1p(np.exp(x)) - labels * x).sum()

    for name, w in network.weights.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), w.shape)
        old, values = w[at], []
        for step in (0.001, -0.001):
            w[at] = old + step
            values.append(loss())
        w[at] = old
        assert (values[0] - values[1]) / 0.002 == pytest.approx(float(gradient[name][at]), abs=5e-3)


def brute_counts(text):
    text = text or ""
    words, seen, duplicates = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    often = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if often[tuple(words[i:i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def test_quality_counts():
    texts = ODD + ["x x x x x", "a\n\na\na", "é#<\n é#<\n é#<", "a b c\r\na b c\r\n"]
    got = perplexity.counts_of(pa.array(texts))
    assert [tuple(int(v[i]) for v in got.values()) for i in range(len(texts))] == [brute_counts(t) for t in texts]


def test_kneser_ney_probabilities_sum_to_one_and_bands_work(spark):
    rng = np.random.default_rng(5)
    syllables = ["ba", "ko", "lin", "ter", "us", "mo"]
    texts = [" ".join("".join(rng.choice(syllables, 2)) for _ in range(80)) for _ in range(60)] + ["#$%& " * 80, "zqxj kvbw " * 40, *ODD]
    docs = frame(spark, texts, langs=["en"] * 62 + [None] * len(ODD))
    arrays = perplexity.Arrays(perplexity.model(docs.where("lang = 'en'")))
    language = perplexity.language_key("en")
    for context in (b"ba k", b"zz z", b"\0\0\0\0"):
        grams = np.array([language << 40 | int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp(arrays.log_probabilities(grams).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    got = {r["doc_id"]: r for r in perplexity.quality(docs).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not got[60]["kept"] and len(got) == len(texts)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got.values())
    assert perplexity.quality(docs.limit(0)).count() == 0


def test_a_small_language_is_scored_alike_beside_a_large_one(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rare = [babble(rng, 60) for _ in range(20)] + ["", None]
    hot = ["".join(map(chr, rng.integers(33, 127, 20_000))) for _ in range(15)]  # 300,000 different n-grams
    want = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(frame(spark, rare, langs=["rare"] * 22)).collect()}
    docs = frame(spark, rare + hot, langs=["rare"] * 22 + ["hot"] * 15)
    for name, value in (("UNIT_BYTES", 50_000), ("RANGE_ROWS", 5_000)):
        monkeypatch.setattr(perplexity, name, value, raising=False)
    tables = perplexity.model(docs)
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(docs).collect()}
    assert len(got) == 37 and got[20] is None and got[21] is None
    assert [got[i] for i in range(20)] == pytest.approx([want[i] for i in range(20)], rel=1e-5)
    arrays = perplexity.Arrays(tables)
    assert len(arrays.orders[-1][0]) == tables[-1].count() > 290_000
    language = perplexity.language_key("hot")
    for context in (hot[0][:4].encode(), b"\0\0\0\0"):
        grams = np.array([language << 40 | int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp(arrays.log_probabilities(grams).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[10:14] = vectors[0]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)] + [(300, None, 1), (400, [0.0] * 16, 1), (500, [float("nan")] * 16, 1), (600, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (700, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    usable = neighbours.usable(table)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(usable, usable.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200}
    hits = 0
    for query, found in got.items():
        exact = np.sqrt(((vectors.astype(float) - vectors[query].astype(float)) ** 2).sum(1))
        exact[query] = np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(300), exact))[:10].tolist()))
        assert [s for _, s in found] == pytest.approx(exact[[v for v, _ in found]].tolist())
    assert hits >= 27 and [v for v, _ in got[0]][:4] == [10, 11, 12, 13]
    few = usable.where("vec_id < 4")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 3 and neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_token_counts(spark, folder, block):
    texts = [*ODD, "word " * 500, "the end"]
    docs = frame(spark, texts).repartition(2)
    places = token_counts.write_token_files(docs, folder + "/tokens", english_pieces, 50256)
    got = places.join(token_counts.count_tokens(spark, folder + "/tokens", 50256, block=block), ["file", "place"])
    memory = english_pieces()
    assert {r["doc_id"]: (r["n_tokens"], r["ended"]) for r in got.collect()} == {i: (len(memory.ids(t)) // 4, True) for i, t in enumerate(texts)}


def test_token_files_without_a_last_separator(spark, folder):
    import os
    os.makedirs(folder + "/flat")
    np.array([5, 0, 0, 7, 8, 9], "<u2").tofile(folder + "/flat/x.tok")
    got = {r["place"]: (r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(spark, folder + "/flat", 0, block=2).collect()}
    assert got == {0: (1, True), 1: (0, True), 2: (3, False)}


def brute_lines(rows, least):
    places, texts = {}, {}
    for doc, text in sorted(rows):
        solid = [(n, line.strip(" \t\n\x0b\f\r")) for n, line in enumerate(text.split("\n")) if line.strip(" \t\n\x0b\f\r")]
        gone = set()
        for i in range(len(solid) - least + 1):
            if places.setdefault(tuple(line for _, line in solid[i:i + least]), (doc, i)) != (doc, i):
                gone |= {n for n, _ in solid[i:i + least]}
        texts[doc] = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
    return texts


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(spark, least):
    rng = np.random.default_rng(7)
    texts = ["\n".join(rng.choice(["a", "b", " c", "d ", "", "e"], rng.integers(1, 25))) for _ in range(25)] + ["", "one\ntwo\nthree\nfour", "one\ntwo\nthree\nfour\nfive"]
    docs = frame(spark, [*texts, None]).withColumn("line", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("depth", F.lit(3))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, least).collect()}
    assert got.pop(len(texts)) is None
    assert got == brute_lines(list(enumerate(texts)), least)
    assert line_dedup.dedup(docs.limit(0), least).count() == 0


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = np.random.default_rng(8)
    texts = ODD + [babble(rng, int(n)) for n in rng.integers(0, 900, 150)] + ["q " * 3000]
    memory = english_pieces()
    rows = packing.pack(frame(spark, texts).repartition(3), english_pieces, 2).collect()
    tokens = {i: memory.ids(t) + (2).to_bytes(4, "little") for i, t in enumerate(texts)}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(tokens[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])])
    for doc, ids in tokens.items():
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 1024 for r in own[1:])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == len(ids) // 4
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.1 * math.ceil(sum(r["length"] for r in rows) / 1024)


def test_sum_of_squares_choice():
    bins, offsets, gaps = packing.sum_of_squares(np.array([6, 6, 4, 4, 2]), 10)
    assert bins.tolist() == [0, 1, 1, 0, 2] or sorted(gaps.tolist()) == [0, 0, 8]
    assert packing.pieces_of(1, 4) == [(0, 1)] and packing.pieces_of(4, 4) == [(0, 4)] and packing.pieces_of(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_piece_memory_equals_the_tokenizer_file():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    memory = library_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(9)
    parts = ["a", " ", "  ", "\n", "'s", "don't", "12", "é", "ß", "日本", " ", "\x85", "\x1c", "🙂", "!?", "<|endoftext|>", "Straße"]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert np.frombuffer(memory.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_names_are_ids_as_in_the_tokenizer_file(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is loaded
    memory = english_pieces()
    assert np.frombuffer(memory.ids("<|endoftext|> a"), "<u4").tolist() == [50256, 257]
    rng = np.random.default_rng(12)
    parts = ["a", " ", "  ", "\n", "don't", "é", "日本", "<|endoftext|>", "<|endoftext|", "|>", "<", "🙂", "!?"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(400)] + ["<|endoftext|>", "<|endoftext|>" * 3, " <|endoftext|> "]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(memory.ids(text), "<u4").tolist() for text in texts] == want
    rows = packing.pack(frame(spark, texts), english_pieces, 2).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] - 1 for r in rows} == {i: len(ids) for i, ids in enumerate(want)}


def test_bpe(spark):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.pairs.ranks, special_tokens={})
    rng = np.random.default_rng(10)
    parts = ["a", "ab", "the", " ", "  ", "\n", "'s", "12", "é", "ß", "日本", " ", "\x85", "\x1c", "🙂", "!", "aaaa", "ing"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 50))) for _ in range(300)] + ODD + ["abcdefgh" * 5000, "a" * 3000]
    want = [library.encode_ordinary(t or "") for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want
    got = {r["doc_id"]: r for r in bpe.encode_digests(frame(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, (text, ids) in enumerate(zip(texts, want)):
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.encode_documents(frame(spark, texts[:2]), path, public_tokenizers.PATTERN).first()["decoded"] == (texts[0] or "").encode()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">One</a></li>
<li><a href="/y">Two</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Title %d</h1><p><b>Words &amp; more words,\n  and yet more of %d.<br><p>Second paragraph goes on for a while, %d.</article>
<footer>&copy; someone</footer></body></html>"""


def test_html(spark):
    pages = [PAGE % (i, i, i) for i in range(60)]
    rows = [(i, "u", p) for i, p in enumerate(pages)] + [(100, None, None), (101, "u", ""), (102, "u", "plain"), (103, "u", "<<<p>>&bogus; <"), (0, "u", pages[0])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    labeller = html_text.fit(table)
    got = collections.defaultdict(list)
    for r in html_text.extract(table, labeller).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    for i in range(60):
        text = f"Title {i}\nWords & more words, and yet more of {i}.\nSecond paragraph goes on for a while, {i}."
        assert set(got[i]) == {(text, len(text))}
    assert got[100] == [("", 0)] and got[101] == [("", 0)] and len(got[0]) == 2 and len(got) == 64
    other = "<body><div class='menu'><li><a>Home</a></li></div><main><h1>A title</h1><p>One long paragraph of text, with words in it.</p></main><section class=comments><p>I liked it.</p></section></body>"
    assert labeller.texts([other]) == ["A title\nOne long paragraph of text, with words in it."]
    assert html_text.fit(table.limit(0)) is None


def test_html_without_landmarks(spark):
    chinese = "这是一个没有空格的中文段落，它也属于正文，不应当丢失。"

    def page(i: int, padding: int = 0) -> str:
        long = "".join(f"<p>Paragraph {k} of page {i} tells at some length what had to be told about matter {k * i}.</p>" for k in range(6 + padding))
        return (f"<html><body><div class='menu'><ul><li><a href='/'>Home page</a></li><li><a href='/n'>News of today</a></li></ul></div>"
                f"<div class='story'><h1 class='title'>The title of {i}</h1><h2 class='sub' id=s{i}>A heading</h2>{long}<p>{chinese}</p><p>Short.</p></div>"
                f"<div class='footer'>All rights reserved {i}</div></body></html>")

    def wanted(i: int, padding: int = 0) -> str:
        long = [f"Paragraph {k} of page {i} tells at some length what had to be told about matter {k * i}." for k in range(6 + padding)]
        return "\n".join([f"The title of {i}", "A heading", *long, chinese, "Short."])

    found = html_text.blocks(page(1))
    assert "\n".join(b.text for b, mark in zip(found, html_text.weak_labels(found)) if mark) == wanted(1)
    for pages, padding in ((60, 0), (20, 900)):  # the second table holds pages of over 64 KB only
        table = spark.createDataFrame([(i, "u", page(i, padding)) for i in range(pages)], "page_id long, url string, html string")
        assert padding == 0 or table.selectExpr("min(octet_length(html))").first()[0] > 1 << 16
        got = {r["page_id"]: r["text"] for r in html_text.extract(table, html_text.fit(table)).collect()}
        assert got == {i: wanted(i, padding) for i in range(pages)}
    bare = html_text.blocks("<p>Words right in the page, quite many of them.</p><ul><li><a>Link</a></li></ul>")
    assert len(html_text.weak_labels(bare)) == len(bare) and not len(html_text.weak_labels([]))
