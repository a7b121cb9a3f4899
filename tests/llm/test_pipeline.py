"""The pipeline's stages on a small table: what each does to what the stage before it kept."""
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import packing
from tidemark.llm.queries import english_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def corpus(spark, folder):
    rng = np.random.default_rng(1)

    def words(n, stem="w"):
        return " ".join(f"{stem}{x}" for x in rng.integers(0, 500, n))

    texts, toxic = [], []
    for i in range(150):
        own = words(int(rng.integers(40, 90))).split()
        if i % 3 == 0:
            own[int(rng.integers(len(own)))] = own[0] = "vileness"
        texts.append(" ".join(own))
        toxic.append(int(i % 3 == 0))
    passage, line = words(60), [words(8) for _ in range(3)]
    base = words(80).split()
    near = list(base)
    near[10] = "other"
    texts += [" ".join(base), " ".join(near), words(20) + " " + passage + " " + words(20), words(20) + " " + passage + " " + words(20),
              "\n".join([words(9), *line, words(9)]), "\n".join([words(7), *line, words(7)]), "", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, toxic


def test_stages(spark, corpus):
    folder, texts, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name.replace(' ', '')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '')}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    gone = set(range(150)) - set(seen["toxicity"])
    assert len(gone & {i for i, y in enumerate(toxic) if y}) >= 40 and len(gone - {i for i, y in enumerate(toxic) if y}) <= 5
    assert seen["line dedup"][154]["text"] == texts[154] and seen["line dedup"][155]["text"].count("\n") == 1
    assert 151 not in seen["near-duplicates"] and 150 in seen["near-duplicates"]
    last = seen["substring dedup"]
    assert len(last[153]["text"].split()) == 40 and last[152]["text"] == texts[152]
    assert all(r["n_chars"] == len(r["text"]) for r in last.values() if r["text"] is not None)
    assert {156, 157} <= set(last)
    memory = english_pieces()
    tokens = {doc: memory.ids(r["text"]) + (2).to_bytes(4, "little") for doc, r in last.items()}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in rows} == set(last)
    assert all(r["ids_crc32"] == zlib.crc32(tokens[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]) for r in rows)
    assert len(rows) == sum(len(packing.pieces_of(len(t) // 4)) for t in tokens.values())


def test_lines_that_are_repeated_alone_go(spark):
    texts = ["one\nlicence line\ntwo", "three\nlicence line\nfour", "only line", "only line", "five\n\nsix"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    want = {0: texts[0], 1: "three\nfour", 2: texts[2], 4: texts[4]}
    assert got == {i: (t, len(t)) for i, t in want.items()}
