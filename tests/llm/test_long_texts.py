"""Texts longer than a slice beside short ones, in tables with columns of the operators' own names: whole texts count, in any company."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import common, decontaminate, editcount, quality, simhash, tokenbin, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = "a benchmark passage of ten words stands here quite alone"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeéfgh", k=draw.randint(1, 9))) for _ in range(5000)]
    long = " ".join(draw.choices(words, k=260000)) + f" {PASSAGE} you dimwit"
    assert len(long.encode()) > common.SLICE + (1 << 18)
    return {1: "short and plain", 2: long, 3: None, 4: "", 5: long[:-1], 6: f"{PASSAGE}, a dimwit"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    return frame.withColumns({c: F.lit(1) for c in ("_text", "_row", "_number", "_print", "score", "label", "fingerprint", "item_id", "size", "n_tokens")})


def test_fingerprints(docs, texts):
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs).collect()}
    assert {i: v & (1 << 64) - 1 for i, v in got.items()} == {i: simhash.fingerprint(t or "") for i, t in texts.items()}


def test_one_of_each(docs):
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and {1, 2, 3, 6} == {r.doc_id for r in got.select("doc_id").collect()}


def test_passages_at_the_end(spark, docs, texts):
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").withColumn("_text", F.lit(1))
    got = {r.doc_id: (r.coverage, r.tiles[0].doc_begin) for r in decontaminate.matches(docs, items).collect()}
    assert got == {i: (1.0, len(texts[i].split()) - 12) if i != 6 else (1.0, 0) for i in (2, 5, 6)}
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()} == {1, 3, 4}


def test_token_counts_and_files(spark, docs, texts):
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in editcount.counted(docs.drop("n_tokens"), tokenizer=PATH).select("doc_id", "n_tokens").collect()} == {i: len(x) for i, x in ids.items()}
    path = tokenbin.new_path(spark)
    tokenbin.write(docs, path, tokenizer=PATH, end_id=2)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tokenbin.read(spark, path).collect()}
    assert got == {i: [*x, 2] for i, x in ids.items()}


def test_toxic_hits_and_quality_in_any_company(docs, texts):
    model = toxicity.Model(toxicity.Lexicon(["dimwit"], [False], [0], np.array([3.0])), np.ones(6), -1.0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i: [h.begin for h in r.hits] for i, r in got.items()} == {i: [t.encode().find(b"dimwit")] if t and "dimwit" in t else [] for i, t in texts.items()}
    assert got[3].score == got[4].score and got[2].score > got[1].score
    fitted = quality.train(lambda: iter([]))
    whole = {r.doc_id: (r.score, r.passages) for r in quality.score(docs, fitted).collect()}
    alone = {i: [(r.score, r.passages) for r in quality.score(docs.where(F.col("doc_id") == i), fitted).collect()][0] for i in (1, 2, 3)}
    assert all(alone[i][1] == whole[i][1] and alone[i][0] == pytest.approx(whole[i][0]) for i in alone) and whole[2][1] > 100
