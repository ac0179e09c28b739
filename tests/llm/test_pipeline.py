import os

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import common, simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_stages_as_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = stages["quality classifier"](spark, docs, FOLDER)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    one = stages["SimHash near-dedup"](spark, good, FOLDER).collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in good.collect()}
    left = set(prints)
    groups = []
    while left:
        group, new = set(), {min(left)}
        while new:
            group |= new
            new = {i for i in left - group if any(bin(prints[i] ^ prints[j]).count("1") <= 3 for j in new)}
        groups.append(group)
        left -= group
    assert sorted(r.doc_id for r in one) == sorted(map(min, groups))

    docs = spark.createDataFrame(one, good.schema)
    clean = stages["benchmark decontamination"](spark, docs, FOLDER)
    flat = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [flat(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one if not any(f" {i} " in f" {flat(r.text)} " for i in items)}

    mixed = stages["mixing sources to target weights"](spark, clean, FOLDER)
    assert mixed.columns == docs.columns
    total = sum(len(r.text.split()) for r in clean.collect())
    assert sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(1.5 * total, abs=30)

    out = stages["token-ID / binary output"](spark, mixed, FOLDER).orderBy("start").collect()
    assert [r.start for r in out] == np.append(0, np.cumsum([r.n_tokens for r in out])[:-1]).tolist()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())


def test_one_of_each_handles_repeated_and_null_ids(spark):
    rows = [(None, "a b c d", 1), (None, "A B C D", 2), (3, "x y z w", 3), (3, "x y z w", 4), (None, "x y z w", 5), (4, None, 6), (5, "", 7)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _number int")).collect()
    assert sorted((str(r.doc_id), str(r.text).lower()) for r in got) == [("3", "x y z w"), ("4", "none"), ("None", "a b c d")]


def test_run(spark):
    before = common.held()
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert common.held() == before + 1
    common.release(before)
    assert common.held() == before


def test_stages_take_rows_of_any_kind(spark):
    rows = [(None, None, None, None, None, 1), (None, "", "en", "a", 0, 2), (7, "plain words in a row of some length", "en", None, 35, 3), (7, "plain words in a row of some length", "en", None, 35, 3), (8, "long words " * 30_000, None, "a", 330_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int").withColumns({c: common.F.lit(1) for c in ("score", "size", "fingerprint", "label", "_number", "taken", "mix_key")})
    for name, stage in corpus_pipeline.STAGES:
        full, empty = stage(spark, docs, FOLDER), stage(spark, docs.where("false"), FOLDER)
        assert empty.count() == 0 and full.count() <= 2 * len(rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert full.columns == docs.columns == empty.columns, name
