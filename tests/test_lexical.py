"""The BM25+ index: blocks that can't reach the kth score aren't read, files that are the same aren't read again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import lexical


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(200)], k=draw.choice([3, 10, 40, 150, 400])))) for i in range(3000)] + [(4000, None), (4001, "")]
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(path)
    return path


def read_bytes(spark, run):
    """Bytes of input that the stages of a run have read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda x: sum(x.apply(i).inputBytes() for i in range(x.size()))
    before = total(listed())
    run()
    return total(listed()) - before


@pytest.mark.parametrize("query, k", [("w0 w1", 10), ("w150", 5), ("w199 w3 w77 unknown", 20), ("w0", 3000)])
def test_pruned_as_whole(spark, corpus, tmp_path_factory, monkeypatch, query, k):
    monkeypatch.setattr(lexical, "BLOCK", 25)
    monkeypatch.setattr(lexical, "FIRST", 4)
    monkeypatch.setattr(lexical, "BUCKET", 16)
    folder = str(tmp_path_factory.getbasetemp() / "indexes")
    index = lexical.index_of_files(spark, corpus, folder, id="doc_id")
    assert index.documents == 3002 and index.blocks > 100 and index.buckets > 5
    read = {}
    pruned = [tuple(r) for r in index.top_k(query, k).orderBy("rank").collect()]
    read["pruned"] = read_bytes(spark, lambda: index.top_k(query, k).collect())
    monkeypatch.setattr(lexical, "FIRST", 10**6)
    assert [tuple(r) for r in index.top_k(query, k).orderBy("rank").collect()] == pruned
    monkeypatch.setattr(lexical, "FIRST", 4)
    monkeypatch.setattr(lexical, "NAMED", 2)
    assert [tuple(r) for r in index.top_k(query, k).orderBy("rank").collect()] == pruned
    assert len(pruned) == min(k, len(pruned)) and read["pruned"] > 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_a_batch_as_one_by_one(spark, corpus, tmp_path_factory, monkeypatch, few):
    for name, value in (("BLOCK", 25), ("FIRST", 4), ("BUCKET", 16), ("FEW", few)):
        monkeypatch.setattr(lexical, name, value)
    index = lexical.index_of_files(spark, corpus, str(tmp_path_factory.getbasetemp() / "indexes"), id="doc_id")
    asked = [(1, "w0 w1"), (2, "w150 w150"), (3, "w199 w3 w77 unknown"), (4, "w0"), (5, None), (6, "?"), (7, "unknown"), (8, " ".join(f"w{i}" for i in range(0, 200, 3))), (4, "w0")]
    queries = spark.createDataFrame(asked, "query_id long, text string").selectExpr("*", "1 as block", "2 as tf", "3 as points")
    got = {}
    for r in index.batch_top_k(queries, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(got) == {1, 2, 3, 4, 8}
    for q, text in dict(asked).items():
        if q in got:
            want = [tuple(r) for r in index.top_k(text, 10).select("rank", "doc_id", "score").orderBy("rank").collect()]
            assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in want]
            assert [x[2] for x in sorted(got[q])] == pytest.approx([x[2] for x in want], abs=1e-7)
    assert index.batch_top_k(queries.where("false"), 10).count() == 0


def test_a_batch_reads_few_blocks(spark, corpus, tmp_path, monkeypatch):
    """Only blocks that can reach a query's kth score give it postings."""
    for name, value in (("BLOCK", 25), ("FIRST", 4), ("FEW", 0)):
        monkeypatch.setattr(lexical, name, value)
    index = lexical.index_of_files(spark, corpus, str(tmp_path), id="doc_id")
    tables = []
    monkeypatch.setattr(lexical, "written", lambda df, keep=lexical.written: tables.append(keep(df)) or tables[-1])
    queries = spark.createDataFrame([(1, "w0 w1"), (2, "w150")], "query_id long, text string")
    got = index.batch_top_k(queries, 5)
    reached = {q: min(r.score for r in got.where(F.col("query_id") == q).collect()) for q in (1, 2)}
    base = {r.query_id: r.s for r in tables[0].groupBy("query_id").agg(F.sum("idf").alias("s")).collect()}
    for q in (1, 2):
        bounds = [r.bound / 1e9 + base[q] for r in tables[1].where(F.col("query_id") == q).collect()]
        assert 4 <= sum(x >= reached[q] - 1e-6 for x in bounds) < len(bounds)


def test_blocks_are_skipped(spark, corpus, tmp_path, monkeypatch):
    """The blocks left are few, and the plan reads postings alone."""
    monkeypatch.setattr(lexical, "BLOCK", 25)
    monkeypatch.setattr(lexical, "FIRST", 4)
    index = lexical.index_of_files(spark, corpus, str(tmp_path), id="doc_id")
    seen = []
    whole = lexical.Index._reaching

    def reaching(self, found, *rest):
        out = whole(self, found, *rest)
        seen.append((out.select("block").distinct().count(), found.select("block").distinct().count()))
        return out

    monkeypatch.setattr(lexical.Index, "_reaching", reaching)
    found = index.top_k("w0 w1", 5)
    assert seen[0][0] * 2 < seen[0][1]
    plan = found._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and plan.count("Exchange hashpartitioning") == 0


def test_files_that_are_the_same_arent_read(spark, corpus, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(corpus).write.parquet(path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path))
    first = lexical.index_of_files(spark, path, str(tmp_path / "i"), id="doc_id")
    built = lexical.build
    monkeypatch.setattr(lexical, "build", lambda *a, **k: pytest.fail("built again"))
    again = []
    assert read_bytes(spark, lambda: again.append(lexical.index_of_files(spark, path, str(tmp_path / "i"), id="doc_id"))) < size / 10
    assert again[0] == first
    monkeypatch.setattr(lexical, "build", built)
    for i in range(3):  # a file more is another corpus; the newest indexes stay
        spark.createDataFrame([(9000 + i, "w0 w0 unheard")], "doc_id long, text string").write.mode("append").parquet(path)
        index = lexical.index_of_files(spark, path, str(tmp_path / "i"), id="doc_id")
        assert index.documents == first.documents + i + 1 and index.top_k("unheard", 50).count() == i + 1
    (of,) = (tmp_path / "i").iterdir()
    assert len(list(of.iterdir())) == 2 and index.document_frequencies().where(F.col("term") == "unheard").first().df == 3


def test_an_index_that_isnt_whole_is_built_again(spark, corpus, tmp_path):
    index = lexical.index_of_files(spark, corpus, str(tmp_path), id="doc_id")
    os.remove(f"{index.path}/index.json")
    again = lexical.index_of_files(spark, corpus, str(tmp_path), id="doc_id")
    assert again == index and again.top_k("w0", 3).count() == 3


def test_no_documents(spark, tmp_path):
    index = lexical.build(spark.createDataFrame([], "chunk_id long, text string"), str(tmp_path / "i"))
    assert index.documents == 0 and index.top_k("nasa", 5).count() == 0


def test_a_task_has_few_blocks(spark, corpus, tmp_path, monkeypatch):
    """Buckets are as many as the corpus needs, so the rows of a task don't grow with it; long documents are fewer in a block."""
    monkeypatch.setattr(lexical, "BLOCK", 25)
    index = lexical.index_of_files(spark, corpus, str(tmp_path / "i"), id="doc_id")
    assert index.buckets * 8 > index.blocks
    rows = spark.createDataFrame([(i, "w " * 20_000) for i in range(100)], "doc_id long, text string")
    assert lexical.build(rows, str(tmp_path / "l"), id="doc_id").blocks >= 100 * 20_000 / lexical.LONG / 25


@pytest.mark.parametrize("few", [0, 10**6])
def test_a_batch_shuffles_documents_once(spark, corpus, tmp_path, monkeypatch, few):
    """Rows that are shuffled are postings and lists of the best, none for each document of each query."""
    for name, value in (("BLOCK", 250), ("FIRST", 1), ("FEW", few), ("BATCH", 1000)):
        monkeypatch.setattr(lexical, name, value)
    index = lexical.index_of_files(spark, corpus, str(tmp_path), id="doc_id")
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda x: sum(x.apply(i).shuffleWriteRecords() for i in range(x.size()))
    queries = spark.createDataFrame([(i, "w0 w1 w2 w3") for i in range(400)], "query_id long, text string")
    before = total(listed())
    rows = index.batch_top_k(queries, 3).collect()
    assert len(rows) == 1200 and total(listed()) - before < 400 * 3000 / 4
    monkeypatch.setattr(lexical, "BATCH", 100)
    monkeypatch.setattr(lexical, "CELLS", 512)
    assert sorted(map(tuple, index.batch_top_k(queries, 3).collect())) == sorted(map(tuple, rows))


def shuffled_rows(spark, run):
    """Rows that the stages of a run have put into shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda x: sum(x.apply(i).shuffleWriteRecords() for i in range(x.size()))
    before = total(listed())
    run()
    return total(listed()) - before


def test_an_index_shuffles_documents_and_no_terms(spark, corpus, tmp_path):
    """Documents meet once in their blocks; then only a term's maxima in a block are shuffled, not its documents."""
    docs = spark.read.parquet(corpus)
    made = []
    rows = shuffled_rows(spark, lambda: made.append(lexical.build(docs, str(tmp_path / "i"), id="doc_id")))
    assert rows < 4 * docs.count() < made[0]._postings().count()


def test_postings_are_the_counts_of_each_document(spark, tmp_path):
    texts = {"a": "One two one 1,000 数据库", "b": "", "c": None, "é": "two " * 300, "d": "Straße two"}
    index = lexical.build(spark.createDataFrame(list(texts.items()), "name string, text string"), str(tmp_path / "i"), id="name")
    got = {(r.name, r.term): (r.tf, r.doc_len) for r in index._postings().selectExpr("name", "term", "tf", "doc_len").collect()}
    chinese = {("a", t): (1, 9) for t in ("two", "1000", "数", "据", "库", "数据", "据库")}
    assert got == chinese | {("a", "one"): (2, 9), ("é", "two"): (300, 300), ("d", "strasse"): (1, 2), ("d", "two"): (1, 2)}
    assert index.documents == 5 and index.tokens == 311
    assert {r.term: r.df for r in index.document_frequencies().collect()}["two"] == 3


@pytest.mark.parametrize("few", [0, 10**6])
def test_a_batch_shuffles_no_postings(spark, corpus, tmp_path, monkeypatch, few):
    """Postings lie by block; queries and bests are shuffled alone."""
    for name, value in (("BLOCK", 250), ("FIRST", 1), ("FEW", few)):
        monkeypatch.setattr(lexical, name, value)
    index = lexical.index_of_files(spark, corpus, str(tmp_path), id="doc_id")
    queries = spark.createDataFrame([(i, f"w0 w1 w{i + 2}") for i in range(5)], "query_id long, text string")
    assert index.postings(["w0", "w1"]).count() > 3000
    assert shuffled_rows(spark, lambda: index.batch_top_k(queries, 3).collect()) < 3000
