import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import audit, chunking, documents, evaluation, pages, retrieval, selection
from brindle.sources import packages, readers, sinks
from brindle.streaming import events


def test_balanced_questions_as_taken_one_by_one(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice("aabc"), i) for i in range(60)]
    key = lambda r: (hashlib.sha256(f"s|{r[0]}|{r[2]}".encode()).hexdigest(), r[2])
    for n in (5, 12, 40, 100):
        left, taken, count = sorted(rows, key=key), [], {}
        for doc in {r[0] for r in rows}:
            taken.append(next(r for r in left if r[0] == doc))
        taken = sorted(taken, key=key)[:n]
        left = [r for r in left if r not in taken]
        for r in taken:
            count[r[1]] = count.get(r[1], 0) + 1
        while left and len(taken) < n:
            one = min(left, key=lambda r: (count.get(r[1], 0), key(r)))
            taken.append(one)
            left.remove(one)
            count[one[1]] = count.get(one[1], 0) + 1
        got = selection.balanced_questions(spark.createDataFrame(rows, "doc long, category string, id long"), n, "s").collect()
        assert sorted((r.doc, r.category, r.id) for r in got) == sorted(taken)


def test_covering_documents(spark):
    docs = spark.createDataFrame([("a", "x", 5, 10, "h1"), ("b", "x", 5, 10, "h2"), ("c", "y", 50, 10, "h3"), ("d", "y", 5, 10, "h2"), ("e", "z", 500, 1, "h5")], "doc string, domain string, pages long, bytes long, content_hash string")
    questions = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("b", "q1"), ("b", "q3"), ("b", "q4"), ("c", "q2"), ("c", "q2"), ("d", "q5"), ("e", "q6")], "doc string, category string")
    got = selection.covering_documents(questions, docs, 4, "s", most_pages=100).orderBy("place").collect()
    assert [r.doc for r in got] == ["b", "c", "a"]  # d has the content of b, e too many pages
    assert [r.doc for r in selection.covering_documents(questions, docs, 1, "s").collect()] == ["b"]


def test_formula_candidates_and_merged(spark):
    span = lambda b, k="formula": (b, k, f"{b}=1")
    hits = spark.createDataFrame([(1, 10, [span("x", "text"), span("p"), span("q")]), (2, 11, [span("q"), span("r")]), (3, 12, [])], "rank int, chunk_id long, spans array<struct<block_id:string,block_type:string,text:string>>")
    got = selection.formula_candidates(hits, 2).orderBy("place").collect()
    assert [(r.block_id, r.rank, r.omitted) for r in got] == [("p", 1, 1), ("q", 1, 1)]
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in row.select(selection.merged(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}]


def test_publish_is_exclusive(spark, tmp_path):
    path, rows = str(tmp_path / "r"), spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    sinks.publish(sinks.markdown_table(rows), path, "text")
    assert spark.read.text(path).count() == 4 and "| 1 | a b |" in {r.value for r in spark.read.text(path).collect()}
    with pytest.raises(FileExistsError):
        sinks.publish(rows, path)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r"] and spark.read.text(path).count() == 4


def test_artifacts_tell_damage(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "chunk_id long, embedding array<double>").repartition(2)
    path = str(tmp_path / "a")
    made = sinks.write_artifact(rows, path, per_file=256, model="m1")
    assert made["rows"] == 600 and sinks.read_artifact(spark, path, model="m1").count() == 600
    assert len([p for p in (tmp_path / "a" / "rows").glob("*.parquet")]) >= 3
    with pytest.raises(ValueError):
        sinks.read_artifact(spark, path, model="m2")
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        sinks.read_artifact(spark, path)
    with pytest.raises(ValueError):
        sinks.read_artifact(spark, str(tmp_path / "none"))


def test_vectors_go_to_one_chunk_each(spark):
    chunks = spark.createDataFrame([(1, "a", None), (2, "b", [9.0])], "chunk_id long, text string, embedding array<double>")
    one = lambda rows: spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    got = {r.chunk_id: r.embedding for r in sinks.with_vectors(chunks, one([(1, [1.0])])).collect()}
    assert got == {1: [1.0], 2: [9.0]}
    for bad in ([(3, [1.0])], [(1, [1.0]), (1, [2.0])]):
        with pytest.raises(ValueError):
            sinks.with_vectors(chunks, one(bad))


def test_cache_archive_uploads_and_claims(spark, tmp_path):
    cache = sinks.ParseCache(spark, str(tmp_path / "c"), {"size": 1})
    asked = spark.createDataFrame([("h1",), ("h2",)], "file_hash string")
    state = lambda c: {r.file_hash: (r.state, r.payload) for r in c.get(asked).collect()}
    assert state(cache) == {"h1": ("miss", None), "h2": ("miss", None)}
    put = lambda *rows: spark.createDataFrame(rows, "file_hash string, payload string")
    cache.put(put(("h1", "one")))
    cache.put(put(("h1", "other"), ("h3", "three")))
    assert state(cache) == {"h1": ("hit", "one"), "h2": ("miss", None)} and state(sinks.ParseCache(spark, str(tmp_path / "c"), {"size": 2}))["h1"][0] == "miss"
    cache.table.replace(spark.createDataFrame([("h2", "bad", "x")], "file_hash string, payload string, payload_hash string"))
    assert state(cache)["h2"] == ("corrupt", None)
    raw = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, content binary")
    later = spark.createDataFrame([("a", b"1"), ("b", b"3"), ("c", b"4")], raw.schema)
    assert {tuple(r) for r in sinks.damaged(later, sinks.receipts(raw)).collect()} == {("b", "differs"), ("c", "no receipt")}
    items = spark.createDataFrame([(1, "k", b"x"), (2, "k", b"x"), (3, "l", b"x"), (4, "k", b"long"), (5, "k", b"old"), (6, "k", b"bad")], "item int, kb string, content binary")
    stored = spark.createDataFrame([("k", hashlib.sha256(b"old").hexdigest())], "kb string, sha256 string")
    got = sinks.upload_results(items, stored, F.when(F.col("content") == b"bad", "not a file"), 3).collect()
    assert {r.item: r.state for r in got} == {1: "stored", 2: "duplicate", 3: "stored", 4: "too large", 5: "duplicate", 6: "not a file"}
    requests = spark.createDataFrame([("p", "a", 2), ("p", "b", 1), ("q", "a", 1), ("q", "b", 1)], "key string, owner string, at int")
    held = spark.createDataFrame([("q", "b")], "key string, owner string")
    assert {(r.key, r.owner) for r in sinks.granted_claims(requests, held).where("granted").collect()} == {("p", "b"), ("q", "b")}


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_package_risks_and_dispatch(spark):
    rel = lambda target, mode="External": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="t" Target="{target}" TargetMode="{mode}"/></Relationships>'
    files = {"a.docx": ("docx", package({"word/document.xml": "<x/>", "word/media/i.png": "x", "word/_rels/document.xml.rels": rel("https://example.org/page")})), "b.docx": ("docx", package({"word/document.xml": "<x/>", "word/_rels/document.xml.rels": rel("https://example.org/i.png")})), "c.xlsx": ("xlsx", package({"xl/workbook.xml": "<x/>", "xl/externalLinks/externalLink1.xml": "<x/>", "xl/externalLinks/_rels/externalLink1.xml.rels": rel("file:///other.xlsx"), "xl/charts/chart1.xml": "<x/>"})), "d.docx": ("docx", b"PK broken"), "e.txt": ("txt", b"text")}
    found = spark.createDataFrame([(p, k, c) for p, (k, c) in files.items()], "path string, kind string, content binary")
    told = packages.signals(packages.parts(found)).join(found.select("path", "kind"), "path")
    got = {r.path: (r.links, r.risks) for r in told.withColumn("risks", packages.risks(F.col("kind"))).collect()}
    assert got == {"a.docx": (1, ["DOCX_HAS_IMAGE"]), "b.docx": (0, ["EXTERNAL_ATTACHMENT_MISSING"]), "c.xlsx": (0, ["XLSX_HAS_EXTERNAL_LINK", "XLSX_HAS_CHART"]), "d.docx": (0, ["PACKAGE_BROKEN"])}
    kinds = spark.createDataFrame([("docx", None), ("png", None), ("pdf", None), ("txt", "empty"), ("zip", None), ("txt", None)], "kind string, why string")
    got = [tuple(r[0]) for r in kinds.select(packages.dispatch(F.col("kind"), F.col("why"))).collect()]
    assert got == [("docx", None), (None, "no native reader"), (None, "PDF text isn't read here"), (None, "empty"), (None, "unknown format"), ("text", None)]
    asked = spark.createDataFrame([(1, "pdf"), (2, "pdf"), (3, "md")], "doc_id int, kind string")
    parsed = spark.createDataFrame([(1, "pdf"), (2, "md"), (3, "md"), (3, "md")], "doc_id int, kind string")
    assert {r.doc_id: r.whole for r in packages.same_document(parsed, asked).collect()} == {1: True, 2: False, 3: False}


def test_pages(spark):
    schema = "doc_id int, page int, place int, type string, text string"
    layout, listed = spark.createDataFrame([(1, 1, 1, "text", "a"), (1, 9, 1, "text", "far"), (1, 1, 1, "odd", " ")], schema), spark.createDataFrame([(1, 1, 1, "text", "b"), (1, 2, 1, "text", "c"), (1, None, 1, "text", "d")], schema)
    got = pages.page_blocks(layout, listed, spark.createDataFrame([(1, 3)], "doc_id int, n_pages int")).collect()
    assert sorted((r.text, r.origin) for r in got) == [(" ", "layout"), ("a", "layout"), ("c", "list"), ("d", "quarantined"), ("far", "quarantined")]
    assert [tuple(r) for r in pages.layout_findings(layout, ("text",)).collect()] == [(1, 1, 1, 0)]
    rows = [(1, 1, 1, "text", 50.0, 60.0), (1, 1, 2, "footer", 90.0, 95.0), (1, 1, 3, "header", 1.0, 5.0), (1, 1, 4, "text", 70.0, 80.0), (1, 2, 1, "text", 1.0, 9.0), (1, 2, 2, "header", 20.0, 30.0), (1, 3, 1, "text", 9.0, 20.0), (1, 3, 2, "header", 1.0, 2.0), (1, 3, 3, "header", 3.0, 4.0)]
    got = pages.with_margins_in_order(spark.createDataFrame(rows, "doc_id int, page int, place int, type string, y0 double, y1 double")).orderBy("page", "reading_place").collect()
    assert [(r.page, r.place) for r in got] == [(1, 3), (1, 1), (1, 4), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_encoded_in_bounded_batches_and_refined(spark):
    def encoder(texts):
        assert len(texts) <= 3 and (len(texts) == 1 or sum(map(len, texts)) <= 20)
        return [[float(len(t)), float(len(texts))] for t in texts]

    rows = [(i, "x" * n) for i, n in enumerate([1, 2, 3, 4, 30, 10, 10, 10, 0])] + [(99, None)]
    texts = spark.createDataFrame(rows, "chunk_id long, text string")
    got = {r.chunk_id: r.embedding[0] for r in retrieval.encoded(texts.coalesce(1), encoder, rows=3, chars=20).collect()}
    assert got == {i: len(t or "") for i, t in rows}
    long = spark.createDataFrame([(1, "word " * 40, False), (2, "y" * 50, False), (3, "word " * 40, True), (4, "", False)], "chunk_id long, text string, formula boolean")
    parts = {}
    for r in retrieval.refined(long, lambda t: -(-len(t) // 4), 10, whole="formula").orderBy("chunk_id", "part").collect():
        parts.setdefault(r.chunk_id, []).append((r.start, r.end, r.tokens))
    for i, text in ((1, "word " * 40), (2, "y" * 50)):
        assert parts[i][0][0] == 0 and parts[i][-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts[i], parts[i][1:])) and max(p[2] for p in parts[i]) <= 10
    assert parts[3] == [(0, 200, 50)] and parts[4] == [(0, 0, 0)] and all(("word " * 40)[s - 1] == " " for s, _, _ in parts[1][1:])


def test_a_batch_delivered_twice_is_stored_once(spark, tmp_path):
    rows = spark.sql("select id event_id, id % 3 user_id, 'a' event_type, cast(id as double) value, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id,0) ts from range(50)")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).unionByName(rows.limit(5).withColumn("ts", F.col("ts").cast("timestamp_ntz"))).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = str(tmp_path / "out")
    for run in ("s1", "s2"):  # a checkpoint that is lost: all batches come again
        events.ingest(events.read_events(spark, str(tmp_path)), out, str(tmp_path / run)).awaitTermination()
        assert spark.read.parquet(out).count() == 50


def test_gate_precedence_and_categories(spark):
    metrics = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "s string, recall double")
    assert {r.s: r.recall for r in evaluation.gated(metrics, F.col("s") == "a", ["recall"]).collect()} == {"a": 0.5, "b": None}
    new, old = spark.createDataFrame([(1, "READY")], "d int, s string"), spark.createDataFrame([(1, "FAILED"), (2, "PARSING")], "d int, s string")
    assert {tuple(r) for r in evaluation.preferred(new, old, "d", "s").collect()} == {(1, "READY", "snapshot"), (2, "PARSING", "checkpoint")}
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.5), (1, 0.0, 0.0, 0.0, 0.0)], "n_hits int, recall_at_5 double, recall_at_10 double, mrr_at_20 double, doc_mrr double")
    assert [r[0] for r in rows.select(evaluation.retrieval_category(document_mrr="doc_mrr")).collect()] == ["TARGET_PAGE_MISS", "TARGET_DOCUMENT_MISS"]
    flow = spark.createDataFrame([(1, 1, 1, 1, False), (7, 1, 1, 1, True)], "f int, h int, a int, b int, ok boolean")
    assert [r[0] for r in flow.select(evaluation.flow_category("f", "h", "a", "b", F.col("ok"))).collect()] == ["INCOMPLETE_EXECUTION", "RERANK_LOW_RANK"]


def test_csv_and_benchmark_files(spark, tmp_path):
    texts = {"a.csv": 'x,y\n1,"two\nlines"\n', "b.csv": "x,y\n1\n", "c.csv": 'x,"open', "d.csv": "", "e.csv": "\x00"}
    found = spark.createDataFrame([(p, "csv", t.encode()) for p, t in texts.items()], "path string, kind string, content binary")
    got = {r.path: (r.text, r.rows, r.columns, r.reason) for r in readers.csv_blocks(found).collect()}
    assert got["a.csv"] == ('x\ty\n1\t"two\nlines"\n', 2, 2, None) and got["b.csv"][3] == "row 2 has 1 cells, not 2"
    assert got["c.csv"][3] and got["d.csv"][3] == "empty" and got["e.csv"][3] == "not text"
    assert readers.csv_table("a\nb\nc\n", rows=2)[3] == "too many rows or columns"
    (tmp_path / "q.jsonl").write_text('{"q": "a", "n": 1}\n{"q": "b", "n": 2}\n')
    (tmp_path / "q.json").write_text('[{"q": "a",\n "n": 1}]')
    read = lambda name, kind, **how: sorted(r.q for r in readers.benchmark_rows(spark, str(tmp_path / name), kind, "q string, n int", **how).collect())
    assert read("q.jsonl", "jsonl") == ["a", "b"] and read("q.json", "json") == ["a"]
    with pytest.raises(ValueError):
        read("q.jsonl", "jsonl", rows=1)
    spark.createDataFrame([("c", 3)], "q string, n long").write.parquet(str(tmp_path / "q.parquet"))
    assert read("q.parquet", "parquet") == ["c"]
    with pytest.raises(ValueError):
        readers.benchmark_rows(spark, str(tmp_path / "q.parquet"), "parquet", "other string")


def test_manifests_rubrics_assets_and_paths(spark):
    row = "path string, bytes long, sha256 string"
    manifest, files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 1, "w"), ("d", 1, "w")], row), spark.createDataFrame([("a", 1, "x"), ("b", 2, "other"), ("e", 1, "v"), ("d", 1, "w")], row)
    assert {tuple(r) for r in audit.manifest_findings(manifest, files).collect()} == {("b", "differs"), ("c", "missing"), ("d", "repeated"), ("e", "not listed")}
    rubrics = spark.createDataFrame([([1.0, 0.0], ["a", "b"]), ([1.0], ["a", "b"]), ([float("nan")], ["a"]), ([-1.0], ["a"]), ([0.0], ["a"]), ([], [])], "w array<double>, c array<string>")
    assert [r[0] for r in rubrics.select(audit.rubric_reason(F.col("w"), F.col("c"))).collect()] == [None, "lengths differ", "not finite or negative", "not finite or negative", "no weight", "empty"]
    text = "![a](one.png) `![x](no.png)`\n```\n![y](no.png)\n```\n![b]( <two.png> \"t\")\n~~~\n![z](no.png)"
    assert spark.createDataFrame([(text,)], "t string").select(T.markdown_assets(F.col("t"))).first()[0] == ["one.png", "two.png"]
    rows = [(1, 0, 1, "A"), (1, 1, 3, "a3"), (1, 2, 2, "a2"), (1, 3, 3, "a23"), (1, 4, 1, "B"), (1, 5, 3, "b3"), (1, 6, 6, "b6"), (2, 0, 2, "c")]
    got = {(r.doc_id, r.place): r.path for r in documents.section_paths(spark.createDataFrame(rows, "doc_id int, place int, level int, title string")).collect()}
    assert got == {(1, 0): "A", (1, 1): "A / a3", (1, 2): "A / a2", (1, 3): "A / a2 / a23", (1, 4): "B", (1, 5): "B / b3", (1, 6): "B / b3 / b6", (2, 0): "c"}
    assert chunking.recipe() != chunking.recipe(500) and chunking.recipe() == chunking.recipe(600, 80)
